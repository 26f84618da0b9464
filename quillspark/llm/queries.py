"""The queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, fmindex, kd_shards, line_templates, pii, quality_rules, secret_scan, simhash, suffix_dedup, token_counts
from quillspark.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256(column: Column | str) -> Column:
    return F.sha2(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.length("line_dedup.text").cast("long").alias("n_chars_kept"), sha256("line_dedup.text").alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.weights(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_rules(docs, model).select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.shards(table(spark, sf_dir, "documents"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    out = bpe.encode(table(spark, sf_dir, "documents"), path, decoded_col="decoded")
    return out.select("doc_id", "n_tokens", sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    texts = suffix_dedup.deduplicated(docs).select("k1", "k2", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), sha256("kept").alias("kept_sha256"))
    rows = docs.select("doc_id", *suffix_dedup.text_keys(F.col("text")))
    return rows.join(texts, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = bpe.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fmindex.search(docs, table(spark, sf_dir, "benchmark"), with_clean=False)
    return out.select("doc_id", "leaks.n_words", "leaks.n_hit", F.size("leaks.items").cast("long").alias("n_items"), sha256(F.array_join("leaks.items", ",")).alias("items_sha256"), "leaks.contaminated")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counted(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [of(k) for k in kinds]


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("personal", lambda s: s["base"])
    return out.select("doc_id", *_counted(base, pii.KINDS), sha256(_spelled(base)).alias("base_sha256"), _spelled(F.col("personal")).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.log_ratios(secret_scan.samples(spark))
    out = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return out.select("doc_id", *_counted(F.col("secrets"), secret_scan.KINDS[:3]), sha256(_spelled(base)).alias("base_sha256"), _spelled(F.col("secrets")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_kd_shards, op4_bpe, op5_suffix_dedup, op6_token_counts, op7_decontaminate, op8_simhash, op9_pii, op10_secrets)
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Only where SQL can say it and whole tables stay quick: the rest have brute-force tests.
ORACLES: dict[str, str] = {
    "op7_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) x),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) x GROUP BY doc_id),
items AS (SELECT doc_id, COUNT(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
}
