"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup by SimHash, benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns all that it keeps; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, fmindex, line_templates, near_copies, quality_rules
from quillspark.llm.common import cut, table
from quillspark.llm.queries import sha256, tokenizer_path

#: A document's columns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame, changed: str) -> DataFrame:
    """The documents with text ``changed`` where it isn't null, and the length of what changed."""
    same = F.col(changed).isNull() | F.col(changed).eqNullSafe(F.col("text"))
    length = F.when(same, F.col("n_chars")).otherwise(F.length(changed).cast("long"))
    return df.select("doc_id", F.coalesce(F.col(changed), F.col("text")).alias("text"), "lang", "source", length.alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = docs.select(*COLUMNS)
    model = quality_rules.weights(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_rules(docs, model).where("rules.kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; one that loses all its lines goes."""
    out = line_templates.drop_recurring_lines(docs.select(*COLUMNS)).select("*", F.col("line_dedup.text").alias("_clean"), F.col("line_dedup.n_dropped").alias("_lost"))
    return _with_text(out.where("_lost = 0 or trim(_clean) <> ''"), "_clean")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash fingerprints of five-word shingles, decided by their Jaccard similarity of 0.8): that of the smallest id. Repeated rows of it are one."""
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_k1"), F.hash(*COLUMNS).alias("_k2"))
    found = near_copies.classes(keyed, ["_k1", "_k2"], ["doc_id"])
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    chosen = found.groupBy("class").agg(F.min(order).alias("c")).select("c._k1", "c._k2")
    return keyed.join(chosen, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others lose the spans that benchmark windows hit."""
    out = fmindex.search(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _with_text(out.where("not leaks.contaminated").select("*", F.col("leaks.clean_text").alias("_clean")), "_clean")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to."""
    out = bpe.encode(docs.select(*COLUMNS), tokenizer_path(), decoded_col="decoded")
    return out.select("doc_id", "n_tokens", "ids", sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("bpe encoding and decoding", encode)]

#: SQL can't say all of the stages (see the tests for what they are held against).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. The result of each is computed once, into the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
