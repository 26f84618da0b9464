"""Quality rules by a hashed n-gram log-likelihood ratio (operator 2), DataFrame functions only.

Words and pairs of words are hashed into ``BUCKETS`` buckets. Two smoothed multinomials over the buckets, one of trusted target
documents and one of the whole raw corpus, give a weight to each bucket: the log of its ratio. A document's score is the mean
weight of its n-grams; it is kept if it passes the base rules and its score reaches ``THRESHOLD``.

The raw counts come from every document. The target counts come from at most ``TRUSTED`` trusted labelled documents (quality 1, not toxic), those of least hash: a documented
bound for a fitted model, whose ids are broadcast. The model itself has ``BUCKETS`` numbers, whatever the corpus.

Null text and null labels: no words, not trusted. A document without words has no score (null) and fails the base rules. Without trusted documents, or an
empty corpus, all weights are 0. Repeated rows count each time; an empty table gives an empty table. Equal scores are kept or rejected alike, and equal hashes of trusted ids are ordered by the id.
Very long texts are read whole, by one task. Other columns pass through under any name; one named like ``out_col`` is replaced. The counts run when the plan is built.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import let, packed, unpacked, words

BUCKETS = 10_000
TRUSTED = 20_000
#: Mean log ratio below which a document is rejected: the loosest multiple of 0.005 that at most 2 % of the quality-0 documents reach, among those that pass the
#: base rules in the half of sf0.1's labels (by hash of the id) that the weights were fitted on. The README has the figures of the other half.
THRESHOLD = -0.045
SMOOTHING = 1.0
WINDOW = 5


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours, from the words' hashes."""
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")

    def both(h: Column) -> Column:
        pairs = F.transform(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda x, i: bucket(F.xxhash64(F.get(h, i), x)))
        return F.concat(F.transform(h, bucket), pairs)

    return let(hashes, both)


def weights(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, trusted: int = TRUSTED, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of target to raw for each bucket."""
    ids = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col(id_col).alias("id")).where("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(trusted).select("id", F.lit(1).alias("good"))
    rows = df.select(F.col(id_col).alias("id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.join(F.broadcast(ids), "id", "left").select("good", F.explode(ngram_buckets(F.col("h"), buckets)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target")).collect()  # a row for each bucket at most
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * buckets
    a, b = sum(target) + smoothing * buckets, sum(raw) + smoothing * buckets
    return [math.log((t + smoothing) / a) - math.log((r + smoothing) / b) for t, r in zip(target, raw)]


def repeat_words(hashes: Column) -> Column:
    """Words inside windows of five words that occur twice or more in a text, from the words' hashes."""
    none = F.array().cast("array<int>")

    def of(h: Column) -> Column:
        last = F.size(h) - WINDOW
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])), covered)

    def covered(grams: Column) -> Column:
        """Most texts repeat nothing, which a hash set tells; the others sort their windows."""
        order = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("h"), i.alias("i"))))
        again = let(order, lambda o: F.array_sort(F.transform(F.filter(o, lambda x, k: _same(o, k + 1, x) | ((k > 0) & _same(o, k - 1, x))), lambda x: x["i"])))
        words = let(again, lambda a: F.aggregate(F.transform(a, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(a, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda n, x: n + x))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), words).otherwise(0).cast("long")

    return let(hashes, of)


def _same(order: Column, k: Column, x: Column) -> Column:
    return F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))


def with_rules(df: DataFrame, model: list[float], text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, out_col: str = "rules") -> DataFrame:
    """``df`` with ``out_col``: struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long, base_failed: boolean, score: double, kept: boolean>."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = df.select(packed(df), text.alias("t"), words(text).alias("w"), lines.alias("l"))
    step = step.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    step = step.withColumn("n", F.size("w").cast("long")).withColumn("r", repeat_words(F.col("h"))).withColumn("b", ngram_buckets(F.col("h"), buckets))
    step = step.withColumn("s", F.when(F.size("b") > 0, F.aggregate("b", F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size("b")))
    failed = (F.col("n") < 10) | (100 * F.col("r") > 20 * F.col("n"))
    rules = F.struct(
        F.col("n").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.col("r").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("s").alias("score"),
        (~failed & (F.coalesce("s", F.lit(0.0)) >= threshold)).alias("kept"),
    )
    return unpacked(step, df, rules, out_col)
