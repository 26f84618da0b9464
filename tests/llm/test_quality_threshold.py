"""The threshold on labelled documents that the model hasn't seen."""

from pyspark.sql import functions as F

from quillspark.llm import quality_rules
from quillspark.llm.common import table


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"  # smaller tables have no near misses
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality_rules.weights(docs, labels.where(half == 0))
    rows = quality_rules.with_rules(docs, model).join(labels.where(half == 1).dropDuplicates(["doc_id"]), "doc_id").where("not rules.base_failed").select("rules.kept", "rules.score", "quality", "toxic").collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1 and not r["toxic"]]
    assert sum(r["score"] >= -0.1 for r in bad) > 0.1 * len(bad) >= 1
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) > 50
