"""Each stage against its operator's decisions on its own input, and the whole against a run stage by stage."""

import corpus_pipeline as pipeline
import pytest

from quillspark.llm import quality_rules
from quillspark.llm.common import table


def test_stages_and_run(spark, sf):
    docs = table(spark, sf, "documents")
    first = docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf).cache()
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in before.select("doc_id").collect()}, name
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
        if name == "quality rules":
            model = quality_rules.weights(before, table(spark, sf, "labels"))
            assert set(ids) == {r["doc_id"] for r in quality_rules.with_rules(before, model).where("rules.kept").collect()}
    assert sorted(docs.select("doc_id", "ids_sha256").collect()) == sorted(pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect())


@pytest.mark.parametrize("k", range(5))
def test_nulls_and_empty(spark, sf, k):
    shape = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(None, None, None, None, None, 1), (1, "", None, None, 0, 2), (1, "", None, None, 0, 2), (2, "word " * 30, "en", "s", 150, 3)]
    stage = pipeline.STAGES[k][1]
    assert stage(spark, spark.createDataFrame([], shape), sf).count() == 0
    assert stage(spark, spark.createDataFrame(rows, shape), sf).count() <= len(rows)
