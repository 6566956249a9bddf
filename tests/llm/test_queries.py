import os

import pytest

from annalist.llm.queries import ORACLES, QUERIES
from comparing import connect, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])


def test_pipeline_stages_keep_what_they_should(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "language_id", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    # Extra columns and odd rows go through every stage.
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, None, "de", None, 3)], docs.schema)
    rows = docs.unionByName(odd).withColumn("extra", docs.doc_id)
    before = {r.doc_id: r.text for r in rows.collect()}
    for name, stage in p.STAGES[:-1]:
        rows = p.materialise(stage(spark, rows, FOLDER), name)
        assert rows.columns == list(p.COLUMNS)
        assert 0 < rows.count() <= len(before)
    kept = {r.doc_id: r.text for r in rows.collect()}
    assert set(kept) <= set(before)
    packed = p.STAGES[-1][1](spark, rows, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(kept)
