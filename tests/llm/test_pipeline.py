"""Every stage takes effect on what the one before kept, and copes with odd rows."""
import corpus_pipeline
from oddities import SF, nothing, odd  # noqa: F401

from quarrystat.llm.common import saved, table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(ids) == out.count()
        docs = out
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in final} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(r["taken"] <= 2 * r["size"] for r in final)


def test_odd_rows_pass_all_stages(spark, odd, nothing):
    for rows in (odd, nothing):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, SF), "stage")
        docs.collect()
