import __spark_entry__
import corpus_pipeline
from ledgerlark.llm import decontaminate
from ledgerlark.llm.common import prepare


def test_stages_keep_columns_and_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "quality classifier":
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in left for d in good) > 0.97 * len(good)
            assert sum(d in left for d, q in labels.items() if q == 0) < 0.2 * sum(q == 0 for q in labels.values())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.matches(docs, bench).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[4] and {"doc_id", "taken", "target", "positions"} <= set(last.columns)


def test_registered_queries():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
