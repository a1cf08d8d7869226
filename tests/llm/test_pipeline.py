from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline as pipeline
from tidemark.llm import common, jaccard, packing, pii, quality, repeats


def test_stages_follow_each_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    one = quality.stage(spark, docs, small)
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    two = jaccard.stage(spark, one, small)
    assert {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in jaccard.cluster(one).where("doc_id = component_id").collect()}
    three = repeats.stage(spark, two, small)
    four = pii.stage(spark, three, small)
    assert two.columns == three.columns == four.columns == docs.columns
    want = sorted(map(tuple, packing.stage(spark, four, small).collect()))
    out = pipeline.run(spark, small)
    assert sorted(map(tuple, out.collect())) == want and len(pipeline.STAGES) == 5
    packing.check_bins(out.collect())


def test_stages_on_edge_and_empty_tables(spark, edge, empty, tmp_path):
    """Each stage on nulls in any column, odd ids, clashing names and on no rows: all columns stay, and so do clean rows."""
    long = " ".join(f"word{k}" for k in range(60))
    rows = spark.createDataFrame([(None, long, None, None, None), (None, long, "en", "a", 1), (2**53 + 1, long + " one", "en", "a", 1), (2**53 + 3, long + " one", None, "b", 1)], edge.select("doc_id", "text", "lang", "source", "n_chars").schema)
    names = [c for c in edge.columns if c not in rows.columns]
    for start in (edge, empty, rows.selectExpr("*", *(f"7 AS {c}" for c in names))):
        docs = start
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, "")
            path = str(tmp_path / f"{len(start.columns)}-{id(start)}-{k}")
            out.write.parquet(path)
            docs, before = spark.read.parquet(path), docs
            if k < 4:
                assert docs.columns == before.columns
        packing.check_bins(docs.collect())
        if start is not edge and start is not empty:
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 0, 2**53 + 1]
        if start is empty:
            assert docs.count() == 0


def test_two_pipelines_and_another_table_at_once(spark, small):
    """Each scope deletes what it wrote itself and nothing else."""
    mine = common.written(spark.range(5), "mine")
    with ThreadPoolExecutor(2) as pool:
        a, b = (sorted(map(tuple, f.result().collect())) for f in [pool.submit(pipeline.run, spark, small) for _ in range(2)])
    assert a == b and a and mine.count() == 5
    with common.Scope(spark) as scope:
        one, two = common.written(spark.range(3), "one"), common.written(spark.range(4), "two")
        scope.release(keep=1)
        assert two.count() == 4 and len(scope.paths) == 1
        with common.Scope(spark) as inner:
            common.written(spark.range(2), "three")
        assert len(inner.paths) == 1 and len(scope.paths) == 1
    assert mine.count() == 5 and one.inputFiles() and not common.written(spark.range(1), "x").isEmpty()
