"""Lines in file order, manifests of good and bad tables, the order stream with late, repeated and last events, dates."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, signals
from tidemark.sources import lines
from tidemark.streaming import lifecycle as L

T0 = datetime(2024, 1, 1)


def test_lines_keep_their_order_when_files_are_split(spark, tmp_path):
    want = {}
    for name, n in (("a.txt", 3000), ("b.txt", 2), ("c.txt", 700)):
        text = [f"{name} line {k} " + "x" * (k % 90) if k % 7 else "" for k in range(n)]
        (tmp_path / name).write_text("\n".join(text) + ("\n" if n > 2 else ""))
        want[name] = text
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = lines.numbered(spark, str(tmp_path)).collect()
        got = {name: [r["line"] for r in sorted(rows, key=lambda r: r["line_no"]) if r["file"].endswith(name)] for name in want}
        assert got == want and len({(r["file"], r["place"]["start"]) for r in rows}) > 5
        assert all(sorted(r["line_no"] for r in rows if r["file"].endswith(name)) == list(range(1, len(text) + 1)) for name, text in want.items())
        tail = [r["line"] for r in lines.last(lines.placed(spark, str(tmp_path)), 20).collect()]
        assert tail == [x for x in reversed(want["c.txt"]) if x][:20]
        progress = profile.refresh_progress(lines.placed(spark, str(tmp_path)), "place").first()
        assert progress["last_line"] == [x for x in want["c.txt"] if x][-1] and progress["done"] is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_manifest_probes_paths_and_reads_footers(spark, tmp_path):
    good, none, bad, empty = (str(tmp_path / n) for n in ("good", "none", "bad", "empty"))
    spark.range(1000).select(F.col("id").alias("k"), F.lit("v").alias("v")).repartition(3).write.parquet(good)
    spark.range(0).select(F.col("id").alias("k")).write.parquet(none)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_bytes(b"PAR1 this is no table")
    (tmp_path / "empty").mkdir()
    conf = {k: spark.conf.get(k) for k in profile.FOOTERS}
    got = {r["name"]: tuple(r)[1:] for r in profile.manifest(spark, {"good": (good, "k"), "none": (none, "k"), "bad": (bad, "k"), "empty": (empty, "k"), "gone": (str(tmp_path / "gone"), "k"), "column": (good, "x")}).collect()}
    assert got["good"] == (1000, 2, "0", "999", None) and got["none"][:2] == (0, 1)
    assert {k: v[-1] for k, v in got.items()} == {"good": None, "none": None, "bad": "unreadable", "empty": "empty", "gone": "missing", "column": "unreadable"}
    assert conf == {k: spark.conf.get(k) for k in profile.FOOTERS}
    for k, v in profile.FOOTERS.items():
        spark.conf.set(k, v)
    try:
        plan = spark.read.parquet(good).agg(F.count("*"), F.max("k"))._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*), MAX(k)]" in plan
    finally:
        for k, v in conf.items():
            spark.conf.set(k, v)


def test_stream_reports_late_repeated_and_last_orders(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    first = [
        (1, "added", at(0)), (1, "changed", at(10)), (1, "deleted", at(35)), (1, "trade", at(36)), (1, "added", at(3)), (1, "changed", at(10)),
        (2, "changed", at(20)), (2, "added", at(15)), (3, "added", at(0)), (3, "changed", at(45)), (3, "deleted", at(50)), (4, "added", at(100)), (9, "added", at(5000)),
    ]
    second = [(2, "deleted", at(40)), (4, "changed", at(130)), (4, "deleted", at(160)), (9, "changed", at(5010)), (9, "deleted", at(5020)), (9, "deleted", at(5020)), (9, "trade", at(5021))]
    schema, path, clock = "order_id long, kind string, ts timestamp", str(tmp_path / "events"), str(tmp_path / "clock")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(path)
    stream = L.lifecycle(spark.readStream.schema(schema).parquet(path), delay="2 hours", clock=L.clock(spark, clock))
    silent = L.drained(L.lifecycle(spark.readStream.schema(schema).parquet(path), delay="0 seconds"), "silent")
    assert 9 not in {r["order_id"] for r in silent.collect()}  # without a clock the last order stays open
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(path)
    got = {r["order_id"]: (r["status"], r["has_trade"]) for r in L.drained(stream, "lifecycle", clock).collect()}
    assert got == {1: ("complete", True), 2: ("complete", False), 3: ("timeout", False), 4: ("complete", False), 9: ("complete", True)}


@pytest.mark.parametrize("key", ("target_forecast_date", "Target_Forecast_Date", "TARGET_FORECAST_DATE"))
def test_modal_date(spark, key):
    meta = spark.createDataFrame([("other", "x"), (key, "2024-05-06")], "key string, value string")
    none = spark.createDataFrame([(None,), ("soon",)], "forecast_date string")
    assert signals.modal_date(none, meta).first()[0] == "2024-05-06"
    some = spark.createDataFrame([("2024-01-02",), ("2024-01-01",), ("2024-01-02 00:00:00",), ("soon",), ("soon",), ("soon",)], "forecast_date string")
    assert signals.modal_date(some, meta).first()[0] == "2024-01-02"
    assert signals.modal_date(none, meta.limit(0)).count() == 0


def test_pair_scores_without_joins(spark):
    legs = spark.createDataFrame([("d1", "EUR", 0.5), ("d1", "USD", -0.25), ("d2", "JPY", 1.0)], "day string, currency string, score double")
    universe = spark.createDataFrame([(0, "EUR/USD"), (1, "USD/JPY"), (2, "nonsense")], "universe_idx int, primary_pair string")
    d = signals.pair_scores(legs, universe, "day")
    assert {(r["day"], r["primary_pair"], r["pair_score"], r["expected_side"]) for r in d.collect()} == {("d1", "EUR/USD", 0.75, "long"), ("d1", "USD/JPY", -0.25, "short"), ("d2", "EUR/USD", 0.0, "neutral"), ("d2", "USD/JPY", -1.0, "short")}
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
    assert signals.pair_scores(legs, universe.limit(0), "day").count() == 0 and signals.pair_scores(legs.limit(0), universe, "day").count() == 0


def test_stored_bars_are_joined_without_a_shuffle(spark, tmp_path):
    import uuid

    from tidemark.operators import gram
    from tidemark.sources import stored

    rows = [(s, T0 + timedelta(days=d), 10.0 + d + len(s)) for s in ("A", "BB", "CCC", "D") for d in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    name = f"bars_{uuid.uuid4().hex}"
    stored.store(bars.where(F.col("ts") < T0 + timedelta(days=30)), name, 4)
    stored.upsert(bars.withColumn("close", F.when((F.col("symbol") == "A") & (F.col("ts") == T0), 99.0).otherwise(F.col("close"))), name)
    assert spark.table(name).where("batch = 1").count() == 41  # ten new days of each, one changed bar
    stored.upsert(stored.read(spark, name), name)
    assert spark.table(name).agg(F.max("batch")).head()[0] == 1
    read = stored.read(spark, name)
    assert read.count() == 160 and read.where("symbol = 'A'").orderBy("ts").first()["close"] == 99.0
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = gram.rows_of(read, spark.createDataFrame([("A", "BB"), ("CCC", "D")], "y string, x string"))
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(symbol") == 1 and plan.count("Exchange") == 2, plan  # the asking side, and the pairs
        assert met.count() == 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
