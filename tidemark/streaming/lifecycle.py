"""The order lifecycle over a stream of events, by built-in session windows under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sizing
from ..sources import files


#: A clock's row: no order, only a time that the watermark follows.
CLOCK = "order_id long, kind string, ts timestamp"


def lifecycle(events: DataFrame, timeout_seconds: float = 30.0, delay: str = "10 minutes", clock: DataFrame | None = None) -> DataFrame:
    """order_id, status, has_trade of each order once the watermark has passed its last stage's timeout.

    The gap of a session is a stage's timer: each event of an order starts it anew, and the order is reported when it
    runs out. Repeated events change nothing (the first counts); late ones count up to the delay. A session without
    `added` is the rest of an order already reported. State holds open sessions only. clock: rows that only move time
    on, for streams that fall silent; without it the last orders stay open.
    """
    if clock is not None:
        events = events.select("order_id", "kind", "ts").unionByName(clock.select("order_id", "kind", "ts"))
    session = F.session_window("ts", f"{int(timeout_seconds) + 1} seconds").alias("session")
    times = sizing.stage_times(events.withWatermark("ts", delay), session)
    # clock rows have no `added`; a filter on order_id would be pushed below the watermark, which must see them
    return sizing.verdicts(times.where("a IS NOT NULL"), timeout_seconds)


def clock(spark: SparkSession, path: str) -> DataFrame:
    """The clock rows in a folder, as a stream."""
    spark.createDataFrame([], CLOCK).write.mode("ignore").parquet(path)
    return spark.readStream.schema(CLOCK).parquet(path)


def drained(stream: DataFrame, name: str, clock_path: str | None = None, until: str = "9999-01-01 00:00:00") -> DataFrame:
    """Runs the stream over what is there now, exactly once, into a table of the shared folder. With a clock, time then
    moves on to `until`, in a second run of the same query: what is still open is due."""
    spark = stream.sparkSession
    path, state = files.shared_path(spark, name), files.shared_path(spark, f"{name}-state")

    def run() -> None:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()

    run()
    if clock_path is not None:
        spark.sql(f"SELECT CAST(NULL AS BIGINT) AS order_id, CAST(NULL AS STRING) AS kind, TIMESTAMP '{until}' AS ts").write.mode("append").parquet(clock_path)
        run()
    return spark.read.schema(stream.schema).parquet(path)
