"""An extension: the panel over a stream of events, and first-wins rows of an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as a stream; the schema is that of the events table."""
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(path)


def windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) over event time; rows later than the watermark drop out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_wins(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, as in a log that is written again after a stop."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: State is kept beside the heap, on the executors' disks, so that it may outgrow them.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What the stream gives for what is there now, as files beside its checkpoint: no row goes through the driver. A batch that is
    run again replaces its own files; of a complete result the last batch's count."""
    spark, written = stream.sparkSession, []

    def put(rows: DataFrame, batch: int) -> None:
        path = f"{checkpoint}-rows/{batch}"
        rows.write.mode("overwrite").parquet(path)
        written.append(path)

    before = spark.conf.get(*STATE[:1], None)
    spark.conf.set(*STATE)
    try:  # a query keeps the settings that it was started with
        q = stream.writeStream.foreachBatch(put).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE[0]) if before is None else spark.conf.set(STATE[0], before)
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(written[-1:] if mode == "complete" else written))
