"""Structured Streaming over event files: windows, sessions, deduplication and change detection by state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.storage import new_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """The event files of a folder as a stream; ts is a timestamp, as watermarks need it."""
    r = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet")
    r = r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return w.select(F.unix_seconds("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """One event of each key that came within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def changes(events: DataFrame, band: float) -> DataFrame:
    """The stream that drain_changes() reads: events with the band of their value; an event without one says nothing."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    return events.select("user_id", "event_type", "ts", "event_id", F.floor(value / band).alias("after")).where("after IS NOT NULL")


def drain_changes(stream: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, before, after): events whose value is in another band than their user's and type's one
    before, over all files there are.

    The last band of each user and type is a table for each epoch, made from the epoch before, so that an epoch that runs
    again leaves the same rows. Within an epoch the one before is found by a sort, which Spark may spill.
    """
    spark = stream.sparkSession
    base, key = new_folder(spark, "changes"), ["user_id", "event_type"]
    schema = stream.schema
    done: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        now = batch.withColumn("fresh", F.lit(True))
        if done:
            now = now.unionByName(spark.read.schema(schema).parquet(f"{base}/last/epoch={done[-1]}").withColumn("fresh", F.lit(False)))
        # What the epochs before have left comes first, whatever its time.
        order = Window.partitionBy(*key).orderBy("fresh", "ts", "event_id")
        told = now.withColumn("before", F.lag("after").over(order)).where("fresh AND before <> after")
        told.select(*key, "event_id", "before", "after").write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
        left = now.groupBy(*key).agg(F.max_by(F.struct("ts", "event_id", "after"), F.struct("fresh", "ts", "event_id")).alias("x")).select(*key, "x.*")
        left.write.mode("overwrite").parquet(f"{base}/last/epoch={epoch}")
        done.append(epoch)

    stream.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    out = "user_id long, event_type string, event_id long, before long, after long"
    return spark.read.schema(out).parquet(*[f"{base}/out/epoch={e}" for e in done]) if done else spark.createDataFrame([], out)


def drain(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over all files there are, writes each epoch under its number, and reads the result.

    In complete mode the last epoch is the result; in append mode all of them are; in update mode the last row of each
    `key`, so that the stream itself may forget what its watermark has passed. Epochs are overwritten, so one that runs
    again leaves the same rows.
    """
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    done: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
        done.append(epoch)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{base}/out/epoch={e}" for e in (done[-1:] if mode == "complete" else done)]
    rows = spark.read.schema(stream.schema).parquet(*paths)
    if mode != "update":
        return rows
    if key is None:
        raise ValueError("an update needs the key of its rows")
    epochs = spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", LongType())])).option("basePath", f"{base}/out").parquet(*paths)
    rest = [c for c in stream.columns if c not in key]
    last = epochs.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("row"))
    return last.select(*[F.col(c) if c in key else F.col(f"row.{c}").alias(c) for c in stream.columns])
