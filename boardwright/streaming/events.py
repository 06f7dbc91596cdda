"""Structured Streaming over the events feed: windows, sessions, deduplication and keyed upserts.

Each job drains what is there (availableNow) into a table in the session's shared folder, so a run can be repeated from
its checkpoint and no state stays on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwright.session import ensure_checkpoint_dir

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str, name: str = "events", schema: str | None = None, per_trigger: int = 8) -> DataFrame:
    """The table as a stream of files, whether it is one file or a folder of files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    p = hadoop(f"{sf_dir}/{name}.parquet")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    read = spark.readStream.schema(schema or spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).option("maxFilesPerTrigger", per_trigger)
    if fs.getFileStatus(p).isFile():
        return read.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return read.parquet(f"{sf_dir}/{name}.parquet")


def drain(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream to its end and return its table. complete: each batch replaces the table; update: rows of a later
    batch replace those of the same key; append: the rows as written."""
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"
    if mode == "append":
        q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n:09d}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out).drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("__batch").alias("__last"))
        return rows.join(F.broadcast(last), F.col("__batch") == F.col("__last")).drop("__batch", "__last")
    cols = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "__batch").alias("s")).select(*keys, "s.*")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Without a watermark, which would drop the rows of a backlog whose files aren't ordered by time: its state keeps every session."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key over the whole stream, in whatever order its files come: its state keeps every key."""
    return events.dropDuplicates(keys)


def heartbeats(events: DataFrame) -> DataFrame:
    """(user_id, first_seen, last_seen, n): the clocks of every key, as a running state."""
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
