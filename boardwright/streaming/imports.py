"""Snapshots that arrive as files, merged into the stored pool as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwright.operators import intake, pool
from boardwright.schema import JOBS, RAW
from boardwright.session import cut

#: Parts of the store by the hash of the url; a batch reads and writes only the parts that its listings fall into.
PARTS = 64


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).drop("part")


def merge_batch(spark: SparkSession, batch: DataFrame, store: str, now: str, seq: int = 0, parts: int = PARTS) -> None:
    """Merge raw rows into the store: only parts that the rows fall into are read and replaced, each as a whole. The merged
    rows stand in the shared folder before the old parts go, and merging them again changes nothing."""
    at = F.to_timestamp(F.lit(now))
    part = F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int")
    rows = intake.normalise(batch, at)
    rows = cut(rows.where(pool.reject_reason(direct_only=False).isNull()).withColumn("seq", F.lit(seq)).withColumn("part", part))
    touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most `parts`
    if not touched:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    path = hadoop(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.parquet(store).where(F.col("part").isin(touched)).drop("part") if there else spark.createDataFrame([], JOBS)
    merged = cut(pool.upsert(stored, rows.drop("part"), "url", "fetched_at", "last_seen", at).withColumn("part", part))
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(store)


def import_snapshots(spark: SparkSession, folder: str, store: str, state: str, now: str, every: str | None = None, parts: int = PARTS) -> None:
    """Merge the line files of `folder` that weren't merged before into the table `store`; the checkpoint remembers files,
    and a batch that failed is merged again. With `every` (such as `900 seconds`) the import goes on at that interval, else it
    ends when all files are merged."""
    lines = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 64).json(folder)
    writer = lines.writeStream.foreachBatch(lambda batch, n: merge_batch(spark, batch, store, now, n, parts)).option("checkpointLocation", state)
    (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start().awaitTermination()
