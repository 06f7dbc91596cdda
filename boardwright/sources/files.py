"""Readers and writers: snapshots of JSON, logs, CSV, and tables replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SnapshotError(ValueError):
    pass


def read_snapshot(spark: SparkSession, path: str, row_schema: T.StructType) -> DataFrame:
    """The rows of a one-document snapshot {meta, jobs: [...]}, whatever the order of its keys.

    A document that is cut off, or whose `jobs` is missing or no array, raises; an empty array gives no rows. One document
    is one task; write_snapshot splits large snapshots into line files, which read_lines reads in parallel.
    """
    probe = spark.read.schema("jobs string, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True, mode="PERMISSIVE").cache()
    head = probe.select(F.col("jobs").isNull().alias("missing"), (F.substring(F.ltrim("jobs"), 1, 1) != "[").alias("odd"), F.col("_corrupt_record").isNotNull().alias("bad")).take(1)
    probe.unpersist()
    if not head or head[0]["bad"] or head[0]["missing"] or head[0]["odd"]:
        raise SnapshotError(f"{path}: no readable array of jobs")
    return spark.read.schema(T.StructType([T.StructField("jobs", T.ArrayType(row_schema))])).json(path, multiLine=True, mode="FAILFAST").select(F.inline("jobs"))


def read_meta(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The `meta` object of a snapshot: only its columns are parsed."""
    return spark.read.schema(f"meta struct<{schema}>").json(path, multiLine=True).select("meta.*")


_META: dict[tuple, list] = {}


def cached_meta(spark: SparkSession, path: str, schema: str) -> dict | None:
    """The `meta` of a snapshot as a dict, read again only when the file has changed; the last 64 files are remembered."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    state = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    key = (path, state.getModificationTime(), state.getLen(), schema)
    if key not in _META:
        if len(_META) >= 64:
            _META.pop(next(iter(_META)))
        _META[key] = read_meta(spark, path, schema).take(1)
    return _META[key][0].asDict(recursive=True) if _META[key] else None


def read_files(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """A table from an explicit list of Parquet files; an empty list raises, as it would read nothing by mistake."""
    if not paths:
        raise SnapshotError("no files to read")
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def read_cases(spark: SparkSession, folder: str, schema: str, limit: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """Cases from a folder of JSON documents with an `id`, in its order; the named ones, or the first `limit`."""
    df = spark.read.schema(schema).json(folder, multiLine=True, mode="FAILFAST")
    df = df.where(F.col("id").isin(*ids)) if ids is not None else df
    df = df.orderBy("id")
    return df.limit(limit) if limit is not None else df


def recent_lines(spark: SparkSession, path: str, schema: str, at: str, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines since a time, one row with the number of unreadable lines) of a log."""
    rows = read_lines(spark, path, schema)
    good = rows.where("_corrupt_record IS NULL").drop("_corrupt_record")
    bad = spark.read.text(path).where("trim(value) <> ''").agg(F.count("*").alias("lines")).crossJoin(rows.select(*[c for c in rows.columns if c != "_corrupt_record"], "_corrupt_record").where("_corrupt_record IS NULL").agg(F.count(at).alias("good"))).select((F.col("lines") - F.col("good")).alias("unreadable"))
    return (good.where(F.col(at) >= F.lit(since)) if since is not None else good), bad


def read_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines, plain or compressed (told by the suffix); bad lines raise if strict, else stay in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_partitions(spark: SparkSession, root: str, column: str, values: list[str]) -> DataFrame:
    """Only the named partitions of a table laid out as column=value."""
    return spark.read.option("basePath", root).parquet(*[f"{root}/{column}={v}" for v in values])


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside and swap names: the new table is complete before the old one moves; a table may be made from itself.

    Between the two renames a reader may find no table, as file systems replace no folder in one step; readers that can't
    wait go through `current_table`. A rename that fails raises, puts the old table back and keeps both.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(hadoop(path))
    if had and not fs.rename(hadoop(path), hadoop(old)):
        raise OSError(f"{path}: the old table could not be moved; the new one is {new}")
    if not fs.rename(hadoop(new), hadoop(path)):
        if had and not fs.rename(hadoop(old), hadoop(path)):
            raise OSError(f"{path}: neither table could be moved back; they are {old} and {new}")
        raise OSError(f"{path}: the new table could not be moved; it is {new}")
    if had:
        fs.delete(hadoop(old), True)


def publish_table(df: DataFrame, path: str) -> str:
    """Write a version of its own below `path` and then point to it with one small file, written beside and renamed over the
    old pointer; readers of current_table see the old version or the new one, never neither. Gives the version's folder."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), conf)
    beside, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f"current.{version}", "current"))
    out = beside.getFileSystem(conf).create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, pointer, options)
    return f"{path}/{version}"


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The version that publish_table pointed to last."""
    version = spark.read.text(f"{path}/current", wholetext=True).first()[0].strip()
    return spark.read.parquet(f"{path}/{version}")


def rotate_log(spark: SparkSession, path: str, most_bytes: int = 32 << 20) -> bool:
    """Move a log of at least most_bytes aside, over the one moved before; whether it was moved. A log that isn't there stays so."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)) or fs.getContentSummary(hadoop(path)).getLength() < most_bytes:
        return False
    fs.delete(hadoop(f"{path}.1"), True)
    if not fs.rename(hadoop(path), hadoop(f"{path}.1")):
        raise OSError(f"{path}: the log could not be moved")
    return True


def append_log(df: DataFrame, path: str, most_bytes: int = 4096, trim: str = "top", rotate_bytes: int = 32 << 20) -> None:
    """Append JSON lines of at most most_bytes: the list `trim` loses items from its end until a line fits, else the line drops.
    A log of rotate_bytes is moved aside first."""
    rotate_log(df.sparkSession, path, rotate_bytes)
    others = [c for c in df.columns if c != trim]
    line = lambda n: F.to_json(F.struct(*others, F.slice(trim, F.lit(1), n).alias(trim)))
    fits = F.filter(F.sequence(F.lit(0), F.size(trim)), lambda n: F.octet_length(line(n)) < most_bytes)
    df.withColumn("__n", F.array_max(fits)).where("__n IS NOT NULL").select(F.to_json(F.struct(*others, F.slice(trim, F.lit(1), F.col("__n")).alias(trim))).alias("value")).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def carry_forward(old: DataFrame, new_schema: T.StructType) -> DataFrame:
    """Old rows in a new schema: common columns cast, others NULL."""
    have = set(old.columns)
    return old.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in new_schema.fields])


def read_list(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """The items of the array `field` of a JSON document, of the struct `item`; raises when it is missing or no array.
    Items that are NULL drop; the caller filters those without the parts it needs."""
    raw = spark.read.schema(f"`{field}` string").json(path, multiLine=True).take(1)
    if not raw or not (raw[0][0] or "").lstrip().startswith("["):
        raise SnapshotError(f"{path}: no array {field}")
    return spark.read.schema(f"`{field}` array<struct<{item}>>").json(path, multiLine=True).select(F.inline(F.filter(field, lambda x: x.isNotNull())))


def write_report(df: DataFrame, path: str) -> None:
    """A result as JSON lines in place of what stood there."""
    df.write.mode("overwrite").json(path)
