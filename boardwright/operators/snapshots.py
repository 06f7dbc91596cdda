"""Differences between consecutive full deliveries of a table (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as padding around a value.
_PAD = r"^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$"


def trimmed(c: Column) -> Column:
    """Text without padding; NULL as blank."""
    return F.coalesce(F.regexp_replace(c.cast("string"), _PAD, ""), F.lit(""))


def latest_states(
    df: DataFrame,
    number: str,
    key: str,
    version: str,
    compare: Sequence[str],
    fold_case: Sequence[str] = (),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row (snapshot_no, rec_key, row_hash) per delivery and key.

    The row with the latest `version` counts; then the latest tie_break columns, then the larger hash, so the result does
    not depend on row order. NULL versions are oldest. Blank keys and NULL snapshot numbers don't count. max_by combines
    on the map side, so that a key repeated in a third of all rows costs one row a task in the shuffle.
    """
    state = [F.lower(trimmed(F.col(c))) if c in fold_case else trimmed(F.col(c)) for c in compare]
    rows = df.select(
        F.col(number).cast("int").alias("snapshot_no"),
        trimmed(F.col(key)).alias("rec_key"),
        F.xxhash64(*state).alias("row_hash"),
        F.struct(
            F.coalesce(F.col(version).cast("timestamp"), F.to_timestamp(F.lit("0001-01-01"))).alias("v"),
            *[F.coalesce(F.col(c).cast("timestamp"), F.to_timestamp(F.lit("0001-01-01"))).alias(f"t{i}") for i, c in enumerate(tie_break)],
            F.xxhash64(*state).alias("h"),
        ).alias("rank"),
    ).where("rec_key <> '' AND snapshot_no IS NOT NULL")
    return rows.groupBy("snapshot_no", "rec_key").agg(F.max_by("row_hash", "rank").alias("row_hash"))


def snapshot_changes(df: DataFrame, number: str, key: str, version: str, compare: Sequence[str], **kw) -> DataFrame:
    """(snapshot_no, rec_key, change_kind): added, removed or changed against the delivery with the next lower number.

    A full outer join of each delivery with its predecessor on the key, comparing canonical row hashes. Numbers may be
    missing; the first delivery gives no row; an empty table gives none. Only the list of delivery numbers, one row a
    delivery, passes through a single task.
    """
    states = latest_states(df, number, key, version, compare, **kw)
    numbers = df.select(F.col(number).cast("int").alias("snapshot_no")).where("snapshot_no IS NOT NULL").distinct()
    order = Window.orderBy("snapshot_no")
    pairs = numbers.select("snapshot_no", F.lead("snapshot_no").over(order).alias("next_no"), F.lag("snapshot_no").over(order).alias("prev_no"))
    before = states.join(pairs.where("next_no IS NOT NULL").select("snapshot_no", "next_no"), "snapshot_no").select(
        F.col("next_no").alias("snapshot_no"), "rec_key", F.col("row_hash").alias("old_hash")
    )
    after = states.join(pairs.where("prev_no IS NOT NULL").select("snapshot_no"), "snapshot_no", "left_semi").withColumnRenamed("row_hash", "new_hash")
    return (
        after.join(before, ["snapshot_no", "rec_key"], "full_outer")
        .select(
            "snapshot_no",
            "rec_key",
            F.when(F.col("old_hash").isNull(), "added")
            .when(F.col("new_hash").isNull(), "removed")
            .when(F.col("old_hash") != F.col("new_hash"), "changed")
            .alias("change_kind"),
        )
        .where("change_kind IS NOT NULL")
    )


def job_changes(job_snapshots: DataFrame) -> DataFrame:
    return snapshot_changes(job_snapshots, "snapshot_no", "url", "last_seen", ["title", "company", "location", "salary"], tie_break=["loaded_at"])


def company_changes(company_snapshots: DataFrame) -> DataFrame:
    return snapshot_changes(company_snapshots, "snapshot_no", "name_key", "checked_at", ["status"], fold_case=["status"], tie_break=["loaded_at"])


def all_changes(job_snapshots: DataFrame, company_snapshots: DataFrame) -> DataFrame:
    """(dataset, snapshot_no, rec_key, change_kind) of both deliveries."""
    tagged = [d.select(F.lit(n).alias("dataset"), "snapshot_no", "rec_key", "change_kind") for n, d in (("jobs", job_changes(job_snapshots)), ("companies", company_changes(company_snapshots)))]
    return tagged[0].unionByName(tagged[1])
