"""Stored tables that must not be mixed up: guards of their model and schema, vectors kept in step with the pool, and the
order of nightly upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwright.operators import gates, intake, pool


class Mixed(RuntimeError):
    """A store holds what another model or version made."""


def vectors_of(vectors: DataFrame, meta: DataFrame, model: str) -> DataFrame:
    """The vectors, if the store's notes say that `model` made them; a store without a note is an empty one or raises."""
    said = gates.meta_value(meta, "model")
    if said is None and not vectors.isEmpty():
        raise Mixed("the store holds vectors but no note of their model")
    if said is not None and said != model:
        raise Mixed(f"the store holds vectors of {said}, not of {model}")
    return vectors


def available(vectors: DataFrame | None) -> bool:
    """Whether a dense arm can answer: there is a store and it isn't empty; a store that can't be read has no arm."""
    try:
        return vectors is not None and not vectors.isEmpty()
    except Exception:  # noqa: BLE001 - whatever keeps it from being read
        return False


def check_schema(stored: T.StructType, wanted: T.StructType, version: int, meta_version: str | None) -> None:
    """Raises unless a store has every wanted column in its type and was written by this version or an older one."""
    have = {f.name: f.dataType for f in stored.fields}
    lacks = [f.name for f in wanted.fields if have.get(f.name) != f.dataType]
    if lacks:
        raise Mixed("columns missing or of another type: " + ", ".join(lacks))
    if meta_version is not None and int(meta_version) > version:
        raise Mixed(f"the store was written by version {meta_version}, this is {version}")


def apply_sync(vectors: DataFrame, plan: DataFrame, fresh: DataFrame, key: str, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """The store after a sync plan (key, action): gone keys drop, new and changed ones take their row from `fresh`, of which
    `limit` keys are done, the smallest first; the others stay as they are. A dry run gives the store back."""
    if dry_run:
        return vectors
    todo = plan.where(F.col("action").isin("new", "changed")).select(key)
    if limit is not None:
        todo = todo.orderBy(key).limit(limit)
    gone = plan.where("action = 'gone'").select(key)
    return vectors.join(gone.unionByName(todo).distinct(), key, "left_anti").unionByName(fresh.select(*vectors.columns).join(todo, key, "left_semi"))


def upkeep(jobs: DataFrame, statuses: DataFrame, now: Column, polled: Sequence[str], **limits) -> DataFrame:
    """Nightly upkeep in the order that matters: probed listings are refreshed or dropped first, then eviction looks at the
    clocks, so that a listing which just answered isn't evicted as unseen."""
    return pool.survivors(intake.liveness(jobs, statuses, now), now, polled, **limits)
