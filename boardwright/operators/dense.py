"""Dense retrieval over stored embeddings, and rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwright.functions.text import html_plain
from boardwright.session import collect_bounded

RRF_K = 60
PROBE_DEPTH = 200
#: Probes are searched in blocks of about so many; a block that comes out larger than MAX_PROBES raises.
PROBE_BLOCK, MAX_PROBES = 500, 10_000


def _unit(a: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n == 0, 1, n)


def _top_batches(blob, depth: int):
    """Per partition the best `depth` vectors of every probe: a matrix product per batch, then a partial sort."""

    def run(batches):
        names, q = blob.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            col = batch.column(1)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if not len(ids):
                continue
            sims = _unit(flat.reshape(len(ids), -1)) @ q.T
            for k in range(len(names)):
                s, i = np.concatenate([best[k][0], sims[:, k]]), np.concatenate([best[k][1], ids])
                # rounded as in the final order, so equal vectors are cut by id here too
                r = np.round(s, 9)
                if len(r) > depth:
                    at = np.flatnonzero(r >= np.partition(r, -depth)[-depth])
                    s, i, r = s[at], i[at], r[at]
                order = np.lexsort((i, -r))[:depth]
                best[k] = (s[order], i[order])
        for k, name in enumerate(names):
            if len(best[k][0]):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(best[k][0]), pa.int64()), pa.array(best[k][1]), pa.array(best[k][0])], names=["probe", "id", "sim"])

    return run


def top_per_probe(vectors: DataFrame, id_: str, vector: str, probes: DataFrame, probe_id: str, probe_vector: str, depth: int = PROBE_DEPTH) -> DataFrame:
    """(probe, id, sim, rank0): the `depth` most similar vectors of every probe by cosine, ties by id, rank from 0.

    NULL and empty vectors match nothing. Probes are searched in blocks, however many there are; in a block every
    partition sends at most depth rows a probe, and the exact order is made over these.
    """
    asked = probes.where(F.size(probe_vector) > 0).select(F.col(probe_id).cast("bigint").alias("probe"), F.col(probe_vector).alias("v"))
    blocks = -(-asked.count() // PROBE_BLOCK)
    spark = vectors.sparkSession
    schema = "probe bigint, id bigint, sim double"
    near = None
    for k in range(blocks):
        rows = collect_bounded(asked.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == k), MAX_PROBES, "probes of a block")
        for size in sorted({len(r[1]) for r in rows}):
            same = [r for r in rows if len(r[1]) == size]
            blob = spark.sparkContext.broadcast(([r[0] for r in same], _unit(np.array([r[1] for r in same], dtype=np.float64))))
            got = vectors.where(F.size(vector) == size).select(F.col(id_).cast("bigint"), F.col(vector)).mapInArrow(_top_batches(blob, depth), schema)
            near = got if near is None else near.unionByName(got)
    if near is None:
        return spark.createDataFrame([], schema + ", rank0 int")
    w = Window.partitionBy("probe").orderBy(F.desc(F.round("sim", 9)), "id")
    return near.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < depth)


def fuse(ranked: DataFrame, id_: str, rank0: str = "rank0", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: (id, rrf) over all lists that name an id."""
    return ranked.groupBy(id_).agg(F.sum(1.0 / (k + F.col(rank0))).alias("rrf"))


def hybrid(lexical: DataFrame, dense: DataFrame, id_: str, group: Column | None, k: int, per_group: int = 3, groups: DataFrame | None = None) -> DataFrame:
    """Both arms (id, rank0) fused, at most per_group rows of a group, the first k; an empty arm leaves the other's order.

    `group` is an expression over id and the columns of `groups` (one row an id); NULL groups aren't capped.
    """
    both = fuse(lexical.select(id_, "rank0").unionByName(dense.select(id_, "rank0")), id_)
    if groups is not None:
        both = both.join(groups, id_, "left")
    if group is not None:
        w = Window.partitionBy("__g").orderBy(F.desc(F.round("rrf", 12)), id_)
        both = both.withColumn("__g", group).withColumn("__n", F.row_number().over(w)).where(F.col("__g").isNull() | (F.col("__n") <= per_group)).drop("__g", "__n")
    return both.select(id_, "rrf").orderBy(F.desc(F.round("rrf", 12)), id_).limit(k)


def summary_text(title: str, root: str, qualifiers: str, company: str, team: str, category: str, location: str, tags: str, body: str, chars: int = 1800) -> Column:
    """The text that stands for a listing: header lines from its fields (of qualifiers the first 4), then the start of its body
    without markup (what a vector is made of)."""
    c = lambda n: F.when(F.trim(F.coalesce(F.col(n), F.lit(""))) != "", F.col(n))
    named = lambda label, n: F.concat(F.lit(label), c(n))
    head = F.concat_ws(" · ", c(title), F.when(F.lower(F.col(root)) != F.lower(F.col(title)), c(root)), F.when(F.size(qualifiers) > 0, F.array_join(F.slice(qualifiers, 1, 4), ", ")))
    line = F.concat_ws(" · ", named("Company: ", company), named("Team: ", team), named("Field: ", category), named("Location: ", location))
    tag = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(F.slice(tags, 1, 8), ", ")))
    return F.concat_ws("\n", head, line, tag, F.substring(html_plain(F.col(body)), 1, chars))


def content_id(key: Column, summary: Column) -> Column:
    return F.sha1(F.concat(F.encode(key, "utf-8"), F.lit(b"\x00"), F.encode(summary, "utf-8")))


def probes_from(vectors: DataFrame, id_: str, every: int) -> DataFrame:
    """Every vector whose id is divisible by `every`."""
    return vectors.where(F.col(id_) % every == 0)
