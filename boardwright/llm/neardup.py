"""Near-duplicate records by circulant MinHash, banding and exact Jaccard verification (problem 4).

One permutation scrambles the hashed shingles; a second one, circularly shifted, gives all signature coordinates: the k-th
is the minimum of pi[(x + k) mod D] over the shingles x, so the coordinates of a shingle lie side by side in pi.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.llm.hashing import WordHashes
from boardwright.session import cut, release

#: Size of the universe that both permutations act on.
D = 1 << 16


class Circulant:
    """Signatures from the two permutations of a seed: bands of `rows` coordinates, each `stride` after the one before it.

    Bands that overlap by a few coordinates find nearly as much as the same number of separate ones.
    """

    def __init__(self, bands: int, rows: int, seed: int = 7, stride: int | None = None):
        self.bands, self.rows, self.stride, self.first = bands, rows, stride or rows, 0
        rng = np.random.default_rng(seed)
        self.sigma = rng.permutation(D)
        pi = rng.permutation(D).astype(np.uint16)
        k = (bands - 1) * self.stride + rows
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)
        self.mix = rng.integers(1, 2**63, size=rows, dtype=np.uint64) | np.uint64(1)

    def part(self, first: int, bands: int) -> Circulant:
        """Only `bands` bands from the first-th on; their keys are the same."""
        out = copy.copy(self)
        out.first, out.bands = first, bands
        out.windows = self.windows[:, first * self.stride : (first + bands - 1) * self.stride + self.rows]
        return out

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least coordinates over all shingles; repeated ones change nothing."""
        x = self.sigma[(hashes & np.uint64(D - 1)).astype(np.int64)]
        low = self.windows[x[:256]].min(0)
        for at in range(256, len(x), 256):  # long texts, a block of shingles at a time
            low = np.minimum(low, self.windows[x[at : at + 256]].min(0))
        return low

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key per band of every signature: its coordinates, mixed with the number of the band."""
        key = np.arange(self.first, self.first + self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(signatures), 1), np.uint64)
        for k in range(self.rows):
            key += signatures[:, k : k + (self.bands - 1) * self.stride + 1 : self.stride].astype(np.uint64) * self.mix[k]
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xD6E8FEB86659FD93)
        return key ^ (key >> np.uint64(32))


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that begin at each place, as far as there are so many."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def shingles_of_texts(texts: list[str], size: int, known: WordHashes) -> list[np.ndarray]:
    """Hashes of the `size`-word sequences of each text, repeats and all; of fewer words than that, of all its words."""
    words = [known.words(t) for t in texts]
    h = known.of([w for ws in words for w in ws])
    whole = _shingles(h, size)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        out.append(whole[at : at + n - size + 1] if n >= size else _shingles(h[at : at + n], n) if n else whole[:0])
        at += n
    return out


def shingle_hashes(text: str, size: int, known: WordHashes) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(shingles_of_texts([text], size, known)[0])


#: Entries of one bucket partition, 16 bytes each while they are sorted.
PARTITION_ENTRIES = 6_000_000
#: Band keys of more entries are matched some bands at a time, so that only these lie on disk.
PASS_ENTRIES, PASS_BANDS = 24_000_000, 80
#: Texts and bytes of a stored batch; a text's id is its batch's plus its place there, which two bytes hold.
BATCH_TEXTS, BATCH_BYTES = 16_384, 16_000_000
#: Texts of one task that hold each text once.
TASK_TEXTS = 500_000
#: Text hashes up to so many (8 MB) may be broadcast; their number is counted first, and more are joined by a shuffle.
BROADCAST_REPS = 1_000_000
#: Texts of one bucket whose pairs one task may list; a larger bucket is cut into blocks whose pairings are spread.
BUCKET_TEXTS = 2_000
_SEEN, _RECENT = 200_000, 20_000


def _shingler(size: int):
    """(rep, places): each text's places in the universe of the permutations, two bytes a shingle."""

    def run(batches):
        known, seen = WordHashes(), set()
        for batch in batches:
            todo = []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rep in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(rep)
                todo.append((rep, text))
            reps, places = [], []
            for at in range(0, len(todo), 256):
                some = todo[at : at + 256]
                for (rep, _), hashes in zip(some, shingles_of_texts([t for _, t in some], size, known)):
                    if len(hashes):
                        x = hashes.astype(np.uint16)
                        reps.append(rep)
                        places.append((x if len(x) < 1024 else np.unique(x)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(places, pa.binary())], names=["rep", "places"])

    return run


def _batcher(batches):
    """(id, reps, lengths, places): each text once, many a row; equal texts come to one task."""
    first, seen, reps, places, size = TaskContext.get().partitionId() << 40, set(), [], [], 0

    def emit():
        nonlocal first, size
        lengths = np.array([len(x) // 2 for x in places], np.int32)
        row = [pa.array([first], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array(reps, np.int64).tobytes(), lengths.tobytes(), b"".join(places)))]
        reps.clear(), places.clear()
        first, size = first + (1 << 16), 0
        return pa.RecordBatch.from_arrays(row, names=["id", "reps", "lengths", "places"])

    for batch in batches:
        for rep, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if rep not in seen:
                seen.add(rep)
                reps.append(rep)
                places.append(x)
                size += len(x)
                if len(reps) >= BATCH_TEXTS or size >= BATCH_BYTES:
                    yield emit()
    if reps:
        yield emit()


def _id_batches(batches):
    """(id, rep) of the texts of stored batches."""
    for batch in batches:
        for first, reps in zip(batch.column("id").to_pylist(), batch.column("reps").to_pylist()):
            rep = np.frombuffer(reps, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(rep))), pa.array(rep)], names=["id", "rep"])


def _layout(texts: int, bands: int, tasks: int) -> tuple[int, int, int]:
    """(partitions, how many share a band, bytes of a key): whole bands share a partition, or partitions share a band by the key.

    Keys keep as many bytes that texts which meet by chance are fewer than the texts.
    """
    if texts <= PARTITION_ENTRIES:
        parts, split = max(min(tasks, bands), -(-bands // (PARTITION_ENTRIES // texts))), 1
    else:
        split = -(-max(tasks, -(-texts * bands // PARTITION_ENTRIES)) // bands)
        parts = bands * split
    return parts, split, min(6, max(4, math.ceil((2 + math.log2(texts * bands / split)) / 8)))


def _signer(c: tuple[int, int, int], first: int, bands: int, parts: int, split: int, width: int):
    """Rows (part, blob): per stored batch and bucket partition the batch's id and, text by text, `width` bytes of each band key;
    where partitions share a band, each after the two bytes of its text's place in the batch."""

    def run(batches):
        circulant = Circulant(c[0], c[1], stride=c[2]).part(first, bands)
        band = np.arange(bands)
        for batch in batches:
            for id_, lengths, places in zip(*(batch.column(x).to_pylist() for x in ("id", "lengths", "places"))):
                ends = np.cumsum(np.frombuffer(lengths, np.int32))
                x = np.frombuffer(places, np.uint16)
                k = circulant.band_keys(np.array([circulant.signature(x[e - n : e]) for e, n in zip(ends, np.frombuffer(lengths, np.int32))]))
                raw = np.ascontiguousarray(k).view(np.uint8).reshape(len(ends), bands, 8)[:, :, :width]
                head = np.array([id_, len(ends)], np.int64).tobytes()
                if split == 1:
                    found, blobs = list(range(parts)), [head + raw[:, p::parts].tobytes() for p in range(parts)]
                else:
                    part = (band * split + ((k >> np.uint64(48)) % np.uint64(split)).astype(np.int64)).ravel()
                    order = np.argsort(part, kind="stable")
                    edge = np.nonzero(np.diff(part[order], prepend=-1, append=-1))[0]
                    place, raw = (order // bands).astype(np.uint16), raw.reshape(-1, width)[order]
                    found = part[order[edge[:-1]]].tolist()
                    blobs = [head + place[i:j].tobytes() + raw[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return run


def _pair_batches(blocks):
    """Batches of the pairs of (left, right) blocks of sorted text hashes, or of one block with itself, row by row."""
    a, b, waiting = [], [], 0

    def emit():
        x, y = np.concatenate(a), np.concatenate(b)
        a.clear(), b.clear()
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])

    for left, right in blocks:
        for k in range(len(left)):
            other = left[k + 1 :] if right is None else right
            if len(other):
                a.append(np.full(len(other), left[k]))
                b.append(other)
                waiting += len(other)
            if waiting > 500_000:
                yield emit()
                waiting = 0
    if a:
        yield emit()


def _pairer(pass_: int, split: int, width: int):
    """Pairs (rep_a, rep_b) of ids of texts that share a band key, from all blobs of one bucket partition; of buckets over
    BUCKET_TEXTS the members (rep_a) with the bucket and the number of its blocks."""

    def run(batches):
        reps, keys, part = [], [], 0
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                first, m = np.frombuffer(blob, np.int64, 2).tolist()
                if split == 1:
                    raw = np.frombuffer(blob, np.uint8, offset=16).reshape(-1, width)
                    cols = len(raw) // m
                    place, band = np.repeat(np.arange(m), cols), np.tile(np.arange(cols, dtype=np.uint64), m)
                else:
                    n = (len(blob) - 16) // (2 + width)
                    raw = np.frombuffer(blob, np.uint8, offset=16 + 2 * n).reshape(-1, width)
                    place, band = np.frombuffer(blob, np.uint16, n, 16).astype(np.int64), np.uint64(0)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :width] = raw
                reps.append(first + place)
                keys.append(wide.view(np.uint64).ravel() | band << np.uint64(8 * width))
                part = p
        if not reps:
            return
        rep, key = np.concatenate(reps), np.concatenate(keys)
        del reps, keys
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        # most keys stand alone: only the others go on
        met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        rep, key = rep[order[met]], key[met]
        order = np.lexsort((rep, key))
        rep, key = rep[order], key[order]
        if not len(key):
            return
        edge = np.nonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))[0]
        size = np.diff(edge)
        names = ["rep_a", "rep_b", "bucket", "blocks"]
        none = lambda n, t: pa.nulls(n, t)
        for x, y in _pair_batches((rep[edge[i] : edge[i + 1]], None) for i in np.nonzero((size > 1) & (size <= BUCKET_TEXTS))[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), none(len(x), pa.string()), none(len(x), pa.int32())], names=names)
        for i in np.nonzero(size > BUCKET_TEXTS)[0]:
            members = rep[edge[i] : edge[i + 1]]
            blocks = -(-len(members) // BUCKET_TEXTS)
            yield pa.RecordBatch.from_arrays([pa.array(members), none(len(members), pa.int64()), pa.array([f"{pass_}:{part}:{key[edge[i]]}"] * len(members)), pa.array(np.full(len(members), blocks, np.int32))], names=names)

    return run


def _cell_batches(batches):
    """Pairs of the texts of two blocks of a bucket; rows come sorted by cell (bucket, i, j) and hold a text and its block."""
    cell, mine = None, {}

    def pairs():
        if cell is None:
            return
        i, j = cell[1:]
        left = np.array(mine.get(i, []), np.int64)
        right = None if i == j else np.array(mine.get(j, []), np.int64)
        for x, y in _pair_batches([(left, right)]):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["rep_a", "rep_b"])

    for batch in batches:
        for bucket, i, j, block, rep in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if (bucket, i, j) != cell:
                yield from pairs()
                cell, mine = (bucket, i, j), {}
            mine.setdefault(block, []).append(rep)
    yield from pairs()


def _spread(hot: DataFrame) -> DataFrame:
    """(rep_a, rep_b): all pairs of the texts of large buckets, each pairing of two blocks a cell of bounded size."""
    block = F.pmod(F.xxhash64("rep_a"), F.col("blocks")).cast("int")
    cells = hot.select("bucket", block.alias("block"), F.col("rep_a").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
    tasks = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_cell_batches, "rep_a bigint, rep_b bigint")


def _verifier(size: int, threshold: float):
    """Exact Jaccard similarity of the two texts of each row."""

    def run(batches):
        known = WordHashes()
        recent: dict[int, np.ndarray] = {}

        def hashes(rep, text):
            if rep not in recent:
                if len(recent) > _RECENT:
                    recent.clear()
                recent[rep] = shingle_hashes(text, size, known)
            return recent[rep]

        for batch in batches:
            ra, rb, sim = [], [], []
            for x, y, s, t in zip(*(batch.column(k).to_pylist() for k in ("rep_a", "rep_b", "text_a", "text_b"))):
                u, v = hashes(x, s), hashes(y, t)
                if min(len(u), len(v)) < threshold * max(len(u), len(v)):
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                j = both / (len(u) + len(v) - both)
                if j >= threshold:
                    ra.append(x), rb.append(y), sim.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(ra, pa.int64()), pa.array(rb, pa.int64()), pa.array(sim, pa.float64())], names=["rep_a", "rep_b", "similarity"])

    return run


def joined_text(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


class NearDuplicates:
    """`members`: (key, rep), one row per key and text; `links`: (rep_a, rep_b, similarity) between different texts."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def key_pairs(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b, of all keys that share a text or have linked texts."""
        m = self.members
        sides = self.links.select("rep_a", "rep_b").unionByName(m.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct())
        a, b = m.select(F.col("key").alias("ka"), F.col("rep").alias("rep_a")), m.select(F.col("key").alias("kb"), F.col("rep").alias("rep_b"))
        return sides.join(a, "rep_a").join(b, "rep_b").where("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def near_duplicates(
    df: DataFrame, key: str, columns: list[str], shingle: int = 5, threshold: float = 0.8, bands: int = 64, rows: int = 7, stride: int | None = None
) -> NearDuplicates:
    """Texts whose sets of `shingle`-word sequences have a Jaccard similarity of at least `threshold`.

    Equal texts are one from the start (`rep`, a 64-bit hash), so copies cost nothing later, however many. Their shingles
    are stored, two bytes each. Texts that share a band are candidates; every candidate is verified by its exact shingle
    sets. Band keys travel packed, four to seven bytes each, some bands at a time, whose files go before the next ones
    come, and are matched in as many partitions as bounded memory needs; the pairs of a large bucket are spread over
    tasks. Texts without words match nothing;
    texts of fewer words than a shingle match by all their words. NULL keys don't count, NULL columns are blank. Chance
    to miss a pair of similarity s: (1 - s^rows)^bands, a little more where bands overlap (stride < rows).
    """
    spark = df.sparkSession
    text = joined_text(columns)
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("rep"), text.alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    members = texts.select("key", "rep").distinct()
    n = max(2, df.count())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = texts.select("rep", "text").mapInArrow(_shingler(shingle), "rep bigint, places binary")
    stored = cut(hashed.repartition(max(tasks, -(-n // TASK_TEXTS)), "rep").mapInArrow(_batcher, "id bigint, reps binary, lengths binary, places binary"), drop=True)
    at_once, met = bands if n * bands <= PASS_ENTRIES else PASS_BANDS, None
    for first in range(0, bands, at_once):
        some = min(at_once, bands - first)
        parts, split, width = _layout(n, some, tasks)
        blobs = stored.mapInArrow(_signer((bands, rows, stride or rows), first, some, parts, split, width), "part int, blob binary")
        pairs = blobs.repartitionById(parts, "part").mapInArrow(_pairer(first, split, width), "rep_a bigint, rep_b bigint, bucket string, blocks int")
        found = cut(pairs.distinct(), drop=True)
        met = found if met is None else met.unionByName(found)
    candidates, hot = met.where("bucket IS NULL").select("rep_a", "rep_b"), met.where("bucket IS NOT NULL")
    if not hot.isEmpty():
        candidates = candidates.unionByName(_spread(hot))
    ids = stored.mapInArrow(_id_batches, "id bigint, rep bigint")
    candidates = candidates.distinct()
    for side in ("rep_a", "rep_b"):
        candidates = candidates.join(ids.withColumnRenamed("id", side), side).drop(side).withColumnRenamed("rep", side)
    candidates = cut(candidates, drop=True)
    del hashed, stored, blobs, pairs, found, met, hot, ids  # the shingles are done with
    release(spark)
    needed = cut(candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct(), drop=True)
    few = needed.limit(BROADCAST_REPS + 1).count() <= BROADCAST_REPS
    one_each = texts.select("rep", "text").join(F.broadcast(needed) if few else needed, "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))
    sides = candidates.join(one_each.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a")), "rep_a").join(one_each.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")
    verified = sides.mapInArrow(_verifier(shingle, threshold), "rep_a bigint, rep_b bigint, similarity double")
    return NearDuplicates(members, verified)


JOB_COLUMNS = ["title", "company", "location", "body"]


def relisted_jobs(jobs: DataFrame) -> NearDuplicates:
    """Listings of one opening: at least half of their three-word sequences in common."""
    return near_duplicates(jobs, "url", JOB_COLUMNS, shingle=3, threshold=0.5, bands=320, rows=7, stride=4)


def classes(found: NearDuplicates) -> DataFrame:
    """(key, class_id, links): one row per key, the smallest key that links lead to, and its number of links to other texts.

    Labels are the smallest key of a text with that text's hash, so pointers can be followed; copies stay one text.
    """
    named = cut(found.members.groupBy("rep").agg(F.min("key").alias("key")))
    links = cut(found.links.select("rep_a", "rep_b"))
    both = cut(links.unionByName(links.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b"))))
    degree = both.groupBy(F.col("rep_a").alias("rep")).agg(F.count("*").alias("links"))
    labels = cut(named.join(degree.select("rep"), "rep").select("rep", F.struct("key", "rep").alias("label")))
    while True:  # labels only fall, and jumps halve the way
        near = both.join(labels.select(F.col("rep").alias("rep_b"), "label"), "rep_b").groupBy(F.col("rep_a").alias("rep")).agg(F.min("label").alias("near"))
        step = labels.join(near, "rep").select("rep", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        # pointer jumping: the label of the label
        far = step.select(F.col("rep").alias("at"), F.col("label").alias("far"))
        jump = cut(step.withColumn("at", F.col("label.rep")).join(far, "at").select("rep", F.least("label", "far").alias("label"), "old"))
        labels = jump.select("rep", "label")
        if jump.where("label <> old").isEmpty():
            break
    of = named.join(labels, "rep", "left").join(degree, "rep", "left").select("rep", F.coalesce("label.key", "key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return found.members.join(of, "rep").select("key", "class_id", "links")
