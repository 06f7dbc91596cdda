"""Held-out test passages inside a training corpus (problem 8).

One scan of the corpus, however many test items there are: a bounded bit table of the items' word sequences lets stretches
pass that may stand in an item. Equal stretches are one, shards of them are indexed by suffix arrays over their words, and
every suffix of every test item is binary-searched in them, which gives the longest verbatim match and its place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.llm.hashing import WordHashes
from boardwright.session import collect_bounded, cut

#: Test items are searched in blocks of so many characters; a block is shipped to every task (at most 8 MB).
BLOCK_CHARS = 2_000_000
#: Words of a shard that may go into one suffix array, so that it stays under some 50 MB a task.
SHARD_WORDS = 1_000_000
#: Bits of the table for each sequence of the items; the table ends at MOST_BITS (32 MB), beyond that more stretches pass it.
BITS_EACH, MOST_BITS = 64, 1 << 28
#: Places of matches that are held at once.
MATCHES = 2_000_000

_WORD = re.compile(r"[^\W_]+")
# Ligatures and letters that Unicode does not take apart.
_LETTERS = str.maketrans({"æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def words(text: str) -> list[str]:
    """Runs of letters and digits, without letter case, accents and ligatures; invisible format characters don't part words."""
    if not text.isascii():
        t = unicodedata.normalize("NFKD", text.casefold())
        t = "".join(ch for ch in t if unicodedata.category(ch) not in ("Mn", "Cf", "Me"))
        return _WORD.findall(t.translate(_LETTERS))
    return _WORD.findall(text.lower())


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `seq` in the order of their suffixes, told apart by at least `depth` items (prefix doubling)."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, k = new, 2 * k
        if n and rank[order[-1]] == n - 1:
            break
    return order


def _common(seq: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of seq[at:] and query[start:], up to `limit`."""
    length = np.zeros(len(at), np.int64)
    alive = np.ones(len(at), bool)
    for k in range(limit):
        i, j = at + k, start + k
        alive = alive & (i < len(seq)) & (j < len(query))
        same = np.zeros(len(at), bool)
        same[alive] = seq[i[alive]] == query[j[alive]]
        alive = alive & same
        if not alive.any():
            break
        length += alive
    return length


def _bound(seq, order, query, starts, words_, right: bool):
    """Binary search of all query suffixes at once, by their first `words_` items: first place not less (or greater)."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        go = lo < hi
        at = order[np.minimum(mid, len(order) - 1)]
        same = _common(seq, at, query, starts, words_)
        i, j = at + same, starts + same
        full = same >= words_
        a = np.where(i < len(seq), seq[np.minimum(i, len(seq) - 1)], -9)
        less = np.where(full, right, a < query[np.minimum(j, len(query) - 1)])
        lo = np.where(go & less, mid + 1, lo)
        hi = np.where(go & ~less, mid, hi)
    return lo


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each place on."""
    k = max(0, len(h) - n + 1)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _probes(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (gram & np.uint64(bits - 1)).astype(np.int64), ((gram >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _bit_batches(least: int, bits: int):
    def run(batches):
        hashed = WordHashes(words)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = np.unique(np.concatenate(_probes(gram_hashes(hashed(text), least), bits)))
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["bit"])

    return run


def bit_table(items: DataFrame, least: int) -> np.ndarray:
    """Bytes of the table: two bits for every sequence of `least` words of an item."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = 1 << 15
    while bits < min(MOST_BITS, total // 4 * BITS_EACH):
        bits *= 2
    one = F.col("bit") + 1
    got = items.select("text").mapInArrow(_bit_batches(least, bits), "bit bigint").groupBy(F.bitmap_bucket_number(one).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bitmap")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    for part, bitmap in zip(got.column("part").to_pylist(), got.column("bitmap").to_pylist()):
        raw = np.frombuffer(bitmap, np.uint8)[: len(table)]
        table[(part - 1) * 4096 : (part - 1) * 4096 + len(raw)] = raw
    return table


def _stretches(blob, least: int):
    """(doc_id, place, stretch): runs of words all of whose sequences may stand in an item."""

    def run(batches):
        table, hashed = blob.value, WordHashes(words)
        for batch in batches:
            docs, places, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = hashed(text)
                if len(h) < least:
                    continue
                i, j = _probes(gram_hashes(h, least), len(table) * 8)
                ok = ((table[i >> 3] >> (i & 7).astype(np.uint8)) & (table[j >> 3] >> (j & 7).astype(np.uint8)) & 1).astype(bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    docs.append(doc)
                    places.append(a)
                    found.append(h[a : b + least - 1].tobytes())
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "place", "stretch"])

    return run


class _Items:
    """The word hashes of a block of test items, one after the other."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        hashed = WordHashes(words)
        each = [(item, hashed(text)) for item, text in items]
        each = [(item, h) for item, h in each if len(h) >= least]
        size = np.array([len(h) for _, h in each], np.int64)
        base = np.cumsum(size + 1) - size - 1
        self.hashes = np.concatenate([np.append(h, np.uint64(0)) for _, h in each]) if each else np.zeros(0, np.uint64)
        self.stop = np.zeros(len(self.hashes), bool)
        self.stop[base + size] = True
        self.owner = np.repeat(np.array([item for item, _ in each], np.int64), size + 1)
        self.start = np.concatenate([np.arange(b, b + n - least + 1) for b, n in zip(base, size)]) if each else np.zeros(0, np.int64)
        self.longest = int(size.max(initial=0))


def _search(shard: list[tuple[int, np.ndarray]], items: _Items, least: int) -> Iterator[pa.RecordBatch]:
    """(run, item, longest match in words, its first place in the run) for one shard of stretches."""
    if not shard or not len(items.start):
        return
    hashes = np.concatenate([np.append(h, np.uint64(0)) for _, h in shard])
    lengths = np.array([len(h) + 1 for _, h in shard])
    run = np.repeat(np.arange(len(shard)), lengths)
    first = np.cumsum(lengths) - lengths
    names = np.array([r for r, _ in shard])
    known, seq = np.unique(hashes, return_inverse=True)
    seq = seq.astype(np.int64)
    seq[first + lengths - 1] = -1
    at = np.minimum(np.searchsorted(known, items.hashes), len(known) - 1)
    query = np.where(items.stop | (known[at] != items.hashes), -2, at)
    order = suffix_array(seq, max(least, 16))
    lo = _bound(seq, order, query, items.start, least, False)
    n = _bound(seq, order, query, items.start, least, True) - lo
    hit = np.flatnonzero(n)
    total = np.cumsum(n[hit])
    done = 0
    while done < len(hit):  # a sequence that stands everywhere is taken in parts
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + MATCHES, side="right")))
        h = hit[done:upto]
        done = upto
        k = n[h]
        which = np.repeat(h, k)
        place = order[np.repeat(lo[h], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        length = _common(seq, place, query, items.start[which], items.longest)
        r, item, place = run[place], items.owner[items.start[which]], place - first[run[place]]
        sort = np.lexsort((place, -length, item, r))
        r, item, length, place = r[sort], item[sort], length[sort], place[sort]
        head = np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(names[r[head]]), pa.array(item[head]), pa.array(length[head].astype(np.int32)), pa.array(place[head].astype(np.int32))], names=["run", "item_id", "match_words", "at"])


def _searcher(blob, least: int):
    def run(batches):
        items = _Items(blob.value, least)
        shard, size = [], 0
        for batch in batches:
            for name, stretch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.append((name, np.frombuffer(stretch, np.uint64)))
                size += len(stretch) // 8
                if size >= SHARD_WORDS:
                    yield from _search(shard, items, least)
                    shard, size = [], 0
        yield from _search(shard, items, least)

    return run


def leaked_passages(documents: DataFrame, benchmark: DataFrame, least_words: int = 10) -> DataFrame:
    """(doc_id, item_id, match_words, word_position): each document with a test item of which it holds `least_words`
    consecutive words, the longest verbatim match and where in the document it first begins.

    Whole texts are searched. The corpus is read once; blocks of test items are searched in the stretches that passed the
    bit table, of which equal ones are one, so a passage that a third of the documents hold is searched once. NULL and
    empty texts, items shorter than least_words and NULL ids match nothing; copies of a doc_id are one document.
    """
    spark = documents.sparkSession
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text")
    table = spark.sparkContext.broadcast(bit_table(items, least_words))
    texts = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL AND text <> ''")
    passed = cut(texts.mapInArrow(_stretches(table, least_words), "doc_id bigint, place int, stretch binary").withColumn("run", F.xxhash64("stretch")))
    runs = passed.groupBy("run").agg(F.first("stretch").alias("stretch"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = 1 if total <= BLOCK_CHARS else -(-total // BLOCK_CHARS) * 2
    if n_blocks > 1:
        runs = cut(runs)
    found = None
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        block = [(r["item_id"], r["text"]) for r in collect_bounded(part, BLOCK_CHARS, "test items of a block")]
        got = runs.select("run", "stretch").mapInArrow(_searcher(spark.sparkContext.broadcast(block), least_words), "run bigint, item_id bigint, match_words int, at int")
        found = got if found is None else found.unionByName(got)
    # a stretch of many documents is salted where its matches meet them
    salts = 8
    best = found.groupBy("run", "item_id").agg(F.max(F.struct("match_words", (-F.col("at")).alias("back"))).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = passed.groupBy("run", "doc_id").agg(F.min("place").alias("place")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    met = held.join(best.hint("merge"), ["run", "salt"]).select("doc_id", "item_id", F.struct(F.col("m.match_words").alias("match_words"), (F.col("m.back") - F.col("place")).alias("back")).alias("m"))
    return met.groupBy("doc_id", "item_id").agg(F.max("m").alias("m")).select("doc_id", "item_id", "m.match_words", (-F.col("m.back")).alias("word_position"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, least_words: int = 10) -> DataFrame:
    """The documents that hold no passage of a test item."""
    leaked = leaked_passages(documents, benchmark, least_words).select("doc_id").distinct()
    return documents.join(leaked, "doc_id", "left_anti")
