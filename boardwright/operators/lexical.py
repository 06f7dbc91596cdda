"""Lexical retrieval: analyzer, postings with positions, NEAR over titles and BM25."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import fold, key_of, porter, stem, text
from boardwright.session import cut

# Fixed values of the ranking function: saturation, length weight, title weight, the least idf, and the span of NEAR.
K1, B, TITLE_WEIGHT, LEAST_IDF, NEAR = 1.2, 0.75, 8.0, 1e-6, 3


def tokens(c: Column, stemmed: bool = False) -> Column:
    """Lower-case runs of letters and digits without accents, in order; stemmed ones keep their places."""
    # only texts with accents go through Python; the others pass it as NULL
    folded = F.coalesce(fold(F.when(~text(c).rlike(r"^\p{ASCII}*$"), text(c))), F.lower(text(c)))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(df: DataFrame, doc: str, title: str, stemmed: bool = False) -> DataFrame:
    """(term, doc, positions): the inverted index of titles. Stems are made once per distinct word."""
    words = df.select(F.col(doc).alias("doc"), F.posexplode(tokens(F.col(title))).alias("pos", "word"))
    if stemmed:
        vocabulary = words.select("word").distinct().select("word", stem("word").alias("term"))
        words = words.join(vocabulary, "word")
    else:
        words = words.withColumnRenamed("word", "term")
    return words.groupBy("term", "doc").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def doc_stats(df: DataFrame, doc: str, columns: Sequence[str]) -> DataFrame:
    """(doc, length): tokens of all indexed columns."""
    return df.select(F.col(doc).alias("doc"), reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in columns]).alias("length"))


def build_index(df: DataFrame, doc: str, title: str, columns: Sequence[str], stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings that carry their document's length, totals): all that a search needs, without another look at the texts."""
    lengths = cut(doc_stats(df, doc, columns))
    return postings(df, doc, title, stemmed).join(lengths, "doc"), lengths.agg(F.count("*").alias("docs"), F.sum("length").alias("tokens"))


def update_index(index: DataFrame, totals: DataFrame, before: DataFrame, after: DataFrame, doc: str, title: str, columns: Sequence[str], stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The index and totals after documents changed: `before` holds the old rows of documents that changed or went, `after` the
    new rows of those that changed or came. Only these are analysed; the rest of the index is kept as it stands."""
    gone = before.select(F.col(doc).alias("doc")).unionByName(after.select(F.col(doc).alias("doc"))).distinct()
    more, added = build_index(after, doc, title, columns, stemmed)
    removed = doc_stats(before, doc, columns).agg(F.count("*").alias("less_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("less"))
    # three tables of one row
    sums = totals.crossJoin(added.select(F.col("docs").alias("more_docs"), F.coalesce("tokens", F.lit(0)).alias("more"))).crossJoin(removed)
    return index.join(gone, "doc", "left_anti").unionByName(more), sums.select((F.col("docs") + F.col("more_docs") - F.col("less_docs")).alias("docs"), (F.col("tokens") + F.col("more") - F.col("less")).alias("tokens"))


def query_clauses(titles: Sequence[str], stemmed: bool = False) -> list[list[str | tuple[str, ...]]]:
    """One clause of words per title; a word of several tokens (AI/ML) is a phrase of theirs. Marks that only a query language
    needs part words; words and titles without a letter or digit give none."""
    one = lambda w: porter(w) if stemmed else w
    clauses = []
    for t in titles:
        words = [[one(k) for k in key_of(w).split()] for w in re.sub(r'["^*():,]', " ", t).split()]
        clauses.append([w[0] if len(w) == 1 else tuple(w) for w in words if w])
    return [c for c in clauses if c]


def _parts(word: str | tuple[str, ...]) -> tuple[str, ...]:
    return (word,) if isinstance(word, str) else tuple(word)


def phrase_positions(tokens_: Sequence[Sequence[int]]) -> list[int]:
    """Where a phrase begins, from the positions of its tokens."""
    rest = [set(x) for x in tokens_[1:]]
    return [p for p in tokens_[0] if all(p + k in s for k, s in enumerate(rest, 1))]


def near_positions(lists: Sequence[Sequence[int]], span: int = NEAR, sizes: Sequence[int] | None = None) -> list[list[int]]:
    """For each word the positions that take part in a match: a word of n tokens begins within span + n places of the last one."""
    reach = [span + n for n in (sizes or [1] * len(lists))]
    at = [0] * len(lists)
    hits: list[list[int]] = [[] for _ in lists]
    while all(i < len(x) for i, x in zip(at, lists)):
        now = [x[i] for i, x in zip(at, lists)]
        top = max(now)
        behind = [k for k, p in enumerate(now) if p < top - reach[k]]
        if behind:
            for k in behind:
                while at[k] < len(lists[k]) and lists[k][at[k]] < top - reach[k]:
                    at[k] += 1
            continue
        for k, p in enumerate(now):
            if not hits[k] or hits[k][-1] != p:
                hits[k].append(p)
        following = [x[i + 1] if i + 1 < len(x) else math.inf for i, x in zip(at, lists)]
        k = following.index(min(following))
        if following[k] == math.inf:
            break
        at[k] += 1
    return hits


def _near_batches(words: list[tuple[str, ...]]):
    """(doc, term, tf) of the documents that have all words of a clause near each other; a phrase's term is joined by blanks."""

    def run(batches):
        sizes = [len(w) for w in words]
        for batch in batches:
            doc, word, tf = [], [], []
            for d, ws, ps in zip(*(batch.column(i).to_pylist() for i in range(3))):
                have = dict(zip(ws, ps))
                starts = [phrase_positions([have[t] for t in w]) if len(w) > 1 else have[w[0]] for w in words]
                hits = near_positions(starts, sizes=sizes) if all(starts) else [[]]
                if all(hits):
                    for w, h in zip(words, hits):
                        doc.append(d), word.append(" ".join(w)), tf.append(len(h))
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.column(0).type), pa.array(word, pa.string()), pa.array(tf, pa.int32())], names=["doc", "term", "tf"])

    return run


def _together(index: DataFrame, words: list[tuple[str, ...]]) -> DataFrame:
    """(doc, term, tf) of a clause, from the documents that have all its tokens."""
    needed = sorted({t for w in words for t in w})
    grouped = index.where(F.col("term").isin(needed)).groupBy("doc").agg(F.collect_list("term").alias("ws"), F.collect_list("positions").alias("ps")).where(F.size("ws") == len(needed))
    return grouped.mapInArrow(_near_batches(words), f"doc {dict(index.dtypes)['doc']}, term string, tf int")


def matches(index: DataFrame, clauses: Sequence[Sequence[str | tuple[str, ...]]]) -> DataFrame:
    """(doc, clause, term, tf): the words of each clause that a document's title has near each other.

    The clauses' words are literals, so they filter the index where it is read; only documents with all words of a
    clause go on. Clauses of one token need no span test.
    """
    found = None
    for i, words in enumerate(clauses):
        distinct = list(dict.fromkeys(map(_parts, words)))
        if len(distinct) == 1 and len(distinct[0]) == 1:
            got = index.where(F.col("term") == distinct[0][0]).select("doc", F.lit(i).alias("clause"), "term", F.size("positions").alias("tf"))
        else:
            got = _together(index, distinct).select("doc", F.lit(i).alias("clause"), "term", "tf")
        found = got if found is None else found.unionByName(got)
    return found


def bm25(index: DataFrame, stats: DataFrame, clauses: Sequence[Sequence[str | tuple[str, ...]]], on_disk: bool = False) -> DataFrame:
    """(doc, score) of all matching documents, better ones larger; the scores of matching clauses add up. No query, no rows.

    `stats` are the documents' lengths, or the totals of an index whose postings carry them. An index that stands on disk,
    sorted by term, is read once a clause; of another the query's postings are kept.
    """
    if not clauses:
        return index.select("doc", F.lit(0.0).alias("score")).where("false")
    words = list(dict.fromkeys(_parts(w) for c in clauses for w in c))
    # the query's postings are read once, however many clauses look at them
    own = index.where(F.col("term").isin(sorted({t for w in words for t in w})))
    own = own if on_disk else cut(own)
    hit = matches(own, clauses)
    df = own.where(F.col("term").isin([w[0] for w in words if len(w) == 1])).groupBy("term").agg(F.count("*").alias("n"))
    for w in words:
        if len(w) > 1:  # how many titles have the phrase
            df = df.unionByName(_together(own, [w]).groupBy("term").agg(F.count("*").alias("n")))
    stored = "length" in index.columns
    whole = stats.select("docs", (F.col("tokens") / F.col("docs")).alias("mean")) if stored else stats.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    # one row, and at most one row per query word: small by construction
    weights = df.crossJoin(F.broadcast(whole)).select("term", "mean", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    f = F.col("tf") * TITLE_WEIGHT
    score = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    lengths = own.select("doc", "length").distinct() if stored else stats
    return hit.join(F.broadcast(weights), "term").join(lengths, "doc").groupBy("doc").agg(F.sum(score).alias("score"))
