"""Mixing sources to target weights by entropy balancing (problem 9).

Every document gets a rate (expected copies), as close as possible to reading the corpus once in relative entropy, such
that each source's expected tokens are its share of the total. The convex dual has one multiplier per source; the rates
are exponentially tilted, min(cap, exp(lambda_source * tokens / mean tokens)). Newton steps on the dual are distributed sums
over the counts of documents by source and size. Rates are then rounded to whole copies systematically.
"""

from __future__ import annotations

import base64
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwright.session import collect_bounded, cut

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: The split pattern that this public vocabulary was made with (a fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MAX_SOURCES = 10_000
#: Documents that are rounded in one task, about; a larger source is cut into strata.
STRATUM_DOCS = 200_000
#: A very long text is tokenised in pieces cut at white space.
PIECE = 200_000
#: Newton steps at most, and how far a source may end from its goal; beyond, it raises.
ROUNDS, ACCURACY = 200, 1e-6


def source_key(c: Column) -> Column:
    """Sources compare trimmed and without letter case; blank as NULL."""
    key = F.lower(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))
    return F.when(key != "", key)


def _pieces(text: str):
    while len(text) > PIECE:
        at = text.rfind(" ", 1, PIECE)
        at = at if at > 0 else PIECE
        yield text[:at]
        text = text[at:]
    yield text


def _counter(path: str):
    def run(batches):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            counts = [sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in batch.column(at).to_pylist()]
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(counts, pa.int64())], names=[*[batch.schema.names[i] for i in keep], "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens) of every row with a source; NULL and empty texts have 0 tokens."""
    src = documents.where(F.col("doc_id").isNotNull()).select("doc_id", source_key(F.col("source")).alias("source"), F.col("text").alias("__text")).where("source IS NOT NULL")
    return src.mapInArrow(_counter(f"{tokenizer_dir}/{TOKENIZER_FILE}"), f"doc_id {dict(documents.dtypes)['doc_id']}, source string, tokens bigint")


class Mix:
    """`plan`: (doc_id, source, tokens, rate, copies); `shares`: one row per target."""

    def __init__(self, plan: DataFrame, shares: DataFrame):
        self.plan, self.shares = plan, shares


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer_dir: str = TOKENIZER_DIR, tolerance: float = 1e-9) -> Mix:
    """Combine documents so that each source has its target share of all tokens, none read more than max_passes times.

    Without total_tokens the mix is as large as the caps allow with all shares met. With a larger total, a source that
    its cap holds back falls short and the reached shares show it. Targets without documents can't be reached: they
    stay in `shares` with 0, and the others share the total in proportion. Sources without a target, documents without
    a source and documents without tokens get 0 copies. A doc_id counts once; of copies that differ, the first by source and
    then the shortest. Empty tables give an empty plan.
    """
    spark = documents.sparkSession
    goals = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_passes").cast("int").alias("cap")).where("source IS NOT NULL")
    goals = goals.groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
    counted = cut(token_counts(documents, tokenizer_dir).groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("s")).select("doc_id", "s.*"))
    # Newton runs on how many documents of each size a source has
    sizes = cut(counted.where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("have"), F.sum("n").alias("docs"))
    rows = collect_bounded(goals.join(have, "source", "left"), MAX_SOURCES, "mix targets")
    live = {r["source"]: r for r in rows if r["have"] and (r["share"] or 0) > 0 and (r["cap"] or 0) > 0}
    whole = sum(r["share"] for r in live.values())
    share = {s: r["share"] / whole for s, r in live.items()}
    if total_tokens is None:
        total_tokens = min((r["cap"] * r["have"] / share[s] for s, r in live.items()), default=0.0)
    goal = {s: min(share[s] * total_tokens, r["cap"] * r["have"]) for s, r in live.items()}
    mean = {s: r["have"] / r["docs"] for s, r in live.items()}
    # start where the tilt of a document of mean size gives the rate
    lam = {s: math.log(goal[s] / r["have"]) for s, r in live.items()}
    full = {s for s, r in live.items() if goal[s] >= r["cap"] * r["have"] * (1 - 1e-12)}
    lo, hi = {s: -1e6 for s in live}, {s: 1e6 for s in live}
    schema = "source string, lam double, mean double, cap int, full boolean, strata int"

    def tilted(rows, lam):
        p = spark.createDataFrame([(s, lam[s], mean[s], live[s]["cap"], s in full, -(-live[s]["docs"] // STRATUM_DOCS)) for s in live], schema)
        # one row a source, at most MAX_SOURCES: small by construction
        d = rows.join(F.broadcast(p), "source")
        x = F.col("tokens") / F.col("mean")
        rate = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * x)))))
        return d.withColumns({"x": x, "rate": rate})

    open_ = [s for s in live if s not in full]
    for step_no in range(ROUNDS if open_ else 0):
        mass = F.col("n") * F.col("tokens") * F.col("rate")
        got = tilted(sizes, lam).groupBy("source").agg(F.sum(mass).alias("f"), F.sum(F.when(F.col("rate") < F.col("cap"), mass * F.col("x")).otherwise(0.0)).alias("df")).collect()  # a row a source
        sums = {r["source"]: r for r in got}
        gaps = {s: sums[s]["f"] - goal[s] for s in open_}
        worst = max(abs(gaps[s]) / goal[s] for s in open_)
        if worst < tolerance or (step_no == ROUNDS - 1 and worst < ACCURACY):
            break
        for s in open_:
            lo[s], hi[s] = (lo[s], lam[s]) if gaps[s] > 0 else (lam[s], hi[s])
            step = lam[s] - gaps[s] / sums[s]["df"] if sums[s]["df"] > 0 else math.inf
            lam[s] = step if lo[s] < step < hi[s] else (lo[s] + hi[s]) / 2
    else:
        if open_:
            raise RuntimeError(f"mix: a source is still {worst:.2g} of its goal away after {ROUNDS} Newton steps")
    columns = ["doc_id", "source", "tokens", "cap", "rate", "stratum"]
    has = (F.col("tokens") > 0) & F.col("source").isin(list(live)) if live else F.lit(False)
    planned = tilted(counted.where(has), lam).withColumn("stratum", F.pmod(F.xxhash64("doc_id"), F.col("strata"))).select(*columns)
    # systematic rounding: within a stratum in the order of size, a document gets the whole numbers its rate passes over;
    # strata follow each other, so a source misses its goal by about one document, not by one a stratum
    parts = planned.groupBy("source", "stratum").agg(F.sum("rate").alias("r"))
    before = parts.select("source", "stratum", (F.sum("r").over(Window.partitionBy("source").orderBy("stratum")) - F.col("r")).alias("base"))
    run = Window.partitionBy("source", "stratum").orderBy("tokens", "doc_id")
    upto = F.col("base") + F.sum("rate").over(run.rowsBetween(Window.unboundedPreceding, 0))
    whole_copies = F.least((F.floor(upto + 0.5) - F.floor(upto - F.col("rate") + 0.5)).cast("int"), F.ceil(F.col("rate") - 1e-9).cast("int"), F.col("cap"))
    plan = planned.join(before, ["source", "stratum"]).select("doc_id", "source", "tokens", "rate", whole_copies.alias("copies"))
    plan = plan.unionByName(counted.where(~has).select("doc_id", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")))
    plan = cut(plan)
    got = plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("tokens").alias("source_tokens"), F.count_if(F.col("copies") > 0).alias("documents_used"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    shares = goals.join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", F.col("share").alias("target_share"), F.col("cap").alias("max_passes"),
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("documents_used", F.lit(0)).alias("documents_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
    )
    return Mix(plan, shares)
