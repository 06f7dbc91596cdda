"""The engine's surface: boards, candidates, lookups and statistics over one pool of listings."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwright.functions import vocab as V
from boardwright.functions.text import text
from boardwright.operators import board, dense, intake, lexical, order, pool

CARD = ("url", "title", "company", "team", "location", "city", "state", "country", "remote", "category", "tags", "seniority", "employment_type", "salary", "salary_band", "posted", "source", "direct_apply")
CANDIDATE = ("url", "title", "company", "location", "remote", "category", "seniority", "salary", "posted", "source")
#: Columns whose tokens count as a listing's length.
INDEXED = ["title", "location", "body"]
#: What a pickiness word means as the least number of points, and words for a place that mean remote or any.
PICKINESS = {"plenty": 5, "balanced": 12, "strong": 20}
REMOTE_PLACES, ANY_PLACES = ("remote", "remote only", "remote-only"), ("anywhere", "any", "everywhere")
# Weights of a search's own words in the older way of scoring; carried with its settings, used by no board.
OLDER_WEIGHTS = {"title": 3, "boost": 5, "rank_down": 8}
#: Staffing words that count against a listing where a search names none of its own; own choice, a parameter of Engine.
STAFFING = ("staffing", "recruiting", "recruiter", "agency", "our client", "recruitment agency", "employment agency", "temp agency", "headhunter", "talent pool", "multiple clients", "third party")
#: How many characters of a body each surface shows.
SNIPPET, DESCRIPTION, CANDIDATE_BODY, SHALLOW, DEEP, GLIMPSE = 240, 1200, 4000, 320, 6000, 600


@dataclass
class Board:
    """jobs: delivered cards in order; facets: their counts; both are lazy. notes: what of the search was overridden;
    degraded: why it was served from the store alone, or ''; pool: listings in the pool, lazily one row."""

    jobs: DataFrame
    facets: DataFrame
    notes: list[str] = field(default_factory=list)
    degraded: str = ""
    pool: DataFrame | None = None

    def meta(self) -> dict:
        """count and pool as numbers, with notes and degraded."""
        return {"count": self.jobs.count(), "pool": self.pool.first()[0] if self.pool is not None else None, "notes": self.notes, "degraded": self.degraded}


def settings(doc: dict) -> tuple[dict, list[str]]:
    """(search, notes): a posted search with its place words turned into remote_only, unless it says that itself, and a note of
    exclusions that would have dropped a wanted title."""
    out, notes = dict(doc), []
    place = str(doc.get("location") or "").strip().lower()
    if not isinstance(doc.get("remote_only"), bool):
        out["remote_only"] = place in REMOTE_PLACES
    if place in (*REMOTE_PLACES, *ANY_PLACES):
        out["location"] = "remote"
    age = doc.get("max_age_days")
    out["max_age_days"] = int(age) if isinstance(age, (int, float)) and not isinstance(age, bool) else None
    dropped = [e for e in board.clean_list(doc.get("exclude")) if e not in board.Query.of(doc).exclude]
    titles, boosts = board.clean_list(doc.get("titles")), board.clean_list(doc.get("boosts"))
    out["older_weights"] = {t: OLDER_WEIGHTS["title"] for t in titles} | {b: OLDER_WEIGHTS["boost"] for b in boosts}
    if dropped:
        notes.append("dropped exclusion(s) that would have deleted your own target role: " + ", ".join(dropped))
    return out, notes


def least_points(value, default: int = 12) -> int:
    if isinstance(value, bool) or value is None:
        return default
    return int(value) if isinstance(value, (int, float)) else PICKINESS.get(str(value).strip().lower(), default)


def clamp(k, default: int, most: int) -> int:
    return max(1, min(most, k if isinstance(k, int) and not isinstance(k, bool) else default))


class Engine:
    """Queries over `jobs` (one row a url) and, if given, `vectors` (url, embedding, unit length not needed)."""

    def __init__(self, jobs: DataFrame, vectors: DataFrame | None = None, as_of: Column | None = None, stemmed: bool = True, index: tuple[DataFrame, DataFrame] | None = None, penalties: Sequence[str] = STAFFING):
        self.penalties, self.on_disk = list(penalties), index is not None
        self.jobs, self.vectors, self.as_of, self.stemmed = jobs, vectors, as_of if as_of is not None else F.current_date(), stemmed
        self.index, self.totals = index or lexical.build_index(jobs, "url", "title", INDEXED, stemmed)

    def save_index(self, path: str) -> None:
        """Write the inverted index, sorted by term so that a query's words prune it where it is read, and its totals."""
        self.index.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @property
    def spark(self) -> SparkSession:
        return self.jobs.sparkSession

    def retrieve(self, titles: Sequence[str]) -> DataFrame:
        """Every listing whose title matches, with its rank by BM25 (ties by url): never cut off before scoring."""
        hits = lexical.bm25(self.index, self.totals, lexical.query_clauses(titles, self.stemmed), self.on_disk)
        # the hits' scores alone are ranked, then joined to the listings; a semi join first, as it passes below the
        # choice of each listing's last row, so that only hits go through it
        ranked = order.numbered(hits, [F.desc(F.round("score", 9)), "doc"], "rank", 1).select(F.col("doc").alias("url"), "rank")
        return self.jobs.join(ranked.select("url"), "url", "left_semi").join(ranked, "url")

    def listings(self, doc: dict) -> tuple[DataFrame, board.Query]:
        """Eligible and deduplicated listings of a search, in that order, as dropping after deduplication would lose twins."""
        q = board.Query.of({**doc, "rank_down": [*(board.clean_list(doc.get("rank_down")) or self.penalties), *sorted(board.COMPANY_ONLY)]})
        return board.dedupe_listings(board.eligible(self.retrieve(q.titles + q.related), q, self.as_of), "rank"), q

    def score(self, doc: dict, degraded: str = "") -> Board:
        """The board of a search; penalties are its own rank_down or the staffing words, and always those for companies only."""
        doc, notes = settings(doc)
        found, q = self.listings(doc)
        least = least_points(doc["min_score"]) if "min_score" in doc else None
        scored = board.scoreboard(found, q)
        if least is not None:
            scored = scored.where(F.col("points") >= least)
        top = scored.orderBy(F.desc("points"), "rank", "url").limit(q.limit)
        via = V.apply_via(F.col("direct_apply")).alias("apply_via")
        cards = top.select("rank", "points", "why", "parts", *[c for c in CARD if c in top.columns], *([via] if "direct_apply" in top.columns else []), F.substring(text(F.col("body")), 1, SNIPPET).alias("snippet"), F.substring(text(F.col("body")), 1, DESCRIPTION).alias("description"))
        return Board(cards, board.facet_counts(cards, [f for f in board.FACETS if f in cards.columns]), notes, degraded, self.jobs.agg(F.countDistinct("url")))

    def candidate_count(self, titles: Sequence[str]) -> int:
        clauses = lexical.query_clauses(titles, self.stemmed)
        return lexical.matches(self.index, clauses).select("doc").distinct().count() if clauses else 0

    def candidates(self, doc: dict, probes: DataFrame | None = None, k: int | None = None, per_company: int = 3, filter_first: bool = True) -> DataFrame:
        """The k best of both arms, fused. `probes` (probe_id, probe) are query vectors; without vectors or probes the
        lexical order stands. filter_first applies the hard filters to dense rows before k is counted, else after."""
        k = clamp(k, 50, 200)
        found, q = self.listings(doc)
        lex = order.numbered(found.select("url", "rank"), ["rank", "url"], "rank0").select("url", "rank0")
        if self.vectors is not None and probes is not None:
            ids = order.numbered(self.vectors.select("url").distinct(), ["url"], "id")
            store = self.vectors.join(board.eligible(self.jobs, q, self.as_of).select("url"), "url", "left_semi") if filter_first else self.vectors
            near = dense.top_per_probe(store.join(ids, "url").select("id", "embedding"), "id", "embedding", probes, "probe_id", "probe")
            fused = dense.fuse(near, "id").orderBy(F.desc(F.round("rrf", 12)), "id").limit(max(4 * k, dense.PROBE_DEPTH))
            den = order.numbered(fused.join(ids, "id").select("url", "rrf"), [F.desc(F.round("rrf", 12)), "url"], "rank0").select("url", "rank0")
        else:
            den = lex.limit(0)
        company = self.jobs.select("url", F.lower(F.trim(text(F.col("company")))).alias("__c"))
        both = dense.fuse(lex.unionByName(den), "url").join(company, "url")
        best = board.cap_per_group(both, F.coalesce(F.nullif("__c", F.lit("")), F.col("url")), [F.desc(F.round("rrf", 12)), F.col("url")], per_company).orderBy(F.desc(F.round("rrf", 12)), "url").limit(k)
        rows = best.drop("__c").join(self.jobs, "url")
        if not filter_first:
            rows = board.eligible(rows, q, self.as_of)
        return rows.select("rrf", *[c for c in CANDIDATE if c in rows.columns], F.substring(text(F.col("body")), 1, CANDIDATE_BODY).alias("body")).orderBy(F.desc(F.round("rrf", 12)), "url")

    def search(self, titles: Sequence[str], remote_only: bool = False, salary_floor: float | None = None, k: int | None = None) -> DataFrame:
        """A looser search: only stated on-site and hybrid rows fall to remote_only, only stated pay to the floor."""
        rows = self.retrieve(board.clean_list(list(titles)))
        if remote_only:
            rows = rows.where(~F.coalesce(F.col("remote"), F.lit("")).isin("onsite", "hybrid"))
        if salary_floor is not None:
            pay = V.annual_salary(F.col("salary_min"), F.col("salary_currency"), F.col("salary_period"))
            rows = rows.where(pay.isNull() | (pay >= salary_floor))
        return rows.orderBy("rank").limit(clamp(k, 40, 120)).select("rank", *[c for c in CANDIDATE if c in rows.columns])

    def read(self, urls: Sequence[str], most: int = 25) -> tuple[DataFrame, list[str], list[str]]:
        """(rows in the asked order, urls not found, urls beyond `most`)."""
        asked, rest = list(dict.fromkeys(urls))[:most], list(dict.fromkeys(urls))[most:]
        rows = intake.rows_in_order(self.jobs, "url", asked)
        have = {r["url"] for r in rows.select("url").collect()}  # at most `most`
        return rows, [u for u in asked if u not in have], rest

    def recommend(self, urls: Sequence[str]) -> tuple[list[str], list[str]]:
        """(urls in the pool, urls that aren't), both in the asked order."""
        _, missing, _ = self.read(urls, most=len(urls) or 1)
        return [u for u in dict.fromkeys(urls) if u not in set(missing)], missing

    def stats(self) -> DataFrame:
        return self.jobs.agg(F.count("*").alias("pool"), F.max("posted").alias("newest_posted"), F.max("last_seen").alias("last_seen"), F.countDistinct("company").alias("companies"))


def engine(spark: SparkSession, jobs_path: str, vectors_path: str | None = None, index_path: str | None = None, **kw) -> Engine:
    """An engine over stored tables; with index_path, over an index that save_index wrote."""
    if index_path:
        kw["index"] = (spark.read.parquet(f"{index_path}/postings"), spark.read.parquet(f"{index_path}/totals"))
    jobs = pool.latest(spark.read.parquet(jobs_path), "url", ["last_seen", "fetched_at"])
    return Engine(jobs, spark.read.parquet(vectors_path) if vectors_path else None, **kw)


def stored_index(spark: SparkSession, jobs: DataFrame, source: str, folder: str, stemmed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The index of `jobs`, written below `folder` when it isn't there for the state that the files of `source` have now."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(path, True)
    state = []
    while files.hasNext():
        f = files.next()
        state.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    at = f"{folder}/index-{hashlib.sha1(repr((sorted(state), stemmed)).encode()).hexdigest()}"
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/totals/_SUCCESS")):  # totals are written last
        Engine(jobs, stemmed=stemmed).save_index(at)
    return spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/totals")
