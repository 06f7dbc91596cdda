"""Scoring, filtering, deduplication, ranking and facets of a board of listings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwright.functions.text import has_term, key_of, norm_key, term_hits, text
from boardwright.operators.pool import posted_day

# Fixed values of the scoreboard: title tiers, boost by number of hits, penalties, and the prefixes that name a level.
EXACT, ALL_WORDS, SAME_STRIPPED, RELATED = 100, 80, 60, 30
BOOSTS = (8, 14, 18, 20)
PENALTY_HEAD, PENALTY_BODY = 30, 15
LEVEL_PREFIXES = ("head of", "director of", "senior", "staff", "principal", "junior", "lead", "sr", "jr")
# Ordinary words that count against a listing only in these phrases.
QUALIFIED = {
    "agency": r"\b(staffing|recruiting|recruitment|employment|temp|talent)[\s-]+agenc(y|ies)\b",
    "recruiting": r"\brecruiting[\s-]+(agency|agencies|firm|company)\b|\b(third[\s-]party|external|agency)[\s-]+recruiting\b",
    "recruiter": r"\b(agency|third[\s-]party|external|contract)[\s-]+recruiter\b",
    "staffing": r"\bstaffing[\s-]+(agency|agencies|firm|company|solutions|services|partner)\b",
    "our client": r"\bour clients?[,']?\s+(is|are|has|have|was|were)\b|\bon behalf of (our|a) clients?\b|\bour client,\s|\bfor one of our clients?\b",
}
#: A literal that every branch of a phrase needs.
QUALIFIED_GATES = {"agency": "agenc", "recruiting": "recruiting", "recruiter": "recruiter", "staffing": "staffing", "our client": "client"}
COMPANY_ONLY = {"client"}
FACETS = ("category", "employment_type", "remote", "seniority", "salary_band", "state", "apply_via")


def clean_list(value) -> list[str]:
    """Distinct lower-case items of a list or of a text with commas or line breaks, in order."""
    parts = value.replace("\n", ",").split(",") if isinstance(value, str) else list(value) if isinstance(value, (list, tuple)) else []
    return list(dict.fromkeys(s for p in parts if (s := str(p).strip().lower())))


@dataclass(frozen=True)
class Query:
    """A search, cleaned once on the driver; its terms become literals of the plan."""

    titles: list[str]
    related: list[str] = field(default_factory=list)
    boosts: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    penalties: list[str] = field(default_factory=list)
    remote_only: bool = False
    max_age_days: int | None = None
    limit: int = 200

    @staticmethod
    def of(doc: dict) -> Query:
        titles = clean_list(doc.get("titles"))
        keys = [f" {key_of(t)} " for t in titles]
        # an exclusion that would drop a wanted title itself is no exclusion
        exclude = [e for e in clean_list(doc.get("exclude")) if not any(f" {key_of(e)} " in k for k in keys)]
        limit = doc.get("limit", 200)
        return Query(titles, clean_list(doc.get("related_titles")), clean_list(doc.get("boosts")), exclude, clean_list(doc.get("rank_down")), bool(doc.get("remote_only")), doc.get("max_age_days"), max(1, min(200, limit)))


def _strip_level(c: Column) -> Column:
    return F.regexp_replace(c, "^(" + "|".join(LEVEL_PREFIXES) + ") ", "")


def title_tier(wanted: str, key: Column, words: Column | None = None, bare: Column | None = None) -> Column:
    """100 equal, 80 all wanted words, 60 equal without one leading level word on either side, else 0. `words` and `bare`
    are the key's words and the key without its level word, where they stand ready."""
    want = key_of(wanted)
    short = next((want.removeprefix(p + " ") for p in LEVEL_PREFIXES if want.startswith(p + " ")), want)
    wanted_words = F.array(*[F.lit(w) for w in dict.fromkeys(want.split())])
    return (
        F.when(key == "", 0)
        .when(key == want, EXACT)
        .when(F.size(F.array_except(wanted_words, F.split(key, " ") if words is None else words)) == 0, ALL_WORDS)
        .when((_strip_level(key) if bare is None else bare) == short, SAME_STRIPPED)
        .otherwise(0)
    )


def with_title_keys(df: DataFrame) -> DataFrame:
    """Keys of both title surfaces as columns: made once a row, however many wanted titles look at them."""
    for i, c in enumerate(("title", "title_root")):
        df = df.withColumn(f"__k{i}", norm_key(F.col(c)))
    for i in (0, 1):
        df = df.withColumn(f"__w{i}", F.split(f"__k{i}", " ")).withColumn(f"__s{i}", _strip_level(F.col(f"__k{i}")))
    return df


def title_points(q: Query) -> tuple[Column, Column]:
    """(points, is related) over the columns of with_title_keys: the best tier over wanted titles and both surfaces; a
    related title only where that is 0."""
    tiers = lambda titles: [title_tier(t, F.col(f"__k{i}"), F.col(f"__w{i}"), F.col(f"__s{i}")) for t in titles for i in (0, 1)]
    best = reduce(F.greatest, tiers(q.titles), F.lit(0)) if q.titles else F.lit(0)
    near = reduce(F.greatest, tiers(q.related), F.lit(0)) if q.related else F.lit(0)
    return F.when(best > 0, best).when(near > 0, RELATED).otherwise(0), (best == 0) & (near > 0)


def _penalty(term: str, head: Column, company: Column, body: Column) -> Column:
    if term in COMPANY_ONLY:
        return F.when(has_term(term, company), PENALTY_HEAD).otherwise(0)
    pattern = QUALIFIED.get(term)
    # CASE evaluates the pattern only where its literal occurs
    phrase = lambda c: F.when(F.contains(c, F.lit(QUALIFIED_GATES[term])), c.rlike(pattern)).otherwise(False)
    in_body = phrase(body) if pattern else has_term(term, body)
    in_head = phrase(head) if term == "agency" else has_term(term, head)
    return F.when(in_head, PENALTY_HEAD).when(in_body, PENALTY_BODY).otherwise(0)


def scoreboard(df: DataFrame, q: Query) -> DataFrame:
    """df with points, parts (label, delta, which sum to points) and why (the first four labels)."""
    lowered = df.withColumn("__head", F.lower(F.concat_ws(" ", text(F.col("title")), text(F.col("company"))))).withColumn("__company", F.lower(text(F.col("company")))).withColumn("__body", F.lower(text(F.col("body")))).withColumn("__blob", F.lower(F.concat_ws(" ", text(F.col("title")), text(F.col("body")))))
    lowered = with_title_keys(lowered)
    points, related = title_points(q)
    part = lambda label, delta: F.struct(label.alias("label"), delta.cast("int").alias("delta"))
    parts = [F.when(F.col("__tier") != 0, part(F.when(F.col("__related"), "related title").otherwise("title"), F.col("__tier")))]
    scored = lowered.withColumn("__tier", points).withColumn("__related", related)
    for i, b in enumerate(q.boosts):
        scored = scored.withColumn(f"__h{i}", term_hits(b, F.col("__blob")))
        delta = F.element_at(F.array(*[F.lit(x) for x in BOOSTS]), F.greatest(F.lit(1), F.least(F.col(f"__h{i}"), F.lit(len(BOOSTS)))))
        parts.append(F.when(F.col(f"__h{i}") > 0, part(F.concat(F.lit(b + " ×"), F.col(f"__h{i}").cast("string")), delta)))
    for i, p in enumerate(q.penalties):
        scored = scored.withColumn(f"__p{i}", _penalty(p, F.col("__head"), F.col("__company"), F.col("__body")))
        parts.append(F.when(F.col(f"__p{i}") > 0, part(F.lit("-" + p), -F.col(f"__p{i}"))))
    scored = scored.withColumn("parts", F.array_compact(F.array(*parts)))
    total = F.aggregate("parts", F.lit(0), lambda s, p: s + p["delta"])
    why = F.array_join(F.slice(F.transform("parts", lambda p: p["label"]), 1, 4), ", ")
    return scored.withColumn("points", total).withColumn("why", why).drop(*[c for c in scored.columns if c.startswith("__")])


def eligible(df: DataFrame, q: Query, as_of: Column) -> DataFrame:
    """Hard filters: no excluded term in title and company, remote if asked for, not older than asked (unknown age stays)."""
    head = F.lower(F.concat_ws(" ", text(F.col("title")), text(F.col("company"))))
    for e in q.exclude:
        df = df.where(~has_term(e, head))
    if q.remote_only:
        df = df.where(F.col("remote") == "remote")
    if q.max_age_days is not None:
        day = posted_day(F.col("posted"))
        df = df.where(day.isNull() | (F.datediff(as_of, day) <= q.max_age_days))
    return df


def dedupe_listings(df: DataFrame, rank: str) -> DataFrame:
    """One row per employer and title: the place of the first, the content of the longest body; blank keys stay apart."""
    company, title = norm_key(F.col("company")), norm_key(F.col("title"))
    key = F.when((company == "") & (title == ""), F.concat(F.lit("url:"), F.col("url"))).otherwise(F.concat(company, F.lit("|"), title))
    rows = df.withColumn("__key", key)
    cols = [c for c in df.columns if c != rank]
    best = F.max_by(F.struct(*cols), F.struct(F.length(text(F.col("body"))).alias("n"), (-F.col(rank)).alias("r")))
    return rows.groupBy("__key").agg(F.min(rank).alias(rank), best.alias("s")).select(rank, "s.*")


def ranked(df: DataFrame, q: Query, rank: str) -> DataFrame:
    return scoreboard(df, q).orderBy(F.desc("points"), rank, "url").limit(q.limit)


def facet_counts(df: DataFrame, facets: Sequence[str] = FACETS) -> DataFrame:
    """(facet, value, n), blank and NULL values left out: one pass over the unpivoted facets."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return df.select(pairs.alias("p")).select("p.*").where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def passes_facets(chosen: dict[str, Sequence[str]]) -> Column:
    """Any of the values within a facet, all facets; a row without a label passes."""
    tests = [F.col(f).isNull() | (F.col(f) == "") | F.col(f).isin(*v) for f, v in chosen.items() if v]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def shown_rows(scored: DataFrame, seen: DataFrame, fit: int = 0, agencies: bool = False, floor: float | None = None, chosen: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The rows of a board that its reader sees: not among `seen` urls (applied or dismissed), of at least `fit` points,
    without staffing agencies in title and company unless asked, pay not stated under the floor, and the chosen facets."""
    rows = scored.where(text(F.col("url")) != "").join(seen.select("url").distinct(), "url", "left_anti").where(F.col("points") >= fit)
    if not agencies:
        head = F.lower(F.concat_ws(" ", text(F.col("title")), text(F.col("company"))))
        rows = rows.where(~reduce(lambda a, b: a | b, [head.rlike(QUALIFIED[k]) for k in ("agency", "recruiting", "recruiter", "staffing")]))
    if floor is not None:
        rows = rows.where(F.col("salary_min").isNull() | (F.col("salary_min") <= 0) | (F.col("salary_min") >= floor))
    return rows.where(passes_facets(chosen)) if chosen else rows


def exemptions(df: DataFrame, chosen: dict[str, Sequence[str]]) -> DataFrame:
    """(facet, n): rows that pass a chosen facet only because they have no label."""
    kept = df.where(passes_facets(chosen))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), (F.col(f).isNull() | (F.col(f) == "")).alias("bare")) for f in chosen]))
    return kept.select(pairs.alias("p")).select("p.*").where("bare").groupBy("facet").agg(F.count("*").alias("n"))


def cap_per_group(df: DataFrame, group: Column, order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group; Spark drops the rest before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
