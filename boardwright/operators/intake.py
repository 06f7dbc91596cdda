"""From raw rows to stored listings, and the union of sources they come from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions import vocab as V
from boardwright.functions.surface import sorted_set
from boardwright.functions.text import text
from boardwright.operators.pool import BODY_CAP
from boardwright.schema import JOBS, RAW

# The remote states a source may name, and words in a location that name no place.
REMOTE_STATES = ("remote", "hybrid", "onsite")
NO_PLACE = (
    "", "remote", "remote only", "remote-only", "remote us", "remote (us)", "anywhere", "anywhere in the us", "anywhere in the united states", "any", "everywhere", "virtual", "wfh", "work from home",
    "home based", "home-based", "telecommute", "nationwide", "national", "us", "usa", "u.s.", "u.s.a.", "united states", "no preference", "none", "n/a", "flexible", "open",
)
#: Words that say a posting is remote, and the phrases that take it back.
REMOTE_WORDS = r"\b(fully remote|100% remote|remote position|remote role|work from home|remote opportunity)\b"
NOT_REMOTE = r"\bnot (a |an )?(fully )?remote\b"


def _list(name: str) -> Column:
    """An array without blanks, NULL where nothing is left."""
    a = F.filter(F.col(name), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.when(F.size(a) > 0, a)


def remote_state(stated: Column, basis: Column, title: Column, location: Column, body: Column) -> tuple[Column, Column]:
    """(state, basis): a stated one of the known states; else remote where title, place or text say so; else NULL."""
    s = F.lower(F.trim(text(stated)))
    low = F.lower(text(body))
    derived = F.lower(text(title)).rlike(r"\bremote\b") | F.lower(text(location)).rlike(r"\b(remote|anywhere)\b") | (low.rlike(REMOTE_WORDS) & ~low.rlike(NOT_REMOTE))
    known = s.isin(*REMOTE_STATES)
    return F.when(known, s).when(derived, "remote"), F.when(known, F.coalesce(F.when(F.trim(text(basis)) != "", basis), F.lit("stated"))).when(derived, "derived")


def normalise(raw: DataFrame, now: Column) -> DataFrame:
    """Raw rows in the stored schema: text never NULL where the source may just not say it, vocabularies mapped, the body
    capped, empty lists NULL but for the remote scope, where NULL is unstated and empty is world-wide."""
    have = set(raw.columns)
    for f in RAW.fields:
        if f.name not in have:
            raw = raw.withColumn(f.name, F.lit(None).cast(f.dataType))
    remote, basis = remote_state(F.col("remote_type"), F.col("remote_basis"), F.col("title"), F.col("location"), F.col("text"))
    level = V.seniority(F.col("seniority"))
    yearly = V.annual_salary(F.col("salary_min"), F.col("salary_currency"), F.col("salary_period"))
    made = {
        "body": F.substring(text(F.col("text")), 1, BODY_CAP), "remote": remote, "remote_basis": basis, "category": V.category(F.col("category")), "seniority": level, "seniority_basis": F.when(level.isNotNull(), F.col("seniority_basis")), "state": V.us_state(F.col("state")),
        "title_qualifiers": _list("title_qualifiers"), "locations": _list("locations"), "tags": _list("tags"), "remote_areas": F.col("remote_areas"), "remote_regions": F.col("remote_regions"), "salary_band": V.salary_band(F.coalesce(yearly, V.first_figure(F.col("salary")))),
        "source": F.coalesce(F.when(F.trim(text(F.col("source"))) != "", F.col("source")), F.try_element_at("sources", F.lit(1)), F.lit("")), "source_extra": F.col("source_extra"), "fetched_at": now, "last_seen": now,
    }
    nullable = {"salary_currency", "salary_period", "salary_basis"}
    cols = []
    for f in JOBS.fields:
        c = made.get(f.name)
        if c is None:
            c = text(F.col(f.name)) if f.dataType.simpleString() == "string" and f.name not in nullable else F.col(f.name)
        cols.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def snapshot_meta(raw: DataFrame, admitted: Column, errors: DataFrame | None = None, most: int = 5) -> DataFrame:
    """One row on a snapshot: n, servable (rows that intake admits), the sources that sent rows, in order, and of `errors`
    (source, error) the first few with how many more there are."""
    one = raw.agg(F.count("*").alias("n"), F.count_if(admitted).alias("servable"), sorted_set(F.collect_set("source")).alias("sources"))
    if errors is None:
        return one.withColumn("errors", F.array().cast("array<string>"))
    said = errors.select(F.concat_ws(": ", "source", "error").alias("e"))
    some = said.orderBy("e").limit(most).agg(F.array_sort(F.collect_list("e")).alias("some"))
    left = said.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("left"))
    more = F.when(F.col("left") > 0, F.concat("some", F.array(F.format_string("… and %d more", F.col("left"))))).otherwise(F.col("some"))
    return one.crossJoin(some).crossJoin(left).select("n", "servable", "sources", more.alias("errors"))


def union_sources(sources: Mapping[str, DataFrame | Exception]) -> tuple[DataFrame, DataFrame]:
    """(rows, report): the union of what sources sent, each row with its source, and (source, n, why) for all of them:
    a source without rows is reported as empty. A source that failed comes as its exception: the others go on, and the report
    says quota, no_key or error with its kind."""
    failed = {n: e for n, e in sources.items() if isinstance(e, Exception)}
    sources = {n: df for n, df in sources.items() if n not in failed}
    if not sources:
        raise ValueError("every source failed: " + ", ".join(failed))
    rows = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    spark = rows.sparkSession
    asked = spark.createDataFrame([(n,) for n in sources], "source string")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    report = asked.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "empty").otherwise("").alias("why"))
    if failed:
        report = report.unionByName(spark.createDataFrame([(n, 0, why_failed(e)) for n, e in failed.items()], "source string, n bigint, why string"))
    return rows, report


def why_failed(error: Exception) -> str:
    """quota, no_key or error with its kind, by what a failure says."""
    said = str(error).lower()
    if any(w in said for w in ("quota", "run out of searches", "429", "limit")):
        return "quota"
    return "no_key" if "key" in said and any(w in said for w in ("missing", "no ", "invalid", "unset")) else f"error:{type(error).__name__}"


def with_fallback(found: DataFrame, wider) -> DataFrame:
    """The rows found, or those of a wider search where there are none."""
    return wider() if found.isEmpty() else found


def search_place(c: Column) -> Column:
    """A location to search at: blank where the words name no place."""
    return F.when(F.lower(F.trim(text(c))).isin(*NO_PLACE), "").otherwise(F.trim(text(c)))


def search_key(titles: Column, location: Column) -> Column:
    return F.concat(F.array_join(F.array_sort(F.transform(titles, lambda t: F.lower(t))), ","), F.lit("|"), F.lower(text(location)))


def rows_in_order(df: DataFrame, key: str, asked: Sequence[str]) -> DataFrame:
    """The rows of the asked keys in the asked order; keys that aren't there drop. The asked side is a literal of bounded size."""
    if len(asked) > 10_000:
        raise ValueError("more keys than a literal should hold; join a table instead")
    want = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(asked)], f"{key} string, pos int")
    return df.where(F.col(key).isin(*asked)).join(want, key).orderBy("pos")


def check_keys(asked: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """(key, found): the asked keys, once each, and whether the table has them; however many are asked. Blank keys drop."""
    want = asked.where(F.trim(text(F.col(key))) != "").select(key).distinct()
    return want.join(df.select(F.col(key), F.lit(True).alias("found")).distinct(), key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def liveness(jobs: DataFrame, statuses: DataFrame, now: Column) -> DataFrame:
    """Listings after probes (url, http_status): gone ones drop, answering ones are seen now, others stay as they are."""
    s = statuses.groupBy("url").agg(F.max("http_status").alias("__s"))
    j = jobs.join(s, "url", "left").where(F.col("__s").isNull() | ~F.col("__s").isin(404, 410))
    return j.withColumn("last_seen", F.when(F.col("__s").between(200, 399), now).otherwise(F.col("last_seen"))).drop("__s")


def sanitize_messages(messages: DataFrame) -> DataFrame:
    """Messages of known roles with text, at most 4000 characters each."""
    return messages.where(F.col("role").isin("user", "assistant") & (F.trim(text(F.col("content"))) != "")).withColumn("content", F.substring("content", 1, 4000))


def over_turn_cap(messages: DataFrame, conversation: str, cap: int = 24) -> DataFrame:
    return messages.groupBy(conversation).agg(F.count_if(F.col("role") == "user").alias("turns")).withColumn("over", F.col("turns") > cap)


def judged(first: Column, second: Column, a: Column, b: Column) -> Column:
    """The winner of a pair judged in both orders: NULL unless the verdicts agree."""
    verdict = lambda c: F.upper(F.get_json_object(F.regexp_extract(text(c), r"(?s)\{.*\}", 0), "$.winner"))
    return F.when((verdict(first) == "A") & (verdict(second) == "B"), a).when((verdict(first) == "B") & (verdict(second) == "A"), b)


def field_scores(cases: DataFrame, sets: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """Scores of extracted fields against gold (pred_x, gold_x): set fields by F1, scalars by equality after normalising;
    overall is the mean over fields that gold states; a case without an answer has responded = false and no scores."""
    from boardwright.operators.analytics import set_f1

    norm = lambda c: F.lower(F.trim(F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}]+", " ")))
    scored = {f: F.when(F.col(f"gold_{f}").isNotNull(), set_f1(F.col(f"pred_{f}"), F.col(f"gold_{f}"))) for f in sets}
    scored |= {f: F.when(F.col(f"gold_{f}").isNotNull(), F.when(F.col(f"pred_{f}").isNull(), 0.0).otherwise((norm(F.col(f"pred_{f}")) == norm(F.col(f"gold_{f}"))).cast("double"))) for f in scalars}
    df = cases.select("*", *[F.when(F.col("responded"), c).alias(f"score_{f}") for f, c in scored.items()])
    given = F.array_compact(F.array(*[F.col(f"score_{f}") for f in scored]))
    return df.withColumn("overall", F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.size(given)))


def model_report(scores: DataFrame, model: str, fields: Sequence[str]) -> DataFrame:
    """Per model: share of cases answered, mean of each field and overall over answered cases, best first."""
    means = [F.avg(f"score_{f}").alias(f) for f in fields]
    return scores.groupBy(model).agg(F.count("*").alias("cases"), F.avg(F.col("responded").cast("double")).alias("reliability"), F.avg("overall").alias("quality"), *means).orderBy(F.desc("quality"), F.desc("reliability"), model)
