"""The ledger of employers: due queue, merge of outcomes, evidence and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwright.functions.text import norm_key, text

# What a probe's outcome makes of a ledger row; outcomes not named leave no trace.
OUTCOMES = {"verified": "resolved", "refused": "dead", "missing": "unresolved", "empty": "unresolved", "wrong-owner": "unresolved", "unsupported": "unresolved"}
#: States that another probe doesn't overwrite with a worse one.
KEEPS = "resolved"
_SUFFIX = r"( (inc|llc|ltd|plc|gmbh|co|corp|corporation|company|limited))+$"


def company_key(c: Column) -> Column:
    """Lower case, without punctuation and legal form at the end."""
    return F.regexp_replace(norm_key(c), _SUFFIX, "")


def due(companies: DataFrame, counts: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """(name_key, name, n) of employers to probe: never seen ones, and unresolved ones not checked for `days`; the most
    listings first. The first spelling in count order stands for its key."""
    best = counts.withColumn("name_key", company_key(F.col("company"))).where("name_key <> ''").groupBy("name_key").agg(F.max_by("company", F.struct("n", "company")).alias("name"), F.sum("n").alias("n"))
    known = companies.select("name_key", "status", "checked_at")
    again = F.col("status").isNull() | ((F.lower("status") == "unresolved") & (F.coalesce("checked_at", F.to_timestamp(F.lit("1970-01-01"))) < now - F.make_dt_interval(days=F.lit(days))))
    return best.join(known, "name_key", "left").where(again).select("name_key", "name", "n")


def record(companies: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after probes (name_key, outcome, at): attempts grow, resolved rows don't fall back, the last probe counts.
    Outcomes may bring a column `key`, such as a board's, under which a row is kept in place of its name."""
    if "key" in outcomes.columns:
        outcomes = outcomes.withColumn("name_key", F.coalesce(F.nullif("key", F.lit("")), "name_key"))
    table = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    seen = outcomes.withColumn("new_status", F.try_element_at(table, F.col("outcome"))).where("new_status IS NOT NULL")
    seen = seen.groupBy("name_key").agg(F.max_by("new_status", F.struct("at", "new_status")).alias("new_status"), F.max("at").alias("at"), F.count("*").alias("tries"))
    j = companies.select("name_key", F.lower("status").alias("status"), "attempts", "checked_at").join(seen, "name_key", "full_outer")
    status = F.when(F.col("new_status").isNull(), F.col("status")).when((F.col("status") == KEEPS) & (F.col("new_status") != KEEPS), F.col("status")).otherwise(F.col("new_status"))
    return j.select("name_key", status.alias("status"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("tries", F.lit(0))).alias("attempts"), F.coalesce("at", "checked_at").alias("checked_at"))


def evidence(jobs: DataFrame) -> DataFrame:
    """(company, boards): the sorted set of (ats, slug) that the URLs of an employer's listings name."""
    host = F.lower(F.parse_url(F.col("url"), F.lit("HOST")))
    ats, slug = F.split_part(host, F.lit("."), F.lit(1)), F.split_part(F.ltrim(F.parse_url(F.col("url"), F.lit("PATH")), F.lit("/")), F.lit("/"), F.lit(1))
    rows = jobs.where(F.trim(text(F.col("company"))) != "").select("company", F.struct(ats.alias("ats"), slug.alias("slug")).alias("b")).where("b.ats IS NOT NULL")
    return rows.groupBy("company").agg(F.array_sort(F.collect_set("b")).alias("boards"))


def audit(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """(name_key, agrees): whether a resolved row's board is among the boards its listings name; without listings no row."""
    r = companies.where(F.lower(F.trim("status")) == "resolved").select("name_key", "name", "ats", "slug")
    return r.join(boards, r["name"] == boards["company"]).select("name_key", F.exists("boards", lambda b: (b["ats"] == F.col("ats")) & (b["slug"] == F.col("slug"))).alias("agrees"))


def board_key(ats: Column, slug: Column, site: Column | None = None) -> Column:
    return F.concat_ws("/", F.concat_ws(":", F.lit("board"), ats, slug), site) if site is not None else F.concat_ws(":", F.lit("board"), ats, slug)


def parse_board_key(c: Column) -> Column:
    """(ats, slug, site) of a board key."""
    rest = F.substring(c, 7, 10_000)
    ats, slug = F.substring_index(rest, ":", 1), F.regexp_replace(rest, "^[^:]*:", "")
    return F.struct(ats.alias("ats"), F.substring_index(slug, "/", 1).alias("slug"), F.when(F.contains(slug, F.lit("/")), F.substring_index(slug, "/", -1)).alias("site"))


def first_seen(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of every key, letter case aside as the key says."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def quarantine(companies: DataFrame, bad: DataFrame, now: Column) -> DataFrame:
    """The ledger with the rows named in `bad` (name_key, reason) quarantined, the reason cut to 120 characters."""
    b = bad.groupBy("name_key").agg(F.min("reason").alias("__r"))
    hit = F.col("__r").isNotNull()
    j = companies.join(b, "name_key", "left")
    return j.withColumn("status", F.when(hit, "quarantined").otherwise(F.col("status"))).withColumn("matched_variant", F.when(hit, F.substring("__r", 1, 120)).otherwise(F.col("matched_variant"))).withColumn("checked_at", F.when(hit, now).otherwise(F.col("checked_at"))).drop("__r")


def recently_probed(companies: DataFrame, prefix: str, now: Column, days: int = 90) -> DataFrame:
    """name_keys under a prefix that were checked within `days`: their outcome, good or bad, still stands."""
    return companies.where(F.startswith("name_key", F.lit(prefix)) & (F.coalesce("checked_at", F.to_timestamp(F.lit("1970-01-01"))) > now - F.make_dt_interval(days=F.lit(days)))).select("name_key")


def least_recent(jobs: DataFrame, polled: list[str], n: int) -> DataFrame:
    """The n listings of sources that aren't polled which were seen longest ago."""
    return jobs.where(~F.col("source").isin(*polled)).select("url", "last_seen").orderBy("last_seen", "url").limit(n)
