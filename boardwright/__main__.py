"""python -m boardwright COMMAND ...: the batch jobs of the engine over stored tables, each printing what it did.

    index JOBS FOLDER                     write the search index of a pool
    search JOBS --titles A,B [--index F]  a board as JSON lines
    snapshot RAW OUT                      raw JSON lines to a published table, with its meta
    import FOLDER STORE STATE             merge new snapshot files into a stored pool
    evict JOBS OUT [--statuses S]         probe outcomes first, then eviction
    resolve COMPANIES JOBS                --stats, --audit, --due N, or --quarantine BAD --out OUT
    discover MINED COMPANIES              boards that the ledger doesn't know, in turns of their providers
    mine URLS OUT                         boards from crawled urls, with the reasons of those left out
    vectors JOBS IDS OUT                  sync stored content ids; --limit N, --dry-run
    rebuild OLD OUT                       carry a store's rows into this version's columns
    review LOG                            failures, rungs and worst searches of a search log
    dry-run BEFORE AFTER CHECKED          the funnel of a trial resolution

A cluster is set up by spark-submit; without one the session is local.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwright import api
from boardwright.operators import analytics, board, dense, gates, ledger, pool, stores, universe
from boardwright.schema import JOBS, RAW
from boardwright.sources import files
from boardwright.streaming.imports import import_snapshots

SUMMARY = ["title", "title_root", "title_qualifiers", "company", "team", "category", "location", "tags", "body"]
LOG = "ts string, titles array<string>, delivered bigint, score_max bigint, degraded string, probe boolean, top array<struct<t string, co string, p bigint, tier bigint>>"


def _say(df: DataFrame, most: int = 1_000) -> None:
    """Rows as JSON lines; these results are short by nature."""
    for line in df.limit(most).toJSON().collect():
        print(line)


def _pool(spark: SparkSession, path: str) -> DataFrame:
    return pool.latest(spark.read.parquet(path), "url", ["last_seen", "fetched_at"])


def _now(args) -> object:
    return F.to_timestamp(F.lit(args.now)) if args.now else F.current_timestamp()


def index(spark, args):
    api.Engine(_pool(spark, args.jobs)).save_index(args.folder)


def search(spark, args):
    got = api.engine(spark, args.jobs, index_path=args.index).score({"titles": args.titles, "boosts": args.boosts or "", "exclude": args.exclude or "", "location": args.location, "limit": args.limit})
    _say(got.jobs.select("url", "title", "company", "points", "why"))
    print(json.dumps(got.meta()))


def snapshot(spark, args):
    from boardwright.operators import intake

    raw = files.read_lines(spark, args.raw, RAW).where("_corrupt_record IS NULL").drop("_corrupt_record")
    rows = intake.normalise(raw, _now(args))
    files.publish_table(rows, args.out)
    _say(intake.snapshot_meta(rows, pool.reject_reason().isNull()))


def import_(spark, args):
    import_snapshots(spark, args.folder, args.store, args.state, args.now or "now", args.every)


def evict(spark, args):
    jobs = _pool(spark, args.jobs)
    statuses = spark.read.parquet(args.statuses) if args.statuses else spark.createDataFrame([], "url string, http_status int")
    kept = stores.upkeep(jobs, statuses, _now(args), [p for p in (args.polled or "").split(",") if p])
    files.publish_table(kept, args.out)
    print(json.dumps({"before": jobs.count(), "kept": files.current_table(spark, args.out).count()}))


def resolve(spark, args):
    companies, jobs = spark.read.parquet(args.companies), _pool(spark, args.jobs)
    if args.audit:
        _say(ledger.audit(companies, ledger.evidence(jobs)).groupBy("agrees").count())
    if args.due:
        _say(ledger.due(companies, jobs.where("trim(company) <> ''").groupBy("company").agg(F.count("*").alias("n")), _now(args)).orderBy(F.desc("n"), "name_key").limit(args.due), args.due)
    if args.quarantine:
        files.publish_table(ledger.quarantine(companies, spark.read.parquet(args.quarantine), _now(args)), args.out)
    if args.stats or not (args.audit or args.due or args.quarantine):
        _say(companies.groupBy(F.lower("status").alias("status")).count().orderBy("status"))


def discover(spark, args):
    new = universe.unknown_boards(spark.read.parquet(args.mined), [spark.read.parquet(args.companies).where("slug IS NOT NULL")])
    _say(analytics.interleave(new.select("ats", "slug"), "ats", ["slug"], args.budget), args.budget)


def mine(spark, args):
    found = analytics.mine_boards(spark.read.text(args.urls).select(F.trim("value").alias("url")), "url")
    files.publish_table(found.where("junk IS NULL"), args.out)
    _say(found.groupBy(F.coalesce("junk", F.lit("kept")).alias("reason")).count())


def vectors(spark, args):
    now = _pool(spark, args.jobs).select("url", dense.content_id(F.col("url"), dense.summary_text(*SUMMARY)).alias("cid"))
    old = files.current_table(spark, args.ids) if args.ids != "none" else now.limit(0)
    plan = pool.sync_plan(now, old, "url", "cid")
    if not args.dry_run:
        files.publish_table(stores.apply_sync(old, plan, now, "url", args.limit), args.out)
    _say(plan.groupBy("action").count())


def rebuild(spark, args):
    files.publish_table(files.carry_forward(spark.read.parquet(args.old), JOBS), args.out)
    new = files.current_table(spark, args.out)
    _say(analytics.fill_rates(new, [c for c in ("title_root", "category", "seniority", "location") if c in new.columns]))


def review(spark, args):
    good, bad = files.recent_lines(spark, args.log, LOG, "ts", args.since)
    log = good if args.include_probes else gates.demand(good)
    _say(bad)
    _say(gates.search_failures(log))
    _say(gates.rung_histogram(log).orderBy(F.desc("rung")))
    _say(log.orderBy("delivered", F.coalesce("score_max", F.lit(0)), "ts").limit(args.worst).select("ts", "titles", "delivered", "score_max"))


def dry_run(spark, args):
    before, after, checked = (spark.read.parquet(p) for p in (args.before, args.after, args.checked))
    _say(gates.funnel(before, after, checked, after.where("lower(status) = 'unresolved'"), "name_key", args.seconds, args.backlog))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="boardwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def add(run, name: str, *places: str, **options):
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        for x, kw in options.items():
            c.add_argument("--" + x.replace("_", "-"), **kw)
        c.add_argument("--now")
        c.set_defaults(run=run)

    flag = {"action": "store_true"}
    add(index, "index", "jobs", "folder")
    add(search, "search", "jobs", titles={"required": True}, boosts={}, exclude={}, location={}, index={}, limit={"type": int, "default": 200})
    add(snapshot, "snapshot", "raw", "out")
    add(import_, "import", "folder", "store", "state", every={})
    add(evict, "evict", "jobs", "out", statuses={}, polled={})
    add(resolve, "resolve", "companies", "jobs", stats=flag, audit=flag, due={"type": int}, quarantine={}, out={})
    add(discover, "discover", "mined", "companies", budget={"type": int, "default": 500})
    add(mine, "mine", "urls", "out")
    add(vectors, "vectors", "jobs", "ids", "out", limit={"type": int}, dry_run=flag)
    add(rebuild, "rebuild", "old", "out")
    add(review, "review", "log", since={}, worst={"type": int, "default": 10}, include_probes=flag)
    add(dry_run, "dry-run", "before", "after", "checked", seconds={"type": float, "default": 0.0}, backlog={"type": int, "default": 0})
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("boardwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
