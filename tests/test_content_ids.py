import hashlib
import re

from boardwright.functions.text import ENTITIES
from boardwright.operators import dense
from boardwright.plans import listings
from boardwright.plans import retrieval as R


def _plain(body):
    t = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", body or "")
    t = re.sub(r"(?i)</(li|p|div|h[1-6]|tr|ul|ol)\s*>|<br\s*/?>", "\n", t)
    t = re.sub(r"<[^>]+>", " ", t)
    for entity, plain in ENTITIES.items():
        t = t.replace(entity, plain)
    t = re.sub(r"(?m)^#{1,4}\s*", "", re.sub(r"\*\*([^*\n]+)\*\*", r"\1", t))
    return re.sub(r"\n\s*\n+", "\n", re.sub(r"[ \t]+", " ", t)).strip(" \t\n\r\f\v")


def _content_id(r):
    some = lambda v: v is not None and v.strip(" ") != ""
    head = [r.title] if some(r.title) else []
    head += [r.title_root] if some(r.title_root) and r.title is not None and r.title_root.lower() != r.title.lower() else []
    head += [", ".join(r.title_qualifiers[:4])] if r.title_qualifiers else []
    line = [f"{n}: {v}" for n, v in (("Company", r.company), ("Team", r.team), ("Field", r.category), ("Location", r.location)) if some(v)]
    tags = ["Tags: " + ", ".join(r.tags[:8])] if r.tags else []
    text = "\n".join([" · ".join(head), " · ".join(line), *tags, _plain(r.body)[:1800]])
    return hashlib.sha1(r.url.encode() + b"\0" + text.encode()).hexdigest()


def test_content_ids_hold_qualifiers_and_the_body_without_markup(spark, sf):
    rows = listings.jobs(spark, sf).collect()
    assert any(r.title_qualifiers for r in rows) and any("<" in (r.body or "") for r in rows)
    assert {r.url: r.content_id for r in R.content_ids(spark, sf).collect()} == {r.url: _content_id(r) for r in rows}


def test_vectors_are_synchronised_by_content_ids(spark, sf, monkeypatch):
    seen = []
    plan = R.pool.sync_plan
    monkeypatch.setattr(R.pool, "sync_plan", lambda now, old, *a: seen.append(now) or plan(now, old, *a))
    R.vector_sync(spark, sf)
    ids = {r.url: r.content_id for r in R.content_ids(spark, sf).collect()}
    now = seen[0].collect()
    assert now and all(r.cid == ids[r.url] for r in now)


def test_summary_changes_with_the_fifth_line_of_a_marked_up_body(spark):
    row = "named_struct('title', 't', 'root', 't', 'q', {q}, 'company', 'c', 'team', '', 'category', '', 'location', '', 'tags', array(), 'body', {b})"
    text = lambda q, b: spark.sql(f"SELECT inline(array({row.format(q=q, b=b)}))").select(dense.summary_text("title", "root", "q", "company", "team", "category", "location", "tags", "body").alias("s")).first().s
    assert text("array('a', 'b', 'c', 'd', 'e')", "'x'") == "t · a, b, c, d\nCompany: c\nx"
    assert text("array()", "concat(repeat('<b></b>', 600), 'end')") == "t\nCompany: c\nend"
