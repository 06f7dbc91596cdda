import pytest
from pyspark.sql import functions as F

from boardwright.functions import text as X
from boardwright.functions import vocab as V
from boardwright.operators import board as B

ACCEPTS = [("rag", "we use rag pipelines"), ("supply chain", "global supply chains"), ("end to end", "end-to-end ownership"), ("sql", "sql, python"), ("agent", "an agent")]
REJECTS = [("rag", "leverage cloud storage"), ("excel", "excellent people"), ("agent", "agentic systems"), ("supply chain", "chain of supply")]


@pytest.mark.parametrize("term,body,want", [(*a, True) for a in ACCEPTS] + [(*r, False) for r in REJECTS])
def test_terms(spark, term, body, want):
    assert spark.range(1).select(X.has_term(term, F.lit(body))).first()[0] is want


def test_hits_do_not_overlap(spark):
    assert spark.range(1).select(X.term_hits("rag", F.lit("rag and rag and more rag"))).first()[0] == 3
    assert spark.range(1).select(X.term_hits("  ", F.lit("x"))).first()[0] == 0


TIERS = [
    ("Senior AI Product Builder", 100), ("senior  ai   product builder", 100), ("AI Product Builder, Senior", 80), ("Staff AI Product Builder", 60), ("Principal AI Product Builder", 60), ("AI Product Manager", 0), ("Registered Nurse", 0), ("", 0), (None, 0),
]


def test_tiers(spark):
    df = spark.createDataFrame(TIERS, "title string, want int")
    got = df.select("title", "want", B.title_tier("Senior AI Product Builder", X.norm_key(F.col("title"))).alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def _score(spark, rows, doc):
    df = spark.createDataFrame([(*r, "http://x/%d" % i) for i, r in enumerate(rows)], "title string, title_root string, company string, body string, url string")
    return {r.url[-1]: r for r in B.scoreboard(df, B.Query.of(doc)).collect()}


def test_scoreboard_parts_and_penalties(spark):
    rows = [
        ("High School Teacher", None, "A", "rag rag rag rag rag"), ("Teacher", None, "A", None), ("Client Success Director", None, "B", None), ("X", None, "TechTree's client", None), ("X", None, "A", "we help our clients transform"), ("X", None, "A", "our client is seeking"), (None, None, None, None),
    ]
    got = _score(spark, rows, {"titles": ["High School Teacher", "Client Success Director"], "related_titles": "Teacher", "boosts": "rag", "rank_down": ["our client", "client"]})
    assert [got[k].points for k in "0123456"] == [120, 30, 100, -30, 0, -15, 0]
    assert got["1"].parts[0].label == "related title" and got["0"].why == "title, rag ×5"
    assert all(sum(p.delta for p in r.parts) == r.points for r in got.values())


def test_exclusion_of_a_wanted_title_is_dropped():
    assert B.Query.of({"titles": "Night Auditor", "exclude": "night, weekend"}).exclude == ["weekend"]


def test_eligible_runs_before_dedupe(spark):
    df = spark.createDataFrame([("u1", "Dev", "A", "long body here", "onsite", None, 0), ("u2", "dev", "a.", "short", "remote", "garbage", 1), ("u3", None, None, "x", "remote", "2020-01-01", 2), ("u4", "", "", "y", "remote", None, 3)], "url string, title string, company string, body string, remote string, posted string, place int")
    q = B.Query.of({"titles": [], "remote_only": True, "max_age_days": 30})
    kept = B.eligible(df, q, F.to_date(F.lit("2026-01-01")))
    got = B.dedupe_listings(kept, "place").collect()
    assert {r.url for r in got} == {"u2", "u4"}
    all_ = {r.url: r.place for r in B.dedupe_listings(df, "place").collect()}
    assert all_ == {"u1": 0, "u3": 2, "u4": 3}


def test_facets(spark):
    df = spark.createDataFrame([("Sales", "remote"), ("Sales", None), ("", "onsite"), (None, "remote"), ("Design", "hybrid")], "category string, remote string")
    got = {(r.facet, r.value): r.n for r in B.facet_counts(df, ["category", "remote"]).collect()}
    assert got == {("category", "Sales"): 2, ("category", "Design"): 1, ("remote", "remote"): 2, ("remote", "onsite"): 1, ("remote", "hybrid"): 1}
    assert df.where(B.passes_facets({"category": ["Sales"], "remote": ["remote"]})).count() == 3
    assert {r.facet: r.n for r in B.exemptions(df, {"category": ["Sales"], "remote": ["remote"]}).collect()} == {"category": 1, "remote": 1}


def test_vocabularies(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for raw, want in (("IT Jobs", "Software Engineering"), ("Engineering Jobs", "Science and Engineering"), ("Customer Support &amp; Success", "Customer Service"), ("Graduate Jobs", None), ("Installation, Maintenance, and Repairs", "Installation, Maintenance, and Repairs"), ("nonsense, Legal", "Legal Services"), (None, None)):
        assert one(V.category(F.lit(raw).cast("string"))) == want, raw
    for raw, want in (("Entry-level, Mid-level", "entry"), ("Senior, Director", "senior"), ("Executive, Mid-level", "mid"), ("boss", None)):
        assert one(V.seniority(F.lit(raw))) == want, raw
    assert [one(V.us_state(F.lit(x))) for x in ("Mass", "New  Mexico", "tx", "Ontario", "Washington, D.C.")] == ["MA", "NM", "TX", None, "DC"]
    for raw, want in (("$255k – $290k", 255000), ("$200-260K", 200000), ("$300 - $350K", 300000), ("$150,000 - 200K", 150000), ("$401K – $445K", 401000), ("$171,000 – $256,400", 171000), ("none", None), (",,,", None)):
        assert one(V.first_figure(F.lit(raw))) == want, raw
    assert one(V.annual_salary(F.lit(93.0), F.lit(""), F.lit("hour"))) == 93 * 2080
    assert one(V.annual_salary(F.lit(33.0), F.lit("USD"), F.lit(""))) is None and one(V.annual_salary(F.lit(148000.0), F.lit(None), F.lit(None))) == 148000
    assert one(V.salary_band(F.lit(171000.0))) == "120-180k"


def test_html(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    body = "<script>x</script><p>One</p><ul><li>Two &amp; <b>three</b></li></ul><br/>**bold**"
    assert [x.strip() for x in one(X.html_plain(F.lit(body))).split("\n")] == ["One", "Two & three", "bold"]
    assert one(X.html_plain_text(F.lit("<p>One</p><p>Two&nbsp;&#8217;s</p> a < b <a href='x"))) == "One Two ’s a < b"
    assert one(X.html_plain_text(F.lit(None).cast("string"))) == ""


def test_porter():
    for w, s in {"engineering": "engin", "engineer": "engin", "deployment": "deploy", "caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall", "sky": "sky", "happy": "happi", "adjustable": "adjust", "controll": "control"}.items():
        assert X.porter(w) == s, (w, X.porter(w))
