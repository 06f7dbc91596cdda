import hashlib

from boardwright.plans import listings


def test_bodies_without_markup_are_made_plain_too(spark, sf, tmp_path):
    bodies = ["<p>a  b</p>", " a  b\n\n\nc ", "**bold** &amp; plain", "## head", "", None]
    rows = spark.createDataFrame([(f"https://x.example/{i}", b) for i, b in enumerate(bodies)], "url string, body string")
    rows.selectExpr("*", "current_timestamp() AS last_seen", "current_timestamp() AS fetched_at").write.parquet(f"{tmp_path}/jobs.parquet")
    want = ["a b", "a b\nc", "bold & plain", "head", "", ""]
    got = {r.url: r.digest for r in listings.html_plain(spark, str(tmp_path)).collect()}
    assert got == {f"https://x.example/{i}": hashlib.md5(w.encode()).hexdigest() for i, w in enumerate(want)}
    assert listings.html_plain(spark, sf).count() == listings.jobs(spark, sf, ["url"]).count()
