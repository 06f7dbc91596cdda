from collections import Counter

from boardwright.plans import boards, listings

SEVEN = ("category", "employment_type", "remote", "seniority", "salary_band", "state", "apply_via")


def _counts(rows):
    out = Counter()
    for r in rows:
        via = "" if r.direct_apply is None else "employer" if r.direct_apply else "aggregator"
        for f in SEVEN:
            if v := via if f == "apply_via" else r[f]:
                out[f, v] += 1
    return dict(out)


def test_all_seven_facets_are_counted(spark, sf):
    rows = listings.jobs(spark, sf).collect()
    want = _counts(rows)
    assert {"state", "apply_via"} <= {f for f, _ in want}
    assert {(r.facet, r.value): r.n for r in listings.facet_counts(spark, sf).collect()} == want
    shown = {f: (k, sum(n for (g, _), n in want.items() if g == f)) for f, k in Counter(f for f, _ in want).items() if k >= 2}
    assert {r.facet: (r.n_values, r.n_rows) for r in listings.facet_groups_shown(spark, sf).collect()} == shown
    urls = {r.url for r in boards.board_delivered(spark, sf).collect()}
    assert {(r.facet, r.value): r.n for r in boards.board_facets(spark, sf).collect()} == _counts(r for r in rows if r.url in urls)


def test_bands_of_pay_are_counted(spark):
    df = spark.createDataFrame([(None, None, None, None, b, None, None) for b in ("50-80k", "50-80k", "")], ", ".join(f"{f} string" for f in SEVEN))
    assert [(r.facet, r.value, r.n) for r in listings.board.facet_counts(df).collect()] == [("salary_band", "50-80k", 2)]
