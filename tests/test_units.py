import pytest

from boardwright.operators import units as U

PAY = [
    ("$70 – 77k", (70000, 77000, "$", None)), ("58.000 EUR", (58000, 58000, "EUR", None)), ("65'000 CHF", (65000, 65000, "CHF", None)), ("109 000 EUR", (109000, 109000, "EUR", None)), ("₹1,44,10,000", (14410000, 14410000, "INR", None)), ("年収2290万円〜3306万円", (22900000, 33060000, "JPY", "year")),
    ("46.4-58.1 LPA", (4640000, 5810000, "INR", "year")), ("USD 13–17 p/h", (13, 17, "USD", "hour")), ("4,260 pcm", (4260, 4260, None, "month")), ("1,830 every two weeks", (1830, 1830, None, "fortnight")), ("ab 7 500 € im Monat", (7500, 7500, "EUR", "month")), ("$150,000 - 200K", (150000, 200000, "$", None)),
    ("¥4.86M - ¥5.1M per annum", (4860000, 5100000, "JPY", "year")), ("A$57.25 - 67 hourly", (57.25, 67, "AUD", "hour")), ("$401K – $445K", (401000, 445000, "$", None)), ("28.04m - 36.69m/year", (28040000, 36690000, None, "year")),
    ("Competitive + 401k match", None), ("401(k) with 4% match", None), ("Up to 2 bonuses", None), ("Depends on experience (10+ yrs)", None), ("$0", None), ("$$$", None), ("VB", None), ("", None),
]


@pytest.mark.parametrize("text,want", PAY)
def test_parse(text, want):
    got = U.parse_pay(text)
    assert (got is None) == (want is None)
    if want:
        assert got[:2] == pytest.approx(want[:2]) and got[2:] == want[2:]


def test_ambiguous_units_by_their_place():
    assert U.segment("m", "number") == (("prefix", 1e6),)
    assert U.segment("/m", "number")[-1] == ("period", "month")
    assert U.segment("lpa", "number") == (("prefix", 1e5), ("period", "year"))


def test_yearly(spark):
    feeds = spark.createDataFrame([("us", "USD"), ("ca", "CAD"), ("de", "EUR")], "source string, currency string")
    units = spark.createDataFrame([("period", "year", 1.0), ("period", "hour", 2080.0), ("currency", "USD", 1.0), ("currency", "CAD", 0.731), ("currency", "EUR", 1.085)], "unit_kind string, unit_code string, factor double")
    data = [("1", "$50,000", "ca", None, None), ("2", "$50,000", "de", None, None), ("3", "20", "de", None, "HOUR"), ("4", "20", "de", None, None), ("5", "20000", " US ", "eur", ""), ("6", None, "us", None, None), ("7", "50k", None, None, None), ("8", "9" * 2000, "us", None, None), ("1", "$50,000", "ca", None, None)]
    jobs = spark.createDataFrame(data, "url string, salary string, source string, salary_currency string, salary_period string")
    got = {tuple(r) for r in U.yearly_pay(jobs, feeds, units).collect()}
    assert got == {("1", 36550, 36550), ("2", 50000, 50000), ("3", 45136, 45136), ("5", 21700, 21700)}
    assert U.yearly_pay(jobs.limit(0), feeds, units).count() == 0


def test_long_texts_are_read_whole():
    words = "we are a friendly team of makers and menders who like to plan ahead " * 40
    assert U.parse_pay(f"$50,000 per year. {words}")[:2] == (50000, 50000)
    assert U.parse_pay("Team A: $21 per hour; " + "; ".join(f"step {i}: ${20 + i} per hour" for i in range(1, 30)))[3] == "hour"
    assert U.parse_pay(" " * 3000 + "58.000 EUR" + " " * 3000)[:3] == (58000, 58000, "EUR")
    assert U.segment("m" + " " * 50_000, "number") == (("prefix", 1e6),)
