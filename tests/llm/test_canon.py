from hypothesis import given, settings
from hypothesis import strategies as st

from boardwright.llm import canon as C

TITLES = [(1, "Accountant"), (2, "Account Manager"), (3, "Chief of Staff"), (4, "Registered Nurse"), (5, "Software Engineer"), (6, "Sous Chef"), (7, "Customer Service Representative")]
PLACES = [(1, "Austin, TX, US", "Austin", "TX", "US"), (2, "Portland, OR, US", "Portland", "OR", "US"), (3, "Portland, ME, US", "Portland", "ME", "US"), (4, "Paris, Ile-de-France, FR", "Paris", "Ile-de-France", "FR"), (5, "Munich, Bavaria, DE", "Munich", "Bavaria", "DE")]
TITLE_CASES = [
    ("Sr. Acocuntant (Night Shift)", 1), ("Manager, Account - Req #123", 2), ("Staff Chief of Staff", 3), ("Staff, Chief of | Contract", 3), ("R.N.", 4), ("Lead Account Mgr.", 2), ("m/w/d: SW Engineer II", 5), ("customer care rep", 7), ("Rotating Cheese Cave Tamer", 0), ("Buchhalter", 1), ("asdf 12", 0), ("x" * 5000, 0), ("!!!", 0),
]
PLACE_CASES = [
    ("austin tx", 1), ("Remote - Austn, Texas", 1), ("United States-Texas-Austin", 1), ("Portland, Maine", 3), ("Oregon - Portland", 2), ("Paris, TX", 0), ("Paris (France)", 4), ("München", 5), ("Greater Munich Area", 5), ("Somewhere Falls, TX", 0), ("Remote", 0), ("Austin, TX 78701", 1), ("near Austin, Texas / Remote", 1), ("-", 0),
]


def test_titles():
    m = C.TitleMap(TITLES, {})
    assert [(v, m.resolve(v)) for v, _ in TITLE_CASES] == TITLE_CASES


def test_places():
    m = C.PlaceMap(PLACES, {2: 9})
    assert [(v, m.resolve(v)) for v, _ in PLACE_CASES] == PLACE_CASES
    assert m.resolve("Portland") == 2  # the more frequent one


def test_long_values():
    """Beyond what earlier versions read: many words, many additions, very long texts."""
    t = C.TitleMap(TITLES, {})
    assert t.resolve("senior lead staff head chief associate remote night shift temp seasonal urgent contract accountant ii level") == 1
    assert t.resolve("staff staff associate lead chief of staff contractor contract") == 3
    assert t.resolve("remote " * 3000 + "Registered Nurse") == 4 and t.resolve("staff " * 400) == 0
    p = C.PlaceMap(PLACES, {})
    assert p.resolve("Greater Munich Metropolitan Area near downtown and suburbs, office location in the region of Bavaria, Germany, hybrid home office") == 5
    assert p.resolve("remote " * 3000 + "Austin, TX") == 1 and p.resolve("remote " * 3000) == 0 and p.resolve("austin " * 2000) == 0


def test_lists_in_blocks(spark, monkeypatch):
    titles = spark.createDataFrame([(k, f"Occupation {w} Number {k}") for k, w in enumerate(f"{a}{b}{c}" for a in ("bal", "ker", "mot", "zin") for b in ("dar", "fel", "gos") for c in ("ta", "li"))], "ref_id bigint, label string")
    typed = [(f"u{r.ref_id}", f"number {r.ref_id} ocupation {r.label.split()[1]}") for r in titles.collect()] + [("x", "nothing alike"), ("y", None), ("z", "Occupation baldarta Number 0")]
    df = spark.createDataFrame(typed, "url string, title string")
    run = lambda: {tuple(r) for r in C.map_values(df, "title", titles, "title", ["url"]).collect()}
    want = run()
    assert {(f"u{k}", k) for k in range(24)} <= want and ("x", 0) in want and ("y", None) in want and ("z", None) in want
    monkeypatch.setattr(C, "BLOCK_ENTRIES", 7)
    assert run() == want


def _dl(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


WORDS = ["accountant", "actuary", "baker", "banker", "barista", "chemist", "dentist", "machinist", "optometrist"]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(WORDS), st.integers(0, 11), st.sampled_from("abcdeirst"), st.integers(0, 3))
def test_symmetric_delete_finds_what_brute_force_finds(word, at, ch, kind):
    at = min(at, len(word) - 1)
    typed = [word[:at] + word[at + 1 :], word[:at] + ch + word[at:], word[:at] + ch + word[at + 1 :], word[:at] + word[at : at + 2][::-1] + word[at + 2 :]][kind]
    s = C.SymmetricDelete()
    for w in WORDS:
        s.add(w, w)
    found = {p for _, p in s.find(typed)}
    if typed in WORDS:
        assert typed in found
    else:
        near = {w for w in WORDS if _dl(typed, w) <= 1 and _dl(typed, w) <= C.allowed(len(w))}
        assert near <= found and all(_dl(typed, w) <= C.DISTANCE for w in found)


def test_fields(spark):
    titles = spark.createDataFrame(TITLES, "ref_id bigint, label string")
    places = spark.createDataFrame(PLACES, "ref_id bigint, label string, city string, region_code string, country string")
    data = [("u1", "Accountant", "accountants", None, 5), ("u1", "Accountant", "accountants", None, 6), ("u2", " ", "", "Austin, TX, US", None), ("u3", None, "Accountant", "Austin", None), (None, "accountant", None, None, None)]
    jobs = spark.createDataFrame(data, "url string, title string, title_root string, location string, ref_id int")
    got = {tuple(r) for r in C.canonical_fields(jobs, titles, places).collect()}
    assert got == {("u1", "title_root", 1), ("u3", "location", 1), (None, "title", 1)}
    assert C.canonical_fields(jobs.limit(0), titles, places).count() == 0
    assert {r.ref_id for r in C.canonical_fields(jobs, titles.limit(0), places.limit(0)).where("url = 'u1'").collect()} == {0}
