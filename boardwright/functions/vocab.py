"""Controlled vocabularies and money fields as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwright.functions.text import text

# A vendor's spelling -> the field it means.
CATEGORIES = {
    "account management": "Account Management", "accounting and finance": "Accounting and Finance",
    "accounting & finance jobs": "Accounting and Finance", "finance": "Accounting and Finance", "accounting": "Accounting and Finance",
    "accounting & auditing": "Accounting and Finance", "finance & accounting": "Accounting and Finance",
    "advertising and marketing": "Advertising and Marketing", "pr, advertising & marketing jobs": "Advertising and Marketing",
    "marketing": "Advertising and Marketing", "content creator": "Advertising and Marketing", "writing & editing": "Advertising and Marketing",
    "animal care": "Animal Care", "business operations": "Business Operations", "admin jobs": "Business Operations",
    "consultancy jobs": "Business Operations", "property jobs": "Business Operations", "charity & voluntary jobs": "Business Operations",
    "administrative": "Business Operations", "operations": "Business Operations", "consulting": "Business Operations",
    "general business": "Business Operations", "customer service": "Customer Service", "customer services jobs": "Customer Service",
    "customer support": "Customer Service", "customer support & success": "Customer Service", "technical support": "Customer Service",
    "data and analytics": "Data and Analytics", "data science": "Data and Analytics", "analyst": "Data and Analytics", "data": "Data and Analytics",
    "design": "Design", "creative & design jobs": "Design", "art & design": "Design", "education": "Education", "teaching jobs": "Education",
    "training": "Education", "food and hospitality services": "Food and Hospitality Services",
    "hospitality & catering jobs": "Food and Hospitality Services", "travel jobs": "Food and Hospitality Services", "healthcare": "Healthcare",
    "healthcare & nursing jobs": "Healthcare", "social work jobs": "Healthcare", "healthcare & medical": "Healthcare",
    "healthcare & medicine": "Healthcare", "health care provider": "Healthcare", "human resources and recruitment": "Human Resources and Recruitment",
    "hr & recruitment jobs": "Human Resources and Recruitment", "human resources": "Human Resources and Recruitment",
    "hr": "Human Resources and Recruitment", "installation, maintenance, and repairs": "Installation, Maintenance, and Repairs",
    "trade & construction jobs": "Installation, Maintenance, and Repairs", "manufacturing jobs": "Installation, Maintenance, and Repairs",
    "domestic help & cleaning jobs": "Installation, Maintenance, and Repairs", "maintenance jobs": "Installation, Maintenance, and Repairs",
    "manufacturing": "Installation, Maintenance, and Repairs", "production": "Installation, Maintenance, and Repairs",
    "legal services": "Legal Services", "legal jobs": "Legal Services", "legal": "Legal Services", "legal & compliance": "Legal Services",
    "management": "Management", "product management": "Product Management", "product": "Product Management",
    "product & operations": "Product Management", "project management": "Project Management", "project & program management": "Project Management",
    "retail": "Retail", "retail jobs": "Retail", "sales": "Sales", "sales jobs": "Sales", "sales & marketing": "Sales",
    "business development": "Sales", "marketing & sales": "Sales", "science and engineering": "Science and Engineering",
    "engineering jobs": "Science and Engineering", "scientific & qa jobs": "Science and Engineering",
    "energy, oil & gas jobs": "Science and Engineering", "engineering": "Science and Engineering", "quality": "Science and Engineering",
    "research": "Science and Engineering", "quality assurance": "Science and Engineering", "hardware engineer": "Science and Engineering",
    "science & research": "Science and Engineering", "software engineering": "Software Engineering", "it jobs": "Software Engineering",
    "information technology": "Software Engineering", "developer": "Software Engineering", "devops": "Software Engineering",
    "software development": "Software Engineering", "it": "Software Engineering", "supply chain": "Supply Chain",
    "logistics & warehouse jobs": "Supply Chain", "purchasing": "Supply Chain", "logistics": "Supply Chain", "distribution": "Supply Chain",
}
# A spelling -> its rung.
SENIORITY = {
    "internship": "intern", "intern": "intern", "entry level": "entry", "entry-level": "entry", "junior": "entry", "associate": "entry",
    "mid level": "mid", "mid-level": "mid", "midweight": "mid", "intermediate": "mid", "senior": "senior", "senior level": "senior",
    "mid-senior level": "senior", "staff": "staff", "principal": "staff", "lead": "lead", "manager": "lead", "director": "director",
    "executive": "executive", "chief": "executive", "vp": "executive", "c-level": "executive",
}
#: Rungs from low to high.
RUNGS = ("intern", "entry", "mid", "senior", "staff", "lead", "director", "executive")
# A spelling -> the kind of employment.
EMPLOYMENT = {
    "full time": "full_time", "fulltime": "full_time", "permanent": "full_time", "part time": "part_time", "parttime": "part_time",
    "contract": "contract", "contractor": "contract", "contract long": "contract", "contract short": "contract", "temporary": "temporary",
    "temp": "temporary", "internship": "internship", "intern": "internship", "freelance": "freelance", "seasonal": "seasonal",
    "flex time": "flexible", "flextime": "flexible", "flexitime": "flexible",
}
# A code or name of a US state or territory -> its postal code.
STATES = {
    "al": "AL", "alabama": "AL", "ak": "AK", "alaska": "AK", "az": "AZ", "arizona": "AZ", "ar": "AR", "arkansas": "AR", "ca": "CA",
    "california": "CA", "co": "CO", "colorado": "CO", "ct": "CT", "connecticut": "CT", "de": "DE", "delaware": "DE", "fl": "FL", "florida": "FL",
    "ga": "GA", "georgia": "GA", "hi": "HI", "hawaii": "HI", "id": "ID", "idaho": "ID", "il": "IL", "illinois": "IL", "in": "IN", "indiana": "IN",
    "ia": "IA", "iowa": "IA", "ks": "KS", "kansas": "KS", "ky": "KY", "kentucky": "KY", "la": "LA", "louisiana": "LA", "me": "ME", "maine": "ME",
    "md": "MD", "maryland": "MD", "ma": "MA", "massachusetts": "MA", "mass": "MA", "mi": "MI", "michigan": "MI", "mn": "MN", "minnesota": "MN",
    "ms": "MS", "mississippi": "MS", "mo": "MO", "missouri": "MO", "mt": "MT", "montana": "MT", "ne": "NE", "nebraska": "NE", "nv": "NV",
    "nevada": "NV", "nh": "NH", "new hampshire": "NH", "nj": "NJ", "new jersey": "NJ", "nm": "NM", "new mexico": "NM", "ny": "NY", "new york": "NY",
    "nc": "NC", "north carolina": "NC", "nd": "ND", "north dakota": "ND", "oh": "OH", "ohio": "OH", "ok": "OK", "oklahoma": "OK", "or": "OR",
    "oregon": "OR", "pa": "PA", "pennsylvania": "PA", "ri": "RI", "rhode island": "RI", "sc": "SC", "south carolina": "SC", "sd": "SD",
    "south dakota": "SD", "tn": "TN", "tennessee": "TN", "tx": "TX", "texas": "TX", "ut": "UT", "utah": "UT", "vt": "VT", "vermont": "VT", "va": "VA",
    "virginia": "VA", "wa": "WA", "washington": "WA", "wv": "WV", "west virginia": "WV", "wi": "WI", "wisconsin": "WI", "wy": "WY", "wyoming": "WY",
    "dc": "DC", "district of columbia": "DC", "washington d c": "DC", "washington dc": "DC", "pr": "PR", "puerto rico": "PR", "vi": "VI", "gu": "GU",
    "guam": "GU", "as": "AS", "mp": "MP",
}
# Pay periods in a year, the lowest figure read as yearly, and the upper ends of the pay bands.
PERIODS = {"year": 1, "month": 12, "week": 52, "hour": 2080, "day": 260}
ANNUAL_FLOOR = 15_000
BANDS = {"under-50k": 50_000, "50-80k": 80_000, "80-120k": 120_000, "120-180k": 180_000}
TOP_BAND = "180k-plus"


def lookup(table: dict[str, str], c: Column) -> Column:
    """The table's value of an expression, NULL where it has none: a map literal, so no join."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), c)


def clean(c: Column) -> Column:
    """Lower case, &amp; decoded, slashes as ' & ' and white space collapsed."""
    t = F.lower(F.replace(text(c), F.lit("&amp;"), F.lit("&")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*/\s*", " & "), r"\s+", " "))


def category(c: Column) -> Column:
    """One of 22 fields or NULL; of a comma list that isn't a field itself, the first part that is one."""
    table = CATEGORIES
    parts = F.filter(F.transform(F.split(clean(c), ","), lambda p: lookup(table, F.trim(p))), lambda v: v.isNotNull())
    return F.coalesce(lookup(table, clean(c)), F.try_element_at(parts, F.lit(1)))


def seniority(c: Column) -> Column:
    """One of eight rungs or NULL; of a list the lowest."""
    table = SENIORITY
    rungs = list(RUNGS)
    ranks = F.transform(F.split(clean(c), ","), lambda p: F.array_position(F.array(*map(F.lit, rungs)), lookup(table, F.trim(p))))
    return F.try_element_at(F.array(*map(F.lit, rungs)), F.array_min(F.filter(ranks, lambda r: r > 0)).cast("int"))


def employment_type(c: Column) -> Column:
    key = F.lower(F.trim(F.regexp_replace(text(c), r"[^\p{L}\p{N}]+", " ")))
    return F.coalesce(lookup(EMPLOYMENT, key), F.lit(""))


def us_state(c: Column) -> Column:
    key = F.lower(F.trim(F.regexp_replace(text(c), r"[^\p{L}\p{N}]+", " ")))
    return lookup(STATES, key)


def apply_via(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c, "employer").otherwise("aggregator")


def annual_salary(low: Column, currency: Column, period: Column) -> Column:
    """A stated lower bound as yearly dollars; NULL for other currencies, unknown periods and figures of unclear period."""
    cur, per = F.upper(F.trim(text(currency))), F.lower(F.trim(text(period)))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(PERIODS.items())]), per)
    yearly = F.when(per == "", F.when(low >= ANNUAL_FLOOR, low)).otherwise(low * factor)
    return F.when((low > 0) & cur.isin("", "USD"), yearly)


def first_figure(c: Column) -> Column:
    """The smallest figure of a pay text; K figures in thousands, and beside them bare figures under 1000 too."""
    t = text(c)
    number = lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double")
    k = F.transform(F.regexp_extract_all(t, F.lit(r"([\d,]+(?:\.\d+)?)\s*[kK]\b"), F.lit(1)), lambda s: number(s) * 1000)
    rest = F.regexp_replace(t, r"([\d,]+(?:\.\d+)?)\s*[kK]\b", " ")
    plain = F.transform(F.regexp_extract_all(rest, F.lit(r"[\d,]{3,}"), F.lit(0)), number)
    mixed = F.when(F.size(k) > 0, F.transform(plain, lambda v: F.when(v < 1000, v * 1000).otherwise(v))).otherwise(plain)
    return F.array_min(F.concat(k, mixed))


def salary_band(figure: Column) -> Column:
    band = None
    for name, top in BANDS.items():
        band = F.when(figure < top, name) if band is None else band.when(figure < top, name)
    return F.when(figure.isNull(), "").otherwise(band.otherwise(TOP_BAND))
