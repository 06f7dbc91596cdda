"""Schemas: the stored listing (40 columns, in order), the raw row it is made from, and the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXTS = ("title title_root title_level|title_qualifiers|company team location city state country|locations|remote remote_basis|remote_areas remote_regions|remote_scope_raw body category|tags|seniority seniority_basis employment_type employment_type_raw salary").split("|")
S, A, D = T.StringType(), T.ArrayType(T.StringType()), T.DoubleType()


def _fields() -> list[T.StructField]:
    out = [T.StructField("url", S, False)]
    for k, names in enumerate(_TEXTS):
        out += [T.StructField(n, A if k % 2 else S) for n in names.split()]
    out += [T.StructField(n, D) for n in ("salary_min", "salary_max")]
    out += [T.StructField(n, S) for n in ("salary_currency", "salary_period", "salary_basis")]
    out += [T.StructField(n, D) for n in ("salary_estimated_min", "salary_estimated_max")]
    out += [T.StructField(n, S) for n in ("salary_band", "source", "source_extra")]
    out += [T.StructField("direct_apply", T.BooleanType()), T.StructField("posted", S), T.StructField("expires", S)]
    return [*out, T.StructField("fetched_at", T.TimestampType()), T.StructField("last_seen", T.TimestampType())]


JOBS = T.StructType(_fields())
#: A raw row: the stored columns under their source's names; every one may be absent, text may come as a list.
RAW = T.StructType(
    [T.StructField(n, S) for n in "url title title_root title_level company team location city state country remote_type remote_basis remote_scope_raw text category seniority seniority_basis employment_type employment_type_raw salary salary_currency salary_period salary_basis source source_extra posted expires".split()]
    + [T.StructField(n, A) for n in "title_qualifiers locations remote_areas remote_regions tags sources".split()]
    + [T.StructField(n, D) for n in "salary_min salary_max salary_estimated_min salary_estimated_max".split()]
    + [T.StructField("direct_apply", T.BooleanType())]
)


def check(found: T.StructType, wanted: T.StructType = JOBS) -> None:
    """Raise when a stored table has other columns or types than this version writes."""
    have, want = [(f.name, f.dataType) for f in found.fields], [(f.name, f.dataType) for f in wanted.fields]
    if have != want:
        raise ValueError(f"the table is of another version: {[x for x in have if x not in want]} for {[x for x in want if x not in have]}")
