"""Scalar cleaning: missing tokens, dates, numbers, lists and keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MISSING = ("", "nan", "none", "<na>", "null")


def present(text: Column) -> Column:
    """Trimmed text; null for blanks and tokens that mean a missing value."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*MISSING), t)


def normal_text(text: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(StringType())
def compatible_text(texts: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, case folded; SQL has no NFKC, so Arrow batches carry it."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def parse_date(text: Column) -> Column:
    """ISO, slashed, month-named, month and year dates; a year means its last day, a month its end; null for others."""
    t = F.trim(text)
    full = [F.try_to_timestamp(F.when(t.rlike(r), t), F.lit(f)) for r, f in (
        (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
        (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
        (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
        (r"^\d{2}-[A-Za-z]{3}-\d{4}$", "dd-MMM-yyyy"),
    )]
    year = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-12-31")).cast("date"))
    month = F.when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.last_day(F.concat(t, F.lit("-01")).cast("date")))
    return F.coalesce(*[x.cast("date") for x in full], year, month)


def relation_of(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*(<=|>=|<|>|~|=)?\s*[0-9]"), F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*(<=|>=|<|>|~|=)", 1), F.lit("")), F.lit("=")))


def number_of(text: Column) -> Column:
    """The positive number behind an optional relation; thousands separated by commas, exponents allowed."""
    n = F.regexp_extract(text, r"^\s*(?:<=|>=|<|>|~|=)?\s*([0-9][0-9,]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*$", 1)
    x = F.nullif(F.regexp_replace(n, ",", ""), F.lit("")).try_cast("double")
    return F.when(x > 0, x)


def split_clean(text: Column) -> Column:
    """Items between ; , and |, trimmed and upper-cased, without missing ones; order and repeats stay."""
    items = F.transform(F.split(text, r"[;,|]"), lambda x: F.upper(F.trim(x)))
    return F.filter(items, lambda x: ~x.isin("", "NA", "N/A", "NULL"))


def union_text(a: Column, b: Column) -> Column:
    """The different items of two ;-lists, sorted, joined again."""
    parts = lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), lambda y: F.trim(y)), lambda y: y != "")
    return F.array_join(F.array_sort(F.array_union(parts(a), parts(b))), ";")


def key_values(text: Column) -> Column:
    """"k: v;k2: v2" as a map to numbers; chunks without a colon are skipped."""
    chunks = F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit(":")))
    return F.map_from_arrays(
        F.transform(chunks, lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1)))),
        F.transform(chunks, lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(2))).cast("double")),
    )


def round_half_away(x: Column, places: int) -> Column:
    """x scaled, rounded to a whole number and scaled back, as SQL engines round doubles in binary; F.round goes by x's shortest decimal form, so the two part where that ends in a 5."""
    return F.round(x * F.lit(10.0**places), 0) / F.lit(10.0**places)


def _millionths(x: Column) -> tuple[Column, Column]:
    """The sum of x in whole millionths, and whether all of a group's x are such, of a size that doubles hold them exactly."""
    t = x * 1e6
    return F.sum(F.round(t, 0).try_cast("long")).cast("decimal(38,0)"), F.max(F.greatest(F.abs(t - F.round(t, 0)) * 1e3, F.abs(x) / 1e6)) < 1


def _rounded_ratio(up: Column, down: Column, places: int) -> Column:
    """Whole numbers up / down, in millionths, rounded half away from zero to so many decimals, six at least."""
    whole = F.call_function("div", 2 * F.abs(up) * F.lit(10 ** (places - 6)) + down, 2 * down)
    return F.signum(up) * whole / F.lit(10.0**places)


def rounded_mean(x: Column, places: int) -> Column:
    """Aggregate: the mean of x rounded; values of at most six decimals are summed as whole numbers, so that a mean that ends in an exact half is rounded up whatever the order of summing."""
    total, plain = _millionths(x)
    return F.when(plain, _rounded_ratio(total, F.count(x), places)).otherwise(round_half_away(F.avg(x), places))


def rounded_gap(x: Column, y: Column, places: int) -> Column:
    """Aggregate: the mean of x less that of y, rounded, in whole numbers as in rounded_mean."""
    (a, one), (b, two), n, m = _millionths(x), _millionths(y), F.count(x), F.count(y)
    exact = _rounded_ratio(a * m - b * n, n.cast("decimal(38,0)") * m, places)
    return F.when(one & two, exact).otherwise(round_half_away(F.avg(x) - F.avg(y), places))


@F.pandas_udf(StringType())
def _fixed2(x: pd.Series) -> pd.Series:
    return pd.Series([f"{v:.2f}" for v in x.to_numpy()], dtype=object)


def fixed2(x: Column) -> Column:
    """A double with two decimals by its exact binary value, as C's printf does it: 0.125 is 0.12 and 2.675 is 2.67; null stays null."""
    return F.when(x.isNotNull(), _fixed2(x))


def spreadsheet_safe(text: Column) -> Column:
    return F.when(text.rlike("^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def normal_url(url: Column) -> Column:
    """Without scheme, www., query, fragment and final slashes or dots, lower case."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"[/.]+$", "")


def unit_from_hash(text: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(16**12)


#: Molar factors of the units that are known.
MOLAR = {"m": 1.0, "mm": 1e-3, "um": 1e-6, "micromolar": 1e-6, "nm": 1e-9, "nanomolar": 1e-9, "pm": 1e-12, "picomolar": 1e-12}


def _unit(text: Column) -> Column:
    """Lower case without spaces, both micro signs as u."""
    return F.replace(F.translate(F.lower(text), "\u00b5\u03bc", "uu"), F.lit(" "), F.lit(""))


def to_molar(value: Column, unit: Column) -> Column:
    """A positive value in molar; null for another value or an unknown unit."""
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in MOLAR.items() for x in pair]), _unit(unit))
    return F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), value * factor)


def p_activity(value: Column, unit: Column) -> Column:
    """-log10 of the molar value, where it lies from 0 to 15; else null."""
    p = -F.log10(to_molar(value, unit))
    return F.when(p.between(0, 15), p)


def nanomolar_only(value: Column, unit: Column) -> Column:
    """The value where the unit is nM, null for any other."""
    return F.when(_unit(unit) == "nm", value)
