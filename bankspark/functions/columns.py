"""Column expressions used across the library.

Everything here returns a native ``Column`` so that it stays inside
whole-stage code generation; there are no Python UDFs in the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import AGE_EDGES, AGE_LABELS, CENTURY, REFERENCE_YEAR, STATUS_LABELS


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c, mapping: dict, default=None) -> Column:
    """Map values through a fixed dict (a ``CASE`` chain; NULL when absent)."""
    c = col_(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if default is None:
        return expr
    return expr.otherwise(default)


def flag(cond: Column) -> Column:
    """0/1 INT flag; a NULL condition counts as 0 (pandas semantics)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def money(c) -> Column:
    """Amount as an exact DECIMAL(18,2), so sums do not depend on summation order."""
    return col_(c).cast("decimal(18,2)")


def cents(c) -> Column:
    """Amount as whole cents in a BIGINT (exact, and summed on the fast integer path)."""
    return F.round(col_(c).cast("double") * F.lit(100.0)).cast("long")


def _sum(c, per_key: bool) -> Column:
    # per_key: the sum of one account (or account-month) cannot reach 9e16 currency units, so
    # BIGINT cents are exact and fast; totals over whole tables use DECIMAL, exact to cents (an amount
    # beyond DECIMAL(18,2) fails)
    if per_key:
        return F.sum(cents(c)).cast("double") / F.lit(100.0)
    return F.sum(money(c)).cast("double")


def money_sum(c, per_key: bool = False) -> Column:
    """Exact sum of an amount column returned as DOUBLE; 0 over no rows (pandas)."""
    return F.coalesce(_sum(c, per_key), F.lit(0.0))


def money_sum_where(c, cond: Column, per_key: bool = False) -> Column:
    return F.coalesce(_sum(F.when(cond, col_(c)), per_key), F.lit(0.0))


def money_mean(c, per_key: bool = False) -> Column:
    """Mean of an amount column from its exact sum; NULL over no rows."""
    return (_sum(c, per_key) / F.count(col_(c))).cast("double")


def pct(cond_or_flag: Column) -> Column:
    """Mean of a 0/1 flag times 100."""
    return (F.avg(cond_or_flag.cast("double")) * F.lit(100.0)).cast("double")


# ---------------------------------------------------------------- birth numbers

def birth_text(c="birth_number", pad: bool = True) -> Column:
    """Birth number as text. ``pad`` restores a leading zero lost by integer storage."""
    s = col_(c).cast("long").cast("string")
    return F.lpad(s, 6, "0") if pad else s


def birth_year_raw(c="birth_number", pad: bool = True) -> Column:
    return F.substring(birth_text(c, pad), 1, 2).cast("int")


def birth_month_raw(c="birth_number", pad: bool = True) -> Column:
    return F.substring(birth_text(c, pad), 3, 2).cast("int")


def birth_day(c="birth_number", pad: bool = True) -> Column:
    return F.substring(birth_text(c, pad), 5, 2).cast("int")


def gender_from_month(m: Column) -> Column:
    return F.when(m > 50, F.lit("F")).otherwise(F.lit("M"))


def age_group(age) -> Column:
    """Right-closed bands; values outside (0, 100] give NULL."""
    a = col_(age)
    expr = None
    for lo, hi, lab in zip(AGE_EDGES[:-1], AGE_EDGES[1:], AGE_LABELS):
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def age_group_ord(age) -> Column:
    a = col_(age)
    expr = None
    for i, (lo, hi) in enumerate(zip(AGE_EDGES[:-1], AGE_EDGES[1:])):
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def age_at_reference(birth_year: Column) -> Column:
    return (F.lit(REFERENCE_YEAR) - birth_year).cast("int")


def century_year(yy: Column) -> Column:
    return (F.lit(CENTURY) + yy).cast("int")


# ---------------------------------------------------------------- dates

def bank_date(c, dtype=None) -> Column:
    """Parse a bank date given as DATE, TIMESTAMP, ISO text (with or without a time of day) or legacy YYMMDD.

    Legacy values always get the century 19 (a bare ``yy`` pattern would give 2093
    for 93). Values that parse in neither form become NULL.
    """
    c = col_(c)
    if dtype is not None and dtype in ("date",):
        return c
    if dtype is not None and dtype.startswith("timestamp"):
        return c.cast("date")
    text = c.cast("string")
    iso = F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d"), F.substring(text, 1, 10)).otherwise(text),
                        "yyyy-MM-dd")
    legacy_text = F.concat(F.lit("19"), F.lpad(F.regexp_replace(text, r"\.0$", ""), 6, "0"))
    legacy = F.when(F.length(F.regexp_replace(text, r"\.0$", "")) <= 6,
                    F.try_to_date(legacy_text, "yyyyMMdd"))
    return F.coalesce(iso, legacy)


def status_label(c="status") -> Column:
    return lookup(c, STATUS_LABELS)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))
