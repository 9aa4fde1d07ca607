"""Amounts, dates and predicates on them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,2)"
MAX_FEE = 500
MAX_FEE_SHARE = "0.02"
DATE_FORMATS = ("d/M/yyyy", "d/M/yy", "d-M-yyyy", "d-M-yy", "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd")


def parse_amount(text: Column, strict: bool = True) -> Column:
    """Blank, "-" and null are 0; thousands separators go; bad text raises, or is null."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    digits = F.regexp_replace(bare, ",", "")
    return F.when(bare.isin("", "-"), F.lit(0).cast(AMOUNT)).otherwise(digits.cast(AMOUNT) if strict else digits.try_cast(AMOUNT))


def parse_balance(text: Column) -> Column:
    """As parse_amount, but what is no number, or none at all, is null."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(~bare.isin("", "-", "null", "None"), F.regexp_replace(bare, ",", "").try_cast(AMOUNT))


def parse_date(text: Column) -> Column:
    """Day first; an ISO date is what it says. Null where no format fits."""
    bare = F.regexp_replace(F.trim(text), r"[ T]00:00(:00)?$", "")
    # a two-digit year under yyyy would read as the year 26, so widths are told apart first
    long_year = bare.rlike(r"\d{4}$|^\d{4}-")
    ways = [F.when(long_year if "yyyy" in f else ~long_year, F.try_to_date(bare, f)) for f in DATE_FORMATS]
    return F.coalesce(*ways)


def fee_gap_plausible(a: Column, b: Column) -> Column:
    """A fee or rounding could explain the difference."""
    share = F.greatest(F.abs(a), F.abs(b)) * F.lit(MAX_FEE_SHARE).cast("decimal(3,2)")
    return F.abs(a - b) <= F.greatest(F.lit(MAX_FEE).cast("decimal(20,4)"), share)


def same_direction(a: Column, b: Column) -> Column:
    return (a > 0) == (b > 0)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def step(amount: Column) -> Column:
    """Amounts in steps: 500 wide up to 25 000, above it ever wider by the fee's share. Two
    plausibly equal amounts of one sign are at most one step apart, or two at the seam."""
    size = F.abs(amount).cast("double")
    flat = F.floor(size / MAX_FEE)
    above = 50 + F.floor(F.log(size / 25_000) / F.log(F.lit(1 / 0.98)))
    return F.when(size < 25_000, flat).otherwise(above).cast("long")


def steps_around(amount: Column) -> Column:
    """All steps that a plausibly equal amount can be in."""
    return F.array(*[step(amount) + i for i in (-2, -1, 0, 1, 2)])
