"""Money as whole cents in longs: no double takes part once a value is parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Whole-number quotient toward zero."""
    return F.call_function("div", a, b)


def floor_div(a: Column, b: Column) -> Column:
    """Whole-number quotient toward minus infinity, for positive ``b``."""
    return int_div(a - F.pmod(a, b), b)


def half_away(n: Column, d: Column) -> Column:
    """``n / d`` rounded to a whole number, halves away from zero, for positive ``d``."""
    return F.signum(n).cast("long") * int_div(F.abs(n) * 2 + d, d * 2)


def rate_of(cents: Column, basis_points: Column) -> Column:
    """So many basis points of an amount."""
    return half_away(cents * basis_points, F.lit(10000).cast("long"))


def parse_cents(text: Column) -> Column:
    """Cents of a decimal text in currency units; null for what is no number or holds part of a cent."""
    exact = F.when(text.rlike(r"^[+-]?[0-9]{1,15}(\.[0-9]{1,6})?$"), text.cast("decimal(24,6)")) * 100
    return F.when(exact == F.floor(exact), exact.cast("long"))


def double_cents(value: Column) -> Column:
    """Cents of a double that is known to hold whole cents; the only way in from a double column."""
    return F.round(value * 100).cast("long")


def cents_text(cents: Column, negative: Column | None = None) -> Column:
    """``-12.05`` for -1205; where a sign of its own is kept beside the size, ``negative`` gives it, also for ``-0.00``."""
    size = F.abs(cents)
    hundred = F.lit(100).cast("long")
    digits = F.concat(int_div(size, hundred).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.concat(F.when(cents < 0 if negative is None else negative, "-").otherwise(""), digits)


def whole_number(text: Column, scale: int = 1) -> Column:
    """A text of digits times ``scale``, else null."""
    return F.when(text.rlike("^-?[0-9]{1,17}$"), text.cast("long") * scale)


def expected_terms(wac_cents: Column, quantity_milli: Column, discount_bps: Column, fee_cents: Column, copay_cents: Column, coinsurance_bps: Column) -> Column:
    """Struct ``charge, allowed, patient, expected`` of a contract's price for a quantity in thousandths.

    The patient pays a copay, or where there is none a share of the allowed amount, and never more than that amount.
    """
    charge = half_away(wac_cents * quantity_milli, F.lit(1000).cast("long"))
    allowed = rate_of(charge, F.lit(10000) - discount_bps) + fee_cents
    patient = F.least(F.coalesce(copay_cents, rate_of(allowed, coinsurance_bps)), allowed)
    return F.struct(charge.alias("charge"), allowed.alias("allowed"), patient.alias("patient"), (allowed - patient).alias("expected"))


def expected_rebate(acquisition_cents: Column, ceiling_cents: Column, quantity_milli: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), half_away((acquisition_cents - ceiling_cents) * quantity_milli, F.lit(1000).cast("long")))
