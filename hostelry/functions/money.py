"""Exact amounts: integer cents, half-up rounding, and comparisons without division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    """Whole cents of a decimal amount, null for null; an amount with a fraction of a cent is an error."""
    cents = amount * 100
    return F.when(cents.isNull() | (cents == cents.cast("bigint")), cents.cast("bigint")).otherwise(
        F.raise_error(F.lit("amount finer than a cent")).cast("bigint")
    )


def from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def night_share(total_cents: Column, nights: Column, index: Column) -> Column:
    """A night's part of a stay's cents: the remainder goes to the first nights, a cent each."""
    rest = total_cents % nights
    return ((total_cents - rest) / nights).cast("bigint") + F.when(index < rest, 1).otherwise(0)


def half_up(numerator: Column, denominator: Column) -> Column:
    """Rounded quotient of non-negative integers; null where the denominator is not positive."""
    whole = F.when(denominator > 0, denominator)
    top = 2 * numerator + whole
    return ((top - top % (2 * whole)) / (2 * whole)).cast("bigint")


def adr_cents(revenue_cents: Column, rooms: Column) -> Column:
    """Average daily rate in cents, half up; null without rooms."""
    return half_up(revenue_cents, rooms)


def occupancy_hundredths(rooms: Column, available: Column) -> Column:
    """Occupancy in hundredths of a percent, half up, not clamped; null for unknown or no capacity."""
    return half_up(rooms * 10000, available)


def document_sign(kind: Column, gross: Column, net: Column, line_sum: Column) -> Column:
    """-1 for a credit note written with positive amounts, else 1."""
    shown = F.coalesce(F.nullif(gross, F.lit(0)), F.nullif(net, F.lit(0)), F.nullif(line_sum, F.lit(0)))
    return F.when((kind == "CREDIT_NOTE") & (shown > 0), -1).otherwise(1)


def threshold_progress(value: Column, threshold: float, saturation: float) -> Column:
    """0 at nothing, 50 at the threshold, 100 at saturation, linear between; a decimal of 6 places."""
    exact = value.cast("decimal(20,6)")
    low = exact * 50 / F.lit(threshold).cast("decimal(10,2)")
    high = 50 + (exact - F.lit(threshold).cast("decimal(10,2)")) * 50 / F.lit(saturation - threshold).cast("decimal(10,2)")
    ladder = (
        F.when(exact <= 0, F.lit(0).cast("decimal(20,6)"))
        .when(exact >= saturation, F.lit(100).cast("decimal(20,6)"))
        .when(exact <= threshold, low.cast("decimal(20,6)"))
    )
    return ladder.otherwise(high.cast("decimal(20,6)"))


def to_money(amount: Column, most: str = "999999999999.99") -> Column:
    """An amount to the cent, half up; null beyond what a column holds."""
    rounded = F.round(amount.cast("decimal(30,10)"), 2)
    return F.when(F.abs(rounded) <= F.lit(most).cast("decimal(14,2)"), rounded.cast("decimal(14,2)"))


def canonical_text(amount: Column) -> Column:
    """A decimal as plain text without zeros that say nothing; minus nought is nought."""
    plain = amount.cast("string")
    bare = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(bare.isin("-0", ""), "0").otherwise(bare)


def parsed_integer(text: Column) -> Column:
    """A whole number, also where it is written with decimals that are all 0 ("3", "3.0", "3,00"); null otherwise."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d{1,18}([.,]0+)?$"), F.regexp_replace(F.trim(text), r"[.,]0+$", "").try_cast("bigint"))


def amount_issue(amount: Column, scale: int, most: Column | None = None) -> Column:
    """What is wrong with an amount: NOT_A_NUMBER (null), NEGATIVE, TOO_PRECISE or OUT_OF_RANGE; null if nothing."""
    found = F.when(amount.isNull(), "NOT_A_NUMBER").when(amount < 0, "NEGATIVE").when(amount != F.round(amount, scale), "TOO_PRECISE")
    return found if most is None else found.when(amount > most, "OUT_OF_RANGE")


def gap_proxy(quantity: Column, price: Column) -> Column:
    """What a gap is worth, to the cent; null where either is not known."""
    return F.round(quantity.cast("decimal(18,4)") * price.cast("decimal(18,4)"), 2).cast("decimal(18,2)")
