"""Number rules shared by the metrics and the report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a reading turns yellow and where it turns red.
ERROR_RATE_LIMITS = (1.0, 5.0)
P95_LIMITS_MS = (2000.0, 5000.0)


def round_even(col: Column, digits: int = 0) -> Column:
    """Round with ties to the even neighbour, as the store and the API do."""
    return F.bround(col.cast("double"), digits)


def whole(col: Column) -> Column:
    """A rounded whole number; null stays null."""
    return round_even(col).cast("bigint")


def zero_int(col: Column) -> Column:
    """null, NaN and text that is no number become 0; fractions are cut."""
    return F.coalesce(F.when(~F.isnan(col.try_cast("double")), col.try_cast("bigint")), F.lit(0))


def zero_float(col: Column) -> Column:
    """null, NaN and text that is no number become 0.0."""
    value = col.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def error_rate(errors: Column, requests: Column) -> Column:
    """Percent of failed calls with 2 decimals; 0.0 when there were no calls."""
    return F.coalesce(round_even(F.try_divide(F.lit(100.0) * errors, requests), 2), F.lit(0.0))


def panel_error_rate(errors: Column, requests: Column) -> Column:
    """The dashboard's form of the same rate: the divisor is at least 1."""
    return round_even(F.lit(100.0) * errors / F.greatest(requests, F.lit(1)), 2)


def severity(value: Column, limits: tuple[float, float]) -> Column:
    """green below the first limit, yellow up to the second, red from there."""
    yellow, red = limits
    return F.when(value >= red, "red").when(value >= yellow, "yellow").when(value.isNotNull(), "green")


def _formatted(col: Column, pattern: str) -> Column:
    return F.call_function("format_number", col, F.lit(pattern))


def human_number(col: Column) -> Column:
    """1234567 -> 1.2M, 3400 -> 3.4k, 12 -> 12 for a whole number.

    One decimal, ties upwards. The formatter sends exact ties (only .25 and .75
    can be exact in binary) to the even digit, so .25 gets a nudge.
    """

    def short(unit: int, suffix: str) -> Column:
        nudge = F.when(F.pmod(col, F.lit(unit)) == unit // 4, 1).otherwise(0)
        return F.concat(_formatted((col + nudge) / F.lit(float(unit)), "0.0"), F.lit(suffix))

    return (
        F.when(col >= 1_000_000, short(1_000_000, "M"))
        .when(col >= 1_000, short(1_000, "k"))
        .otherwise(col.cast("string"))
    )


def money(col: Column) -> Column:
    return F.concat(F.lit("$"), _formatted(zero_float(col), "0.0000"))


def milliseconds_text(col: Column) -> Column:
    return F.concat(zero_int(col).cast("string"), F.lit("ms"))


def percent_text(col: Column) -> Column:
    """A rate with 2 decimals at most, without trailing zeros, as in 0%, 2.5%, 12.34%."""
    return F.concat(_formatted(zero_float(col), "0.##"), F.lit("%"))
