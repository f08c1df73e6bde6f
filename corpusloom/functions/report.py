"""What progress reports show: rates, times left, and whether a source is an address or a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_address(source: Column) -> Column:
    """Whether a source begins with http:// or https://, in any case; a null source doesn't."""
    return F.coalesce(F.lower(source).rlike("^https?://"), F.lit(False))


def rounded(x: Column, places: int) -> Column:
    """``x`` times a power of ten, rounded half away from zero, and divided by it again: SQL's rounding of a double."""
    scaled = F.round(x * F.lit(float(10**places))) / F.lit(float(10**places))
    return F.when(F.abs(x) < 1e300, scaled).otherwise(x)


def rate_text(rate: Column) -> Column:
    """A rate as a whole number, or from a thousand on in thousands with a decimal.

    It is rounded as printf does: by the double's exact value, and to an even digit if that is a tie.
    """
    rate = rate.cast("double")
    k = rate / 1000
    tenths = F.floor(k * 10)
    middle = 2 * tenths.cast("double") + 1
    # the sign of 20 * k - middle; each difference is exact, as its terms are within a factor of two
    over = (k * 16 - middle) + k * 4
    tenths = tenths + F.when((over > 0) | ((over == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    thousands = F.when(k < 1e14, F.format_string("%d.%dk", F.floor(tenths / 10), tenths % 10)).otherwise(F.format_string("%.1fk", k))
    return F.when(rate >= 1000, thousands).otherwise(F.format_string("%.0f", F.bround(rate, 0)))


def time_left(done: Column, total: Column, rate: Column) -> Column:
    """The time that ``total - done`` takes at ``rate``: 2h05m, 3m07s or 9s; -- before anything is known."""
    seconds = F.floor((total - done) / F.when(rate > 0, rate))
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60)
    text = F.when(hours >= 1, F.format_string("%dh%02dm", hours, minutes % 60)).when(minutes >= 1, F.format_string("%dm%02ds", minutes, seconds % 60)).otherwise(F.format_string("%ds", seconds))
    return F.when((rate > 0) & (done > 0), text).otherwise("--")
