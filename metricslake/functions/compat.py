"""Column helpers that fix formatting, rounding and time arithmetic once.

All of them are plain Catalyst expressions (no Python UDF), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_g(col: Column) -> Column:
    """C's ``%g`` text: six significant digits, trailing zeros stripped, exponent form
    below 1e-4 and from 1e6 (1e+06, 1.5e-05). NULL stays NULL.

    Digits are rounded from the shortest decimal text of the double, halves away from
    zero; C rounds the binary value, which differs only when that text ends in a 5 in
    the seventh place.
    """
    x = col.cast("double")
    text = F.format_string("%.5e", x)  # d.ddddde+dd
    mantissa = F.substring_index(text, "e", 1)
    power = F.substring_index(text, "e", -1).try_cast("int")
    trim = lambda c: F.rtrim(F.rtrim(c, F.lit("0")), F.lit("."))
    plain = trim(text.try_cast("decimal(38,10)").cast("string"))
    scientific = F.concat(trim(mantissa), F.lit("e"), F.substring_index(text, "e", -1))
    special = F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == -float("inf"), F.lit("-inf"))
    number = F.when(x == 0, F.lit("0")).when(power.between(-4, 5), plain).otherwise(scientific)
    return F.when(x.isNotNull(), F.coalesce(special, number))


def round_half_away(col: Column, digits: int) -> Column:
    """Round by scaling in binary: ``round(x * 10^n) / 10^n``, halves away from zero.

    Spark's ``round(x, n)`` rounds the decimal text of ``x`` (1.005 -> 1.01); report
    values are rounded the binary way (1.005 -> 1.0), which matters for the ratio
    flags that compare the rounded value with 1.1 and 0.9.
    """
    if digits == 0:
        return F.round(col.cast("double"), 0)
    scale = float(10**digits)
    return F.round(col.cast("double") * F.lit(scale), 0) / F.lit(scale)


def half_even_int(col: Column) -> Column:
    """double -> int rounding half to even (2.5 -> 2, 3.5 -> 4); a plain cast truncates."""
    return F.rint(col).cast("int")


def epoch_seconds(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` (fractional), for naive timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0)


def to_ntz(col: Column) -> Column:
    """Cast to ``timestamp_ntz`` (``date_trunc`` returns a session-zone timestamp)."""
    return col.cast("timestamp_ntz")
