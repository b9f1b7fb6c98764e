"""Column expressions used across the operators. Missing numbers are null; NaN is turned into null at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, MINUTE_MS, DAY_MS = 3_600_000, 60_000, 86_400_000
TINY = 1e-15


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(F.coalesce(c, F.lit(0.0))) & (F.abs(F.coalesce(c, F.lit(0.0))) != float("inf"))


def only_finite(c: Column) -> Column:
    return F.when(finite(c), c)


def log(c: Column) -> Column:
    """Natural logarithm: of zero, minus infinity; null for numbers below."""
    return F.when(c == 0, float("-inf")).otherwise(F.ln(c))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers have it: over zero infinite with both signs, or no number for 0 / 0, not an error."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(a * F.pow(b, F.lit(-1.0)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone."""
    day = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS
    return day + F.hour(ts) * HOUR_MS + F.minute(ts) * MINUTE_MS + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def utc_date(ms: Column) -> Column:
    """Date of epoch milliseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))


def file_id(*parts: Column) -> Column:
    """Deterministic identifier of its parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
