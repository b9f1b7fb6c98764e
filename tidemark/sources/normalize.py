"""Lines of bar archives to canonical bars, with what was wrong with their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bars import out_of_order
from .files import KLINE_CSV

FIELDS = [c.strip() for c in KLINE_CSV.split(",")]
HEADER = ",".join(FIELDS)
SCHEMA_VERSION = 1
#: Canonical columns, the archive's column of each, and its type.
COLUMNS = [
    ("open_time_ms", "open_time", "long"), ("close_time_ms", "close_time", "long"), ("open", "open", "double"), ("high", "high", "double"), ("low", "low", "double"), ("close", "close", "double"),
    ("base_volume", "volume", "double"), ("quote_volume", "quote_volume", "double"), ("trade_count", "count", "long"), ("taker_buy_base_volume", "taker_buy_volume", "double"),
    ("taker_buy_quote_volume", "taker_buy_quote_volume", "double"),
]


def symbol_of(archive: Column) -> Column:
    """The symbol that an archive's file name begins with: BTCUSDT of .../BTCUSDT-1m-2024-01.zip."""
    return F.regexp_extract(archive, r"([^/\\-]+)-[^/\\]*$", 1)


def typed_lines(lines: DataFrame, symbol: Column | None = None) -> DataFrame:
    """archive, number, symbol and the fields of archives' lines (archives.read_archives), by casts that raise on bad
    values. A line that came with a fault, and an archive that was refused, is an error."""
    whole = F.when(F.col("fault").isNull(), F.split("line", ",")).otherwise(F.raise_error(F.concat("archive", F.lit(": "), "fault")))
    rows = lines.select("archive", "number", whole.alias("x"))
    at = {c: F.trim(F.get("x", F.lit(i))) for i, c in enumerate(FIELDS)}
    return rows.select("archive", "number", (symbol_of(F.col("archive")) if symbol is None else symbol).alias("symbol"), *[at[source].cast(kind).alias(name) for name, source, kind in COLUMNS])


def canonical_bars(typed: DataFrame, interval: str, ingested_at_ns: int, source: str = "archive") -> DataFrame:
    """One closed bar for each symbol and time of opening: the first by archive and line.

    The first row of a key is an aggregate, so a task drops the repeats that it sees before the shuffle."""
    keys = ["symbol", "open_time_ms"]
    rest = [name for name, _, _ in COLUMNS if name not in keys]
    first = typed.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("archive", "number")).alias("r"))
    return first.select(
        "symbol", F.lit(interval).alias("interval"), "open_time_ms", *[F.col(f"r.{c}").alias(c) for c in rest],
        F.lit(True).alias("is_closed"), F.lit(ingested_at_ns).cast("long").alias("ingested_at_ns"), F.lit(source).alias("source"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def source_quality(typed: DataFrame, width: int = 1 << 16) -> DataFrame:
    """One row an archive: its rows, those beyond the first of their key within it, and those whose time of opening is
    before that of the line above. Lines are compared within stretches of ``width`` lines that hand one line on."""
    per_key = typed.groupBy("archive", "symbol", "open_time_ms").agg(F.count("*").alias("c"))
    counts = per_key.groupBy("archive").agg(F.sum("c").alias("source_rows"), (F.sum("c") - F.count("*")).alias("duplicate_rows"))
    back = out_of_order(typed, ["archive"], "number", "open_time_ms", width)
    return counts.join(back, "archive")
