"""Structured Streaming: windowed bars (an extension), replay order and digest. The sink is in store.py, counters in sequences.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HOUR_MS, epoch_ms
from ..operators.windows import previous


def windowed_bars(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars by event-time window with a watermark."""
    at = F.struct("ts", "event_id")
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("trades"))


REPLAY_ORDER = ["t_ms", "received", "event_id", "event_type"]


def replay_schedule(events: DataFrame, speed: float) -> DataFrame:
    """The virtual delay before each event, in milliseconds, of one replay of all types: events in the order of time,
    arrival (``received``; event_id where there is none), id and type, each waiting for the one before it."""
    e = events.withColumn("t_ms", epoch_ms(F.col("ts")))
    e = e if "received" in e.columns else e.withColumn("received", F.col("event_id"))
    d = previous(e.select(*REPLAY_ORDER), [], REPLAY_ORDER, ["t_ms"], HOUR_MS)
    wait = F.greatest(F.lit(0.0), (F.col("t_ms") - F.col("prev.t_ms")) / F.lit(float(speed)))
    return d.select("event_type", "event_id", "t_ms", F.coalesce(wait, F.lit(0.0)).alias("delay_ms"))


def replay_digest(events: DataFrame) -> DataFrame:
    """Number of events and a digest of them in replay order; equal for every speed and every run."""
    from ..operators.aggregates import ordered_digest

    e = events.withColumn("t_ms", epoch_ms(F.col("ts")))
    e = e if "received" in e.columns else e.withColumn("received", F.col("event_id"))
    return ordered_digest(e, REPLAY_ORDER, HOUR_MS)
