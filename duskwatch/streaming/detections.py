"""Streaming forms of the stateless detections and of sessions.

The same operators run on ``readStream`` frames: rule scans and filters row by row, sessions by a
watermark and ``session_window``, whose state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators.detect import rule_scan


def signatures(events: DataFrame) -> DataFrame:
    """Matches of all signatures on a stream of events."""
    return rule_scan(events, rules.SIGNATURES)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Closed sessions of a host and user; events later than the watermark are dropped."""
    marked = events.withWatermark("timestamp_utc", late)
    window = F.session_window("timestamp_utc", gap)
    return marked.groupBy("source_system", "username", window).agg(F.count("*").alias("n")).select("source_system", "username", F.col("session_window.start").alias("start"), F.col("n"))


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("timestamp_utc", late)
    return marked.groupBy(F.window("timestamp_utc", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
