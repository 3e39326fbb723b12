"""A whole triage run: one normalised event table, many results from it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import aggregate, detect, findings, indicators, relate


def triage_run(events: DataFrame) -> dict[str, DataFrame]:
    """Named results over one persisted event table; the caller unpersists it and writes what it wants."""
    events = events.persist()
    return {
        "types": aggregate.type_counts(events),
        "spikes": aggregate.spikes_by_sigma(events),
        "matches": findings.matches(events),
        "techniques": findings.technique_status(findings.indicators(events)),
        "findings": findings.findings(events),
        "iocs": indicators.ioc_table(events),
        "sessions": relate.session_table(events),
        "trees": relate.trees(events),
        "triage": detect.triage_sample(detect.triage(events)),
    }
