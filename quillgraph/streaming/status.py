"""Run status as a stream: the newest event of each project, kept in state. An extension of the batch listing, not part of parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """``project_id, status, at`` from a stream of ``project_id, status, at``; late events beyond the watermark are left out."""
    return events.withWatermark("at", watermark).groupBy("project_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def progress_per_window(events: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Events per window and status."""
    return events.withWatermark("at", watermark).groupBy(F.window("at", window), "status").agg(F.count("*").alias("events"))


def coalesced(reports: list[tuple[float, str, float]], every: float = 0.4) -> list[tuple[float, str, float]]:
    """Progress reports (seconds, phase, share) worth writing: each change of phase, else one per interval."""
    out: list[tuple[float, str, float]] = []
    for at, phase, share in reports:
        if not out or out[-1][1] != phase or at - out[-1][0] >= every:
            out.append((at, phase, share))
    return out
