"""Streaming queries, run to the end of their input."""

from __future__ import annotations

from ..streaming.refresh import run_windowed


def st_event_windows(s, d):
    return run_windowed(s, d).selectExpr("cast(start as timestamp_ntz) as start", "event_type", "n", "total")


QUERIES = {"st_event_windows": st_event_windows}
SQL = {"st_event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
