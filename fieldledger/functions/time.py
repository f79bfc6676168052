"""Instants and dates written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant_micros(ts: str) -> Column:
    """Microseconds since 1970 of an ISO 8601 instant with Z or an offset; null if it can't be read."""
    return F.expr(f"unix_micros(try_cast(trim({ts}) AS timestamp))")


def period_end(text: str) -> Column:
    """Last day of what `text` names: a day, month (2022-08, Sep 2025), quarter (Q2 2025) or year; else null."""
    s = f"upper(trim({text}))"
    return F.expr(
        f"""coalesce(
          CASE WHEN {s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_cast({s} AS date) END,
          CASE WHEN {s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}$' THEN last_day(try_cast(concat({s}, '-01') AS date)) END,
          CASE WHEN {s} RLIKE '^[A-Z]{{3,9}}\\\\.? [0-9]{{4}}$' AND instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', left({s}, 3)) % 3 = 1
               THEN last_day(try_cast(concat(right({s}, 4), '-', lpad(cast((instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', left({s}, 3)) + 2) div 3 AS string), 2, '0'), '-01') AS date)) END,
          CASE WHEN {s} RLIKE '^Q[1-4] [0-9]{{4}}$'
               THEN last_day(try_cast(concat(right({s}, 4), '-', lpad(cast(3 * cast(substring({s}, 2, 1) AS int) AS string), 2, '0'), '-01') AS date)) END,
          CASE WHEN {s} RLIKE '^[0-9]{{4}}$' THEN try_cast(concat({s}, '-12-31') AS date) END)"""
    )
