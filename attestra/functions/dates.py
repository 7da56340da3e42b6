"""Dates that lifecycle jobs need; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.rules import CADENCE_DAYS, RETENTION_DAYS, lookup


def next_run(now: Column, cadence: Column) -> Column:
    """Counted from now, not from the previous due time."""
    return now + F.make_dt_interval(lookup(cadence, CADENCE_DAYS))


def retained_until(created: Column, record: Column) -> Column:
    return created + F.make_dt_interval(lookup(record, RETENTION_DAYS))


def is_due(created: Column, record: Column, now: Column) -> Column:
    """Due on the day itself."""
    return retained_until(created, record) <= now
