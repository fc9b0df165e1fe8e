"""Schedules as pure functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVAL, CAP = 300, 21_600
GAP_HOURS = (1, 2, 4, 8, 16, 24)


def backoff(failures: int, interval: int = INTERVAL, cap: int = CAP) -> int:
    """Seconds until the next try: doubling from the interval, six hours at most."""
    return min(interval * 2 ** min(failures, 40), cap)


def backoff_column(failures: Column, interval: int = INTERVAL, cap: int = CAP) -> Column:
    return F.least(F.lit(interval) * F.pow(F.lit(2), failures), F.lit(cap)).cast("bigint")


def gap_retry_hours(tries: int) -> int:
    return GAP_HOURS[min(tries, len(GAP_HOURS) - 1)]


def checkpoint_due(encoded: int, seconds: float, save_cost: float, every: int = 512, after: float = 60.0) -> bool:
    """Whether to save prepared vectors: enough rows or time, and ten times the last save's cost apart."""
    return (encoded >= every or seconds >= after) and seconds >= 10 * save_cost
