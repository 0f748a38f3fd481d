"""Durations, ages and budgets. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds per duration unit (a month has 30 days).
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "mo": 2592000}


def duration_seconds(text: Column) -> Column:
    """Seconds of ``<n><s|m|h|d|mo>`` with n > 0; null otherwise."""
    text = F.trim(text)
    number = F.regexp_extract(text, r"^([0-9]+)(s|m|h|d|mo)$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^([0-9]+)(s|m|h|d|mo)$", 2)
    factor = F.lit(None).cast("bigint")
    for k, v in UNITS.items():
        factor = F.when(unit == k, F.lit(v).cast("bigint")).otherwise(factor)
    return F.when(number > 0, number * factor)


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def age_seconds(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), seconds(now) - seconds(then))


def age_days(now: Column, then: Column) -> Column:
    """Whole days of 86400 seconds."""
    return F.floor(age_seconds(now, then) / 86400).cast("bigint")


def overlap_since(watermark: Column, overlap: int = 60) -> Column:
    """Where the next scan starts."""
    return watermark.cast("timestamp") - F.make_dt_interval(secs=F.lit(overlap))


def bootstrap_floor(existing: Column, now: Column, days: int = 360) -> Column:
    """Fixed by the first run."""
    return F.coalesce(existing.cast("timestamp"), now.cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def rfc3339(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sync_deadline(reset_at: Column, observed_at: Column, retry: Column) -> Column:
    """When a sync may go on: at the reset, else so many seconds after the observation, none if negative."""
    return F.coalesce(reset_at, observed_at + F.when(retry > 0, retry).when(retry <= 0, 0))


def schedule_deadline(reset_at: Column, observed_at: Column, retry: Column, most: int = 86400) -> Column:
    """When a schedule may go on: the later of both, the wait being between nothing and a day."""
    return F.greatest(reset_at, observed_at + F.when(retry > most, most).when(retry > 0, retry).when(retry <= 0, 0))


def reserve(limit: Column) -> Column:
    """Requests kept back: a fifth, rounded up."""
    return F.ceil(limit / 5).cast("bigint")


def jitter_seconds(ids: Column, slots: int = 15, step: int = 60) -> Column:
    """A fixed delay from a set of ids: the first 8 bytes of their digest modulo ``slots``."""
    digest = F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), "\n"), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % slots).cast("bigint") * step
