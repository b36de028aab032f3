"""Columns over times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def millis_between(start: Column, end: Column) -> Column:
    return millis(end) - millis(start)


def still_valid(expires: Column, now: Column, slack_minutes: int = 5) -> Column:
    """Expires later than some minutes from now; null is no time."""
    return F.coalesce(expires > now + F.make_interval(mins=F.lit(slack_minutes)), F.lit(False))


def reset_token_matches(token: Column, stored: Column, expires: Column, now: Column) -> Column:
    """P13."""
    return F.coalesce((F.sha2(token, 256) == stored) & (expires > now), F.lit(False))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_days(created: Column, now: Column) -> Column:
    return F.floor(millis_between(created, now) / 86_400_000)
