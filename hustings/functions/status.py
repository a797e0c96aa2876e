"""A row's status as of a moment, from its received, verified and declared times."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from .numbers import col

NOT_RECEIVED, VERIFYING, COUNTING, DECLARED = STATUSES = ("Not Received", "Verifying", "Counting", "Declared")


def as_moment(now: Column | str) -> Column:
    """``now`` is always given, never read from a clock, so that results can be had again."""
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def status(now: Column | str, received: str = "received_at", verified: str = "verified_at", declared: str = "declared_at") -> Column:
    now = as_moment(now)
    return F.when(col(declared) <= now, DECLARED).when(col(verified) <= now, COUNTING).when(col(received) <= now, VERIFYING).otherwise(NOT_RECEIVED)


def rank(state: Column | str) -> Column:
    """0 to 3, in the order of STATUSES."""
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), col(state)).cast("int") - 1


def at_least(state: Column | str, least: str) -> Column:
    return rank(state) >= STATUSES.index(least)
