"""Recency of keyed histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.operators.joins import join_reduced


def active_keys(history: DataFrame, key: str, ts: str, days: int = 5, asof: Column | None = None) -> DataFrame:
    """Keys with a row in the last days; without ``asof`` the newest row sets the clock."""
    if asof is None:
        asof = history.select(F.max(ts)).scalar()
    recent = F.col(ts) > asof - F.expr(f"interval {int(days)} days")
    return history.where(recent).select(key).distinct()


def keep_active(history: DataFrame, key: str, ts: str, days: int = 5, asof: Column | None = None) -> DataFrame:
    """The full history of the live keys, gaps untouched."""
    return join_reduced(history, active_keys(history, key, ts, days, asof), [key], "left_semi")
