"""Counters that ride on the pass that writes a table: no job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.operators.matching import PARK_REASONS


class Counters:
    """What was counted while tables were written. Each watched table is written once; its counts are there afterwards."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df``, whose next writing counts ``metrics``; empty tables count zero."""
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[F.coalesce(m, F.lit(0)).cast("long").alias(n) for n, m in metrics.items()])

    def totals(self) -> dict[str, int]:
        """Sums by name over all watched tables. It waits for their writing, so a table that is never written must not be watched."""
        out: dict[str, int] = {}
        for seen in self._seen:
            for name, n in seen.get.items():
                out[name] = out.get(name, 0) + (n or 0)
        return out


def by_reason(reason: str = "reason", prefix: str = "parked_") -> dict[str, Column]:
    """A counter for every park reason."""
    return {f"{prefix}{r.lower()}": F.count_if(F.col(reason) == r) for r in PARK_REASONS}


def id_bounds(df: DataFrame, column: str) -> DataFrame:
    """``least, most`` of an id: two aggregates that Parquet answers from its footers where they are pushed down."""
    return df.agg(F.min(column).alias("least"), F.max(column).alias("most"))
