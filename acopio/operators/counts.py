"""Counts that come with a result: taken while it is written, without reading anything twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stage


class Counts:
    """What the steps of a plan dropped or changed, by name.

    A step that is given a ``Counts`` watches its rows on their way; the numbers are there once the result has been
    written (``written``) or collected. Each step's rows are counted when they pass for the first time.
    """

    def __init__(self):
        self._seen: list[Observation] = []

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df`` with counts of rows for which each condition holds; a condition that is null does not."""
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[F.count_if(F.coalesce(m, F.lit(False))).alias(name) for name, m in metrics.items()])

    def watch_sums(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df`` with sums of whole numbers; none is 0."""
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(name) for name, m in metrics.items()])

    def written(self, df: DataFrame, label: str = "counted") -> DataFrame:
        """Write the result once, for whoever goes on with it; the counts are those of this write."""
        return stage(df, label)

    def get(self) -> dict[str, int]:
        """Name -> count, steps of one name added up. Waits for the write."""
        out: dict[str, int] = {}
        for seen in self._seen:
            for name, n in seen.get.items():
                out[name] = out.get(name, 0) + n
        return out
