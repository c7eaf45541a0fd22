"""Metrics of a run, observed while its rows go by: no second pass over them."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class RunMetrics:
    """Counts by name, summed over all places where they are watched. A counter tells of the first action that ran its plan."""

    def __init__(self):
        self._watched: list[Observation] = []

    def watch(self, rows: DataFrame, **counters: Column) -> DataFrame:
        """rows; as they pass, those for which each condition holds are counted."""
        own = Observation()
        self._watched.append(own)
        return rows.observe(own, *[F.count(F.when(c, 1)).alias(n) for n, c in counters.items()])

    def told(self) -> dict[str, int]:
        """The counts; waits for the first action over each watched plan."""
        out: dict[str, int] = {}
        for o in self._watched:
            for name, n in o.get.items():
                out[name] = out.get(name, 0) + n
        return out


def watched(metrics: RunMetrics | None, rows: DataFrame, **counters: Column) -> DataFrame:
    return metrics.watch(rows, **counters) if metrics else rows
