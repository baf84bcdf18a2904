"""What a run has done so far, counted as its rows pass, without a pass of its own.

Each step's rows are observed where they are written; a listener takes the counts when the
write ends, hands them to a callback and keeps them. Documents that fail are counted, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """Counts by step, in the order in which the steps ended."""

    def __init__(self, told: Callable[[str, dict], None] | None = None):
        self.told, self.steps = told, {}

    def step(self, name: str, rows: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> None:
        """write(rows), whose rows are counted by the way: all of them (``rows``), and ``counts``, aggregates by name."""
        seen = Observation(name)
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items())))
        self.steps[name] = dict(seen.get)
        if self.told:
            self.told(name, self.steps[name])

    def table(self, spark) -> DataFrame:
        """(step, counted, n)."""
        rows = [(s, c, int(n)) for s, own in self.steps.items() for c, n in own.items() if n is not None]
        return spark.createDataFrame(rows, "step string, counted string, n long")
