"""Measured evaluations: the rows that a scoring pass really wrote, and the wall time it took."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.session import hand_off


@dataclass
class Pass:
    """A written scoring pass: its table, the rows counted while it was written, and its seconds."""
    table: DataFrame
    rows: int
    seconds: float

    def runtime(self, n_rows: Column) -> Column:
        """Seconds of one run: all runs are scored in one pass, a run's share is its share of the rows."""
        return F.lit(self.seconds) * n_rows / F.lit(float(max(1, self.rows)))


def measured(scored: DataFrame, name: str = "measured") -> Pass:
    """Writes ``scored`` and counts its rows in the same pass (no second job for the count)."""
    seen = Observation(name)
    began = time.perf_counter()
    table = hand_off(scored.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return Pass(table, int(seen.get["rows"]), time.perf_counter() - began)
