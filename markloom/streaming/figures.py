"""Figures of a running job, from the job itself.

Metrics are attached to a plan with ``observe`` and come out with the rows that
pass it, so nothing is read twice.  A batch's are known when its write is done,
a stream's after each micro-batch, through a listener that adds them up and
keeps the milestones: one each time another tenth of the total is done.

Edge cases: a job without rows has counts of 0 and null sums; a failed write
raises and has no figures; a restarted stream's listener starts from the
figures it is given.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQueryListener

STEPS = 10


def usage_metrics() -> list[Column]:
    """calls, tokens and cost over rows (tokens, cost)."""
    return [F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost")]


def written_with_figures(df: DataFrame, path: str, *metrics: Column) -> dict:
    """Writes df as Parquet and returns the metrics of the rows written."""
    seen = Observation()
    df.observe(seen, *metrics).write.parquet(path)
    return seen.get


def milestone_every(total: int, steps: int = STEPS) -> int:
    return max(1, total // steps)


@dataclass
class Progress(StreamingQueryListener):
    """Adds up the metrics observed under ``name``; done counts rows of metric ``count``."""

    name: str
    total: int
    count: str = "calls"
    figures: dict = field(default_factory=dict)
    milestones: list = field(default_factory=list)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.add(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def done(self) -> int:
        return self.figures.get(self.count, 0)

    def add(self, row: dict) -> None:
        before, every = self.done, milestone_every(self.total)
        for k, v in row.items():
            self.figures[k] = self.figures.get(k, 0) + (v or 0)
        if self.done // every > before // every or (self.done >= self.total > before):
            self.milestones.append((self.done, self.total))

    def eta_seconds(self, elapsed: float) -> float | None:
        """Seconds left at the rate so far; None before the first row."""
        return None if not self.done or not self.total else math.fabs(elapsed) / self.done * max(0, self.total - self.done)
