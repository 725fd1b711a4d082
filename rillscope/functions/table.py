"""Functions that SQL can call on a table: one partition of the argument is one series."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

OUT = "series_id string, epoch double, confidence double"


class KeepGap:
    """Candidates (series_id, epoch, confidence) in time order, each at least ``gap`` seconds after the one kept before."""

    def __init__(self) -> None:
        self.last: float | None = None

    def eval(self, gap: float, row: Row):
        if self.last is None or row["epoch"] - self.last >= gap:
            self.last = row["epoch"]
            yield row["series_id"], float(row["epoch"]), float(row["confidence"])


class DetectPelt:
    """Change points of the minima (series_id, epoch_us, epoch, rtt_value) of a series, by the cost ``model``."""

    def __init__(self) -> None:
        self.rows: list[tuple[float, float]] = []
        self.series, self.model = None, "rbf"

    def eval(self, model: str, row: Row):
        self.series, self.model = row["series_id"], model
        self.rows.append((row["epoch"], row["rtt_value"]))

    def terminate(self):
        import numpy as np

        from ..operators.sequential import pelt

        epochs, values = np.array(sorted(self.rows)).reshape(-1, 2).T
        for i, c in zip(*pelt(epochs, values, self.model)[:2], strict=True):
            yield self.series, float(epochs[i]), float(c)


def register_functions(spark: SparkSession) -> None:
    """Make ``rill_keep_gap(gap, TABLE(..) PARTITION BY series_id ORDER BY epoch)`` and ``rill_detect_pelt(model, TABLE(..) PARTITION BY series_id)`` callable."""
    spark.udtf.register("rill_keep_gap", F.udtf(KeepGap, returnType=OUT))
    spark.udtf.register("rill_detect_pelt", F.udtf(DetectPelt, returnType=OUT))
