"""Training logs and the tables behind the usual charts; drawing is left to the reader's tools."""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import analytics


class MetricLog:
    """Rows (ts, step, metric, value), kept in memory and written as one table."""

    def __init__(self):
        self.rows: list[tuple] = []

    def log(self, step: int, **metrics: float) -> None:
        now = time.time()
        self.rows += [(now, step, k, float(v)) for k, v in metrics.items()]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "ts double, step int, metric string, value double")

    def slope(self, metric: str, rows: int = 10) -> float:
        """(last - first) / n over the last rows of a metric."""
        v = [r[3] for r in self.rows if r[2] == metric][-rows:]
        return (v[-1] - v[0]) / len(v) if v else 0.0


def log(**fields) -> None:
    """A JSON line on standard output."""
    print(json.dumps({"ts": time.time(), **fields}), file=sys.stdout, flush=True)


def atom_mosaic(atoms: DataFrame, width: int) -> DataFrame:
    """Atoms scaled to [0, 1] and folded into rows of ``width``."""
    return atoms.select("atom_id", A.reshape(A.minmax("atom"), width).alias("image"))


def sparsity_report(codes: DataFrame, bins: int = 50) -> dict[str, DataFrame]:
    """Histogram of magnitudes, activity by sample, usage by atom."""
    return {"histogram": analytics.code_histogram(codes, bins), "samples": analytics.per_sample_activity(codes), "atoms": analytics.feature_stats(codes)}


def reconstruction_report(df: DataFrame, x: str = "x", x_hat: str = "x_hat") -> DataFrame:
    """Per sample: mean squared error and largest absolute error."""
    e = F.zip_with(x, x_hat, lambda u, v: F.abs(u - v))
    return df.select("sample_id", (A.total(F.transform(e, lambda v: v * v)) / F.size(x)).alias("mse"), F.array_max(e).alias("max_error"))


def atlas_text(atlas: DataFrame, top: int = 10) -> str:
    """The first features of an atlas as lines of text."""
    rows = atlas.where(F.col("rank") <= top).orderBy("rank").collect()
    return "\n".join(f"{r['rank']:>3}. atom {r['atom_id']}: active in {r['frequency']:.1%}, largest {r['max_abs']:.4g}, selectivity {r['selectivity']:.3f}, samples {r['top_samples']}" for r in rows)


def report(codes: DataFrame, atoms: DataFrame, width: int, x: str | None = None, x_hat: str | None = None) -> dict[str, DataFrame]:
    """All tables behind the charts of a learned dictionary: atoms, sparsity and, where signals and their
    reconstructions are columns of ``codes``, errors."""
    out = {"mosaic": atom_mosaic(atoms, width), **sparsity_report(codes)}
    return out | ({"errors": reconstruction_report(codes, x, x_hat)} if x and x_hat else {})
