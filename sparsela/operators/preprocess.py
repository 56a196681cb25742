"""Statistics, batches, images and whitening."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .encode import list_column, matrix_of


def dataset_stats(df: DataFrame, x: str = "x", ddof: int = 1) -> DataFrame:
    """Per feature: n, mean, std, variance, min, max; ddof 1 or 0 (population)."""
    g = df.select(F.posexplode(A.doubles(x)).alias("feature", "v")).groupBy("feature")
    std, var = (F.stddev_samp, F.var_samp) if ddof else (F.stddev_pop, F.var_pop)
    return g.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), std("v").alias("std"), var("v").alias("variance"), F.min("v").alias("min"), F.max("v").alias("max"))


def standardize(df: DataFrame, columns: list[str], eps: float = 1e-12) -> DataFrame:
    """Adds ``x``: the columns as a vector of z-scores (population deviation)."""
    s = df.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop)))
    z = F.array(*((F.col(c) - F.col(f"avg_{c}")) / (F.col(f"stddev_pop_{c}") + eps) for c in columns))
    return df.crossJoin(F.broadcast(s)).withColumn("x", z).drop(*s.columns)


def chunk(df: DataFrame, k: int, size: int, id_col: str = "sample_id") -> DataFrame:
    """Chunk k of ``size`` ids: a range filter that reaches the scan."""
    return df.where((F.col(id_col) >= k * size) & (F.col(id_col) < (k + 1) * size))


def column_range(df: DataFrame, start: int, end: int | None = None, batch: int = 10_000, id_col: str = "sample_id") -> DataFrame:
    """Rows with start <= id < end and the number of their batch."""
    c = F.col(id_col)
    df = df.where((c >= start) & (c < end) if end is not None else c >= start)
    return df.withColumn("batch", F.floor((c - start) / batch))


def random_batch(df: DataFrame, size: int, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """``size`` rows without replacement, those with the smallest seeded hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(size)


def take(df: DataFrame, ids: list[int], id_col: str = "sample_id") -> DataFrame:
    """Rows by a list of ids; order (column ``position``) and repeats are kept."""
    want = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"position int, {id_col} long")
    return want.join(df, id_col)


def align(*tables: DataFrame, id_col: str = "sample_id", strict: bool = True) -> DataFrame:
    """Tables joined by id. strict: unequal counts raise; otherwise the ids that all tables have stay,
    whatever gaps there are between them."""
    if strict and len(set(counts := [t.count() for t in tables])) > 1:
        raise ValueError(f"tables have different numbers of samples: {counts}")
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, id_col)
    return out


def stack(*tables: DataFrame, x: str = "x") -> DataFrame:
    """All rows of all tables; vectors must have one length."""
    sizes = {t.select(F.size(x)).first()[0] for t in tables}
    if len(sizes) > 1:
        raise ValueError(f"tables have vectors of different lengths: {sorted(sizes)}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def pool(codes: DataFrame, by: str, how: str = "max") -> DataFrame:
    """Codes of a group's samples pooled atom by atom: ``max`` (of |a|), ``mean`` or ``sum``."""
    f = {"max": F.max(F.abs("coef")), "mean": F.avg("coef"), "sum": F.sum("coef")}[how]
    return codes.select(by, F.posexplode("a").alias("atom_id", "coef")).groupBy(by, "atom_id").agg(f.alias("value"))


def patches(images: DataFrame, h: int, w: int, overlap: float = 0.5, pix: str = "pix", id_col: str = "image_id") -> DataFrame:
    """Sliding h x w patches (row-major vectors) of images given as arrays of rows."""
    step = lambda n: max(1, int(n * (1 - overlap)))
    height, width = F.size(pix), F.size(F.element_at(pix, 1))
    at = images.where((height >= h) & (width >= w)).select(id_col, pix, F.explode(F.sequence(F.lit(0), height - h, F.lit(step(h)))).alias("i"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.size(F.element_at(pix, 1)) - w, F.lit(step(w)))).alias("j"))
    x = F.flatten(F.transform(F.slice(pix, F.col("i") + 1, h), lambda r: F.slice(r, F.col("j") + 1, w)))
    return at.select(id_col, "i", "j", x.alias("x"))


def sample_patches(images: DataFrame, h: int, w: int, n: int, seed: int = 0, pix: str = "pix", id_col: str = "image_id") -> DataFrame:
    """n patches with the mean taken off, at places picked by hash."""
    p = patches(images, h, w, 1 - 1 / max(h, w), pix, id_col)
    return p.orderBy(F.xxhash64(F.lit(seed), id_col, "i", "j")).limit(n).withColumn("x", A.center("x"))


def filter_response(h: int, w: int, f0: float = 200.0) -> np.ndarray:
    """Zero-phase whitening filter R exp(-(R / f0)^4), R the radial frequency in cycles an image."""
    r = np.hypot(np.fft.fftfreq(h)[:, None] * h, np.fft.fftfreq(w)[None] * w)
    return r * np.exp(-((r / f0) ** 4))


def whiten(img: np.ndarray, f0: float = 200.0, eps: float = 1e-12) -> np.ndarray:
    """Filtered image, mean 0 and deviation 1 (zeros for a flat image)."""
    if img.ndim != 2:
        raise ValueError("an image has two dimensions")
    out = np.fft.ifft2(np.fft.fft2(img) * filter_response(*img.shape, f0)).real
    out = out - out.mean()
    s = out.std()
    return out / s if s > eps else np.zeros_like(out)


def adaptive_cutoff(img: np.ndarray, percentile: float = 90.0) -> float:
    """Cut-off from the spectrum: half the percentile of power times radius, within [50, 400]."""
    r = np.hypot(np.fft.fftfreq(img.shape[0])[:, None] * img.shape[0], np.fft.fftfreq(img.shape[1])[None] * img.shape[1])
    v = np.sort((np.abs(np.fft.fft2(img)) ** 2 * r).ravel())
    return float(np.clip(0.5 * v[min(len(v) - 1, int(percentile / 100 * len(v)))], 50, 400))


def zero_phase_whiten(df: DataFrame, side: tuple[int, int], f0: float | None = 200.0, x: str = "x") -> DataFrame:
    """Whitened images, flattened row by row; f0 None: cut-off from each image's spectrum."""
    names = df.columns
    at = names.index(x)

    def run(batches):
        for b in batches:
            m = matrix_of(b.column(at)).reshape(-1, *side)
            out = np.array([whiten(i, f0 if f0 is not None else adaptive_cutoff(i)).ravel() for i in m]).reshape(len(m), side[0] * side[1])
            yield b.set_column(at, x, list_column(out))

    src = df.withColumn(x, A.doubles(x))
    return src.mapInArrow(run, src.schema)


def running(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Running count, mean and population variance of ``value``, per group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    n, m = F.count(v).over(w), F.avg(v).over(w)
    return df.withColumns({"n": n, "mean": m, "variance": F.greatest(F.lit(0.0), F.avg(v * v).over(w) - m * m)})


def ema(df: DataFrame, value: str, order: list[str], by: list[str], factor: float = 0.9) -> DataFrame:
    """Exponential average s <- f s + (1 - f) v from the first value on, at the end of each group."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda r: r[value])
    g = df.groupBy(*by).agg(seq.alias("_v"))
    return g.select(*by, F.aggregate(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), F.element_at("_v", 1), lambda s, v: factor * s + (1 - factor) * v).alias("ema"))


def slopes(df: DataFrame, value: str, order: list[str], by: list[str], rows: int = 10) -> DataFrame:
    """(last - first) / rows in the frame, over the last ``rows`` values up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("slope", (F.last(value).over(w) - F.first(value).over(w)) / F.count(value).over(w))


