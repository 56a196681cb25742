"""Quality and interpretability of codes: plain DataFrame queries.

``codes`` has (sample_id, a array<double>); the long view has a row per sample and atom.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .dictionary import summed

ACTIVE = 1e-8


def long_view(codes: DataFrame, a: str = "a", keep: tuple[str, ...] = ()) -> DataFrame:
    # the outer form: the inner one makes Spark compute the codes a second time, in a filter on their size
    return codes.select("sample_id", *keep, F.posexplode_outer(a).alias("atom_id", "coef")).where("atom_id is not null")


def per_sample_activity(codes: DataFrame, threshold: float = ACTIVE) -> DataFrame:
    """Active atoms and their share for each sample."""
    n = A.count_active("a", threshold)
    return codes.select("sample_id", n.alias("n_active"), (n / F.size("a")).alias("active_share"))


def code_summary(codes: DataFrame, threshold: float = ACTIVE) -> DataFrame:
    """One row: samples, atoms, sparsity, mean and deviation (population) of active atoms a sample,
    largest magnitude, mean of the active (signed) coefficients."""
    each = codes.select(F.size("a").alias("k"), A.count_active("a", threshold).alias("n"), A.norm("a", float("inf")).alias("top"), A.total(F.filter("a", lambda v: F.abs(v) > threshold)).alias("s"))
    return each.agg(
        F.count("*").alias("n_samples"), F.max("k").alias("n_atoms"), (1 - F.sum("n") / F.sum("k")).alias("sparsity"), F.avg("n").alias("mean_active"),
        F.stddev_pop("n").alias("std_active"), F.max("top").alias("max_activation"), (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_strength"),
    )


def feature_stats(codes: DataFrame, threshold: float = ACTIVE) -> DataFrame:
    """Per atom: frequency, mean |a| and mean a of active samples, largest |a|, energy, dead flag."""
    on = F.abs("coef") > threshold
    g = long_view(codes).groupBy("atom_id")
    return g.agg(
        F.avg(on.cast("double")).alias("frequency"), F.coalesce(F.avg(F.when(on, F.abs("coef"))), F.lit(0.0)).alias("mean_abs"),
        F.coalesce(F.avg(F.when(on, F.col("coef"))), F.lit(0.0)).alias("mean_signed"), F.max(F.abs("coef")).alias("max_abs"),
        F.sqrt(F.avg(F.col("coef") * F.col("coef")) + 1e-12).alias("energy"), (F.count_if(on) == 0).alias("dead"),
    )


def top_samples(codes: DataFrame, k: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k samples with the largest |a| for each atom; of equal values the smaller id first."""
    w = Window.partitionBy("atom_id").orderBy(F.desc(F.abs("coef")), "sample_id")
    return long_view(codes, keep=keep).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coactivation(codes: DataFrame, min_lift: float = 0.0, threshold: float = ACTIVE) -> DataFrame:
    """Lift P(i, j) / (P(i) P(j)) of atom pairs i < j that occur together, above ``min_lift``.

    One pass: the Gram matrix of the indicators of active atoms, K x K numbers."""
    s = summed(codes, ["a"], lambda a: {"g": (on := (np.abs(a) > threshold).astype(float)).T @ on, "n": [len(a)]})
    if not s:
        return codes.sparkSession.createDataFrame([], "i int, j int, both long, lift double")
    g = s["g"]
    c = np.diag(g)
    i, j = np.nonzero(np.triu(g, 1))
    lift = g[i, j] * s["n"][0, 0] / (c[i] * c[j])
    keep = lift > min_lift
    t = {"i": i[keep].astype(np.int32), "j": j[keep].astype(np.int32), "both": g[i, j][keep].astype(np.int64), "lift": lift[keep]}
    return codes.sparkSession.createDataFrame(pa.table(t))


def correlations(codes: DataFrame, dead_variance: float = 1e-10) -> DataFrame:
    """Pearson correlation of atom pairs i < j; 0 where an atom's variance is under ``dead_variance``;
    within [-1, 1]. One pass: sums and the Gram matrix of the codes, K x K numbers."""
    s = summed(codes, ["a"], lambda a: {"g": a.T @ a, "s": a.sum(0), "n": [len(a)]})
    if not s:
        return codes.sparkSession.createDataFrame([], "i int, j int, corr double")
    n, m = s["n"][0, 0], s["s"][0]
    cov = (s["g"] - np.outer(m, m) / n) / max(n - 1, 1)
    var = np.diag(cov)
    alive = var >= dead_variance
    d = np.sqrt(np.where(alive, var, 1))
    r = np.where(np.outer(alive, alive), np.clip(cov / np.outer(d, d), -1, 1), 0.0)
    i, j = np.triu_indices(len(r), 1)
    return codes.sparkSession.createDataFrame(pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "corr": r[i, j]}))


def correlated_pairs(codes: DataFrame, threshold: float = 0.5) -> DataFrame:
    return correlations(codes).where(F.abs("corr") > threshold)


def selectivity(codes: DataFrame, bins: int = 10, threshold: float = ACTIVE) -> DataFrame:
    """1 - H / log(bins) of the histogram of each atom's active values; 0 with fewer than two."""
    on = long_view(codes).where(F.abs("coef") > threshold)
    edge = on.groupBy("atom_id").agg(F.min("coef").alias("lo"), F.max("coef").alias("hi"), F.count("*").alias("n"))
    h = on.join(edge, "atom_id").groupBy("atom_id", "n", _bin("coef", "lo", "hi", bins).alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    s = h.groupBy("atom_id", "n").agg((-F.sum(p * F.ln(p))).alias("h"))
    every = long_view(codes).select("atom_id").distinct()
    value = F.when(F.coalesce("n", F.lit(0)) < 2, 0.0).otherwise(1 - F.col("h") / F.ln(F.lit(float(bins))))
    return every.join(s, "atom_id", "left").select("atom_id", value.alias("selectivity"))


def _bin(v: str, lo: str, hi: str, bins: int) -> Column:
    """Left-closed bins, the last one closed; a single value is in bin 0."""
    width = F.col(hi) - F.col(lo)
    return F.when(width <= 0, 0).otherwise(F.least(F.floor((F.col(v) - F.col(lo)) / width * bins), F.lit(bins - 1))).cast("int")


def code_histogram(codes: DataFrame, bins: int = 50, threshold: float = ACTIVE) -> DataFrame:
    """Histogram of the magnitudes of active coefficients: bin, count."""
    on = long_view(codes).where(F.abs("coef") > threshold).select(F.abs("coef").alias("v"))
    edge = on.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return on.crossJoin(F.broadcast(edge)).groupBy(_bin("v", "lo", "hi", bins).alias("bin")).agg(F.count("*").alias("n"))


def mutual_information(codes: DataFrame, i: int, j: int, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of two atoms' coefficients over equal-width bins."""
    v = codes.select(F.get("a", i).alias("u"), F.get("a", j).alias("v"))
    edge = v.agg(F.min("u").alias("lu"), F.max("u").alias("hu"), F.min("v").alias("lv"), F.max("v").alias("hv"), F.count("*").alias("n"))
    b = v.crossJoin(F.broadcast(edge)).groupBy("n", _bin("u", "lu", "hu", bins).alias("bu"), _bin("v", "lv", "hv", bins).alias("bv")).agg(F.count("*").alias("c"))
    # bins x bins rows from here on
    pu, pv = F.sum("c").over(Window.partitionBy("bu")), F.sum("c").over(Window.partitionBy("bv"))
    each = b.select("c", "n", pu.alias("cu"), pv.alias("cv"))
    p = F.col("c") / F.col("n")
    return each.agg(F.greatest(F.lit(0.0), F.sum(p * F.ln(F.col("c") * F.col("n") / (F.col("cu") * F.col("cv"))))).alias("mi"))


def coherence(atoms: DataFrame) -> DataFrame:
    """Largest |cosine| of two different atoms."""
    a = atoms.select("atom_id", A.normalize("atom").alias("u"))
    b = a.select(F.col("atom_id").alias("other"), F.col("u").alias("v"))
    return a.join(F.broadcast(b), F.col("atom_id") < F.col("other")).agg(F.max(F.abs(A.dot("u", "v"))).alias("coherence"))


def gini(codes: DataFrame) -> DataFrame:
    """Gini index of each sample's magnitudes (0 even, near 1 sparse)."""
    s = F.array_sort(F.transform("a", F.abs))
    n = F.size("a")
    t = codes.select("sample_id", s.alias("s"), n.alias("n"))
    up = A.total(F.transform("s", lambda v, i: v * (n_() - i - 0.5)))
    norm = A.total("s")
    return t.select("sample_id", F.when(norm > 0, 1 - 2 * up / (norm * F.col("n"))).otherwise(0.0).alias("gini"))


def n_() -> Column:
    return F.col("n").cast("double")


def interpretability(codes: DataFrame, threshold: float = 1e-6, dead: float = 0.01) -> DataFrame:
    """One row: share of dead atoms, deviation of activation frequencies, mean active atoms, sparsity."""
    f = feature_stats(codes, threshold)
    return f.agg(F.avg((F.col("frequency") < dead).cast("double")).alias("dead_ratio"), F.stddev_pop("frequency").alias("frequency_std"), F.sum("frequency").alias("mean_active"), (1 - F.avg("frequency")).alias("sparsity"))


def reconstruction(df: DataFrame, x: str = "x", x_hat: str = "x_hat") -> DataFrame:
    """One row: mean squared error over all entries, relative error, signal-to-noise in dB."""
    r = df.select(A.total(F.zip_with(x, x_hat, lambda u, v: (u - v) * (u - v))).alias("e"), A.dot(x, x).alias("q"), F.size(x).alias("p"))
    return r.agg((F.sum("e") / F.sum("p")).alias("mse"), F.sqrt(F.sum("e") / F.sum("q")).alias("relative_error"), (10 * F.log10(F.sum("q") / F.nullif(F.sum("e"), F.lit(0.0)))).alias("snr_db"))


def rank_features(stats: DataFrame, by: str = "frequency") -> DataFrame:
    w = Window.orderBy(F.desc(by), "atom_id")  # a row for each atom
    return stats.withColumn("rank", F.row_number().over(w))


def atlas(codes: DataFrame, by: str = "frequency", top: int = 5) -> DataFrame:
    """Per atom: statistics, selectivity, rank and its top samples."""
    best = top_samples(codes, top).groupBy("atom_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample_id"))), lambda s: s["sample_id"]).alias("top_samples"))
    stats = feature_stats(codes).join(selectivity(codes), "atom_id")
    return rank_features(stats, by).join(best, "atom_id", "left")


def region_cv(codes: DataFrame, region: str, threshold: float = 0.5) -> DataFrame:
    """Per atom: variation coefficient of its mean |a| over regions, and whether it is above the
    threshold (the atom prefers some regions)."""
    m = long_view(codes, keep=(region,)).groupBy("atom_id", region).agg(F.avg(F.abs("coef")).alias("m"))
    s = m.groupBy("atom_id").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
    cv = F.when(F.col("mean") > 1e-12, F.col("std") / F.col("mean")).otherwise(0.0)
    return s.select("atom_id", cv.alias("cv"), (cv > threshold).alias("varies"))


def polysemantic(codes: DataFrame, signals: DataFrame, atom_id: int, clusters: int = 5, seed: int = 0, threshold: float = ACTIVE) -> dict:
    """Whether an atom answers to several kinds of signals: k-means of its active signals, quality
    (silhouette, squared distances), share of valid clusters, frequency and balance in one score."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    active = codes.where(F.abs(F.get("a", atom_id)) > threshold).select("sample_id").join(signals, "sample_id").select(array_to_vector(A.doubles("x")).alias("features"))
    n, total = active.count(), codes.count()
    if n < 2 * clusters:
        return {"atom_id": atom_id, "score": 0.0, "label": "low", "polysemantic": False}
    out = KMeans(k=clusters, seed=seed).fit(active).transform(active)
    sil = ClusteringEvaluator().evaluate(out)
    sizes = [r["count"] for r in out.groupBy("prediction").count().collect()]
    valid = sum(s >= 0.05 * n for s in sizes) / clusters
    score = 0.4 * max(sil, 0) + 0.3 * valid + 0.2 * n / total + 0.1 * min(sizes) / max(sizes)
    return {"atom_id": atom_id, "score": score, "label": "high" if score > 0.7 else "medium" if score > 0.4 else "low", "polysemantic": sil > 0.3 and valid * clusters >= 2}


def compare_methods(results: dict[str, DataFrame]) -> DataFrame:
    """mse, sparsity and active atoms by method; each table has x, a and x_hat."""
    out = None
    for name, df in results.items():
        e = df.select(A.total(F.zip_with("x", "x_hat", lambda u, v: (u - v) * (u - v))).alias("e"), F.size("x").alias("p"), A.count_active("a", ACTIVE).alias("n"), F.size("a").alias("k"))
        row = e.agg((F.sum("e") / F.sum("p")).alias("mse"), (1 - F.sum("n") / F.sum("k")).alias("sparsity"), F.avg("n").alias("mean_active")).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
