"""Structured Streaming: learning, encoding and metrics on unbounded signals."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.penalties import Penalty
from ..operators.encode import atoms_of, encode
from ..operators.learn import OnlineDictionaryLearner


def learn_stream(stream: DataFrame, learner: OnlineDictionaryLearner, checkpoint: str, state: str | None = None, id_col: str = "sample_id", x: str = "x") -> StreamingQuery:
    """Updates the learner with every micro-batch that is not empty.

    With ``state``, the atoms and the learner's averages are written there after each batch, under
    the batch's number; a query that restarts from its checkpoint goes on from the last one, and a
    batch that comes again is not counted twice."""
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        if state and (last := load_state(spark, state)):
            if last["batch_id"] >= batch_id:
                return
            restore(learner, last)
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                learner.partial_fit(batch, id_col, x)
                if state:
                    spark.createDataFrame([(batch_id, dump(learner))], "batch_id long, state string").coalesce(1).write.mode("append").parquet(state)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dump(learner: OnlineDictionaryLearner) -> str:
    o = learner._online
    lists = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    return json.dumps({"atoms": lists(learner.atoms), "stats": {k: lists(v) for k, v in learner.stats.items()}, "t": o.t, "n": o.n, "gram": lists(o.gram), "cross": lists(o.cross)})


def load_state(spark, path: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("batch_id long, state string").parquet(path).orderBy(F.desc("batch_id")).first()
    except AnalysisException:
        return None
    return {"batch_id": row["batch_id"], **json.loads(row["state"])} if row else None


def restore(learner: OnlineDictionaryLearner, s: dict) -> None:
    back = lambda v: np.array(v, float) if isinstance(v, list) else v
    learner.atoms, learner.stats = back(s["atoms"]), {k: back(v) for k, v in s["stats"].items()}
    o = learner._online
    o.t, o.n, o.gram, o.cross = s["t"], s["n"], back(s["gram"]), back(s["cross"])


def encode_stream(stream: DataFrame, atoms, penalty: Penalty, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Codes of a stream of signals, appended to Parquet files under ``path``."""
    codes = encode(stream, atoms_of(atoms), penalty, **kw)
    return codes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(stream: DataFrame, ts: str, value: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation, min and max per event-time window; state is dropped at the watermark."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by)
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), *by, "n", "mean", "std", "min", "max")


class FeatureMetrics:
    """Running per-feature n, mean, variance (n - 1), min and max over batches, merged exactly."""

    def __init__(self):
        self.n, self.mean, self.m2, self.min, self.max = 0, 0.0, 0.0, np.inf, -np.inf

    def update(self, batch: DataFrame, x: str = "x") -> FeatureMetrics:
        g = batch.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = g.orderBy("i").collect()  # a row for each feature
        if rows:
            n, m, s, lo, hi = (np.array([r[c] for r in rows], float) for c in ("n", "m", "s", "lo", "hi"))
            b = n[0]
            delta = m - self.mean
            self.m2 = self.m2 + s * b + delta * delta * self.n * b / (self.n + b)
            self.mean, self.n = self.mean + delta * b / (self.n + b), self.n + b
            self.min, self.max = np.minimum(self.min, lo), np.maximum(self.max, hi)
        return self

    def get_stats(self) -> dict:
        var = self.m2 / max(self.n - 1, 1)
        return {"n": self.n, "mean": self.mean, "variance": var, "std": np.sqrt(var), "min": self.min, "max": self.max}


def batch_number(df: DataFrame, total: int, id_col: str) -> Column:
    """Number 0 .. total - 1 of a row's batch by ranges of ids that hold about as many rows each,
    whatever the ids are; null ids are in the first. One aggregate."""
    at = [k / total for k in range(1, total)]
    bounds = df.agg(F.percentile_approx(id_col, at, max(10_000, 20 * total))).first()[0] if at else None
    if not bounds:
        return F.lit(0)
    over = F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: F.col(id_col) > b)
    return F.coalesce(F.size(over), F.lit(0)) if len(bounds) else F.lit(0)


def process_dataset(df: DataFrame, fn, batch_size: int, epochs: int = 1, shuffle: bool = False, drop_last: bool = False, id_col: str = "sample_id", seed: int = 0, on_error: str = "raise") -> dict:
    """``fn(batch)`` for batches of about ``batch_size`` rows, in order of id or dealt by hash; gives
    the results and counts of what was really handed over.

    Every row is in one batch of an epoch, whatever its id. Empty batches are not handed over.
    drop_last leaves out the last batch where there is more than one. With ``on_error="count"`` a
    batch whose fn raises is counted and the others go on."""
    import time

    n = df.count()
    total = max(1, -(-n // batch_size))
    results, began, seen, failed = [], time.time(), 0, 0
    samples = 0
    for e in range(epochs):
        key = F.pmod(F.xxhash64(F.lit(seed + e), id_col), F.lit(total)).cast("int") if shuffle else batch_number(df, total, id_col)
        dealt = df.withColumn("_batch", key)
        rows = {r["_batch"]: r["n"] for r in dealt.groupBy("_batch").agg(F.count("*").alias("n")).collect()}  # a row for each batch
        for k in sorted(rows)[: len(rows) - (drop_last and len(rows) > 1)]:
            try:
                results.append(fn(dealt.where(F.col("_batch") == k).drop("_batch")))
            except Exception:
                if on_error != "count":
                    raise
                failed += 1
                continue
            seen, samples = seen + 1, samples + rows[k]
    s = time.time() - began
    return {"results": results, "batches": seen, "failed": failed, "samples": samples, "seconds": s, "throughput": samples / max(s, 1e-9)}
