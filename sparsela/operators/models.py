"""Models around sparse codes: pyspark.ml estimator, non-linear decoder, classifier, pipelines."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from .dictionary import statistics, summed
from .encode import encode, list_column, matrix_of
from .learn import DictionaryLearner


class SparseCoderEstimator(Estimator):
    """fit learns a dictionary from a vector or array column; the model adds codes to a table."""

    def __init__(self, input_col: str = "x", output_col: str = "a", id_col: str = "sample_id", **learner):
        super().__init__()
        self.input_col, self.output_col, self.id_col, self.learner = input_col, output_col, id_col, learner

    def _fit(self, df: DataFrame) -> SparseCoderModel:
        src = df.select(F.col(self.id_col).alias("sample_id"), as_array(df, self.input_col).alias("x"))
        return SparseCoderModel(DictionaryLearner(**self.learner).fit(src), self.input_col, self.output_col)


class SparseCoderModel(Model):
    def __init__(self, learner: DictionaryLearner, input_col: str, output_col: str):
        super().__init__()
        self.learner, self.input_col, self.output_col = learner, input_col, output_col

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c != "_x"]
        src = df.withColumn("_x", as_array(df, self.input_col))
        l = self.learner  # noqa: E741
        out = encode(src, l._fitted(), l._penalty(l.lam_), l.solver, names[0], "_x", tuple(names[1:]), **l.solver_params)
        return out.withColumnRenamed("a", self.output_col).drop("iterations", "converged", "objective", "reason")

    def inverse_transform(self, df: DataFrame, out: str = "x_hat") -> DataFrame:
        return self.learner.decode(df, a=self.output_col, out=out)

    def feature_names(self) -> list[str]:
        return [f"atom_{k}" for k in range(len(self.learner.atoms))]


def as_array(df: DataFrame, name: str):
    return A.doubles(name) if isinstance(df.schema[name].dataType, T.ArrayType) else vector_to_array(name)


def scaled_coding_pipeline(df: DataFrame, variance: float = 0.95, **learner) -> tuple[PipelineModel, PipelineModel]:
    """Standard scaling and sparse coding, then PCA to the given share of variance, fitted on ``x``."""
    vec = df.withColumn("vec", array_to_vector(A.doubles("x")))
    first = Pipeline(stages=[StandardScaler(inputCol="vec", outputCol="scaled", withMean=True), SparseCoderEstimator("scaled", "a", **learner)]).fit(vec)
    codes = first.transform(vec).withColumn("codes", array_to_vector("a"))
    k = len(first.stages[-1].learner.atoms)
    full = PCA(k=k, inputCol="codes", outputCol="pca").fit(codes)
    keep = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), variance - 1e-12)) + 1
    return first, PipelineModel([PCA(k=min(keep, k), inputCol="codes", outputCol="pca").fit(codes)])


def classifier(codes: DataFrame, label: str = "label", a: str = "a", **params):
    """Logistic regression on codes."""
    src = codes.select(F.col(label).cast("double").alias("label"), array_to_vector(a).alias("features"))
    return LogisticRegression(**params).fit(src)


@dataclass
class NonlinearDecoder:
    """x is decoded as mix relu(a W1 + b1) W2 + b2 plus (1 - mix) times the linear reconstruction.

    Trained by gradient descent on aggregates over all data, with ``hidden`` units (min(256, 2 K))."""

    atoms: np.ndarray
    hidden: int = 0
    mix: float = 0.7
    rate: float = 0.05
    epochs: int = 10
    seed: int = 0
    p: dict = field(default_factory=dict)
    history: list[float] = field(default_factory=list)

    def np_decode(self, a: np.ndarray) -> np.ndarray:
        h = np.maximum(a @ self.p["w1"] + self.p["b1"], 0)
        return self.mix * (h @ self.p["w2"] + self.p["b2"]) + (1 - self.mix) * (a @ self.atoms)

    def fit(self, codes: DataFrame, x: str = "x", a: str = "a") -> NonlinearDecoder:
        k, n = self.atoms.shape
        m = self.hidden or min(256, 2 * k)
        r = np.random.default_rng(self.seed)
        self.p = {"w1": r.normal(0, np.sqrt(2 / k), (k, m)), "b1": np.zeros(m), "w2": r.normal(0, np.sqrt(1 / m), (m, n)), "b2": np.zeros(n)}
        for _ in range(self.epochs):

            def part(xs, cs):
                h = np.maximum(cs @ self.p["w1"] + self.p["b1"], 0)
                e = self.np_decode(cs) - xs
                g = 2 * self.mix * e / n
                gh = (g @ self.p["w2"].T) * (h > 0)
                return {"w1": cs.T @ gh, "b1": gh.sum(0), "w2": h.T @ g, "b2": g.sum(0), "n": [len(xs)], "loss": [(e * e).sum() / n]}

            s = summed(codes, [x, a], part)
            rows = s["n"][0, 0]
            self.history.append(float(s["loss"][0, 0] / rows))
            for q in self.p:
                self.p[q] = self.p[q] - self.rate * s[q].reshape(self.p[q].shape) / rows
        return self

    def decode(self, codes: DataFrame, a: str = "a", out: str = "x_hat") -> DataFrame:
        names = codes.columns
        at = names.index(a)

        def run(batches):
            for b in batches:
                yield b.append_column(out, list_column(self.np_decode(matrix_of(b.column(at)).reshape(b.num_rows, -1))))

        return codes.mapInArrow(run, T.StructType([*codes.schema, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def benchmark(learner: DictionaryLearner, df: DataFrame, repeats: int = 3) -> dict:
    """Mean and deviation of the seconds of fitting and encoding."""
    fit, enc = [], []
    for _ in range(repeats):
        began = time.time()
        learner.reset()
        learner.fit(df)
        fit.append(time.time() - began)
        began = time.time()
        learner.encode(df).write.format("noop").mode("overwrite").save()
        enc.append(time.time() - began)
    return {"fit_mean": float(np.mean(fit)), "fit_std": float(np.std(fit)), "encode_mean": float(np.mean(enc)), "encode_std": float(np.std(enc)), "mse": statistics(learner.encode(df, keep=("x",))).loss(learner.atoms)}
