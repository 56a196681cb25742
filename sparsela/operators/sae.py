"""Sparse autoencoders: forward pass in the JVM or in batches, training from aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions.penalties import TopK
from .dictionary import summed
from .encode import list_column, matrix_of, normalize_atoms


@dataclass
class SparseAutoencoder:
    """relu(W x + b), optionally the k largest, decoded by D' a + c.

    W and D have a feature a row; tied: D is W. kind ``l1`` adds lam mean|a| to the loss, ``topk``
    keeps k features (a number, or a share of them below 1)."""

    n_features: int
    kind: str = "l1"
    lam: float = 0.001
    k: float = 0.1
    tied: bool = False
    weight: float = 1.0
    seed: int = 0
    w: np.ndarray | None = None
    b: np.ndarray | None = None
    d: np.ndarray | None = None
    c: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)

    def init(self, p: int) -> None:
        r = np.random.default_rng(self.seed)
        self.w = 0.1 * r.normal(size=(self.n_features, p))
        self.d = self.w if self.tied else 0.1 * r.normal(size=(self.n_features, p))
        self.b, self.c = np.zeros(self.n_features), np.zeros(p)

    @property
    def kept(self) -> int:
        return int(self.k) if self.k >= 1 else max(1, int(self.k * self.n_features))

    def np_encode(self, x: np.ndarray) -> np.ndarray:
        a = np.maximum(x @ self.w.T + self.b, 0)
        return TopK(k=self.kept).np_prox(a) if self.kind == "topk" else a

    def np_decode(self, a: np.ndarray) -> np.ndarray:
        return a @ self.d + self.c

    def encode(self, df: DataFrame, x: str = "x", out: str = "a") -> DataFrame:
        """Adds the features. Batches in NumPy; ``expression`` gives the same as a column."""
        if self.w is None:
            raise ValueError("not fitted")
        names, p = df.columns, self.w.shape[1]
        at = names.index(x)

        def run(batches):
            for b in batches:
                m = matrix_of(b.column(at))
                if m.shape[1:] != (p,) and len(m) or not np.isfinite(m).all():
                    raise ValueError(f"signals must be finite and of length {p}")
                yield b.append_column(out, list_column(self.np_encode(m.reshape(-1, p))))

        src = df.withColumn(x, A.doubles(x))
        return src.mapInArrow(run, T.StructType([*src.schema, T.StructField(out, T.ArrayType(T.DoubleType()))]))

    def expression(self, x: str = "x"):
        a = F.transform(A.add(A.matvec(A.matrix(self.w), A.doubles(x)), A.vector(self.b)), lambda v: F.greatest(v, F.lit(0.0)))
        return TopK(k=self.kept).prox(a) if self.kind == "topk" else a

    def decode(self, df: DataFrame, a: str = "a", out: str = "x_hat") -> DataFrame:
        return df.withColumn(out, A.add(A.combine(A.matrix(self.d), a), A.vector(self.c)))

    def forward(self, df: DataFrame, x: str = "x") -> DataFrame:
        return self.decode(self.encode(df, x))

    def loss(self, df: DataFrame, x: str = "x") -> dict:
        """reconstruction (mean squared), sparsity (lam mean |a|) and total."""
        f = self.forward(df, x)
        e = A.total(F.zip_with(x, "x_hat", lambda u, v: (u - v) * (u - v)))
        r = f.agg((F.sum(e) / F.sum(F.size(x))).alias("r"), (F.sum(A.norm("a", 1)) / F.sum(F.size("a"))).alias("s")).first()
        s = self.lam * r["s"] if self.kind == "l1" else 0.0
        return {"reconstruction": r["r"], "sparsity": s, "total": r["r"] + self.weight * s}

    def gradients(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Sums over a batch, and the loss, for one step."""
        a = self.np_encode(x)
        e = self.np_decode(a) - x
        ga = 2 * e @ self.d.T / x.shape[1]
        if self.kind == "l1":
            ga = ga + self.weight * self.lam / self.n_features
        ga = ga * (a > 0)
        gd, gw = 2 * a.T @ e / x.shape[1], ga.T @ x
        return {"w": gw, "d": gd, "b": ga.sum(0), "c": 2 * e.sum(0) / x.shape[1], "n": [len(x)], "loss": [(e * e).sum() / x.shape[1] + (self.weight * self.lam * a.sum() / self.n_features if self.kind == "l1" else 0)]}

    def normalize_decoder(self, dead: float = 1e-6) -> None:
        """Unit decoder rows; rows without length are drawn anew."""
        n = np.sqrt((self.d**2).sum(1))
        gone = n < dead
        if gone.any():
            self.d[gone] = np.random.default_rng(self.seed + 1).normal(size=(int(gone.sum()), self.d.shape[1]))
        self.d = normalize_atoms(self.d)
        if self.tied:
            self.w = self.d

    def fit(self, df: DataFrame, x: str = "x", epochs: int = 50, rate: float = 0.01, normalize_every: int = 10, patience: int = 10, tol: float = 1e-6, validation: DataFrame | None = None) -> SparseAutoencoder:
        """Adam on full-data gradients, each one aggregate; early stop on the validation loss (the best
        weights are restored) or on the training loss."""
        if self.w is None:
            self.init(df.select(F.size(x)).first()[0])
        m, v, best, calm, kept = {}, {}, np.inf, 0, None
        for t in range(1, epochs + 1):
            g = summed(df, [x], self.gradients)
            n = g["n"][0, 0]
            now = float(g["loss"][0, 0] / n)
            if self.tied:
                g["w"] = g["w"] + g["d"]
            for k in ("w", "b", "c") if self.tied else ("w", "d", "b", "c"):
                q = g[k].reshape(getattr(self, k).shape) / n
                m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * q, 0.999 * v.get(k, 0) + 0.001 * q * q
                setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
            if self.tied:
                self.d = self.w
            if normalize_every and t % normalize_every == 0:
                self.normalize_decoder()
            seen = self.loss(validation, x)["total"] if validation is not None else now
            self.history.append({"epoch": t, "loss": now, "validation": seen})
            if seen < best - tol:
                best, calm = seen, 0
                kept = tuple(z.copy() for z in (self.w, self.d, self.b, self.c))
            else:
                calm += 1
                if calm >= patience:
                    break
        if validation is not None and kept:
            self.w, self.d, self.b, self.c = kept
        return self

    def to_atoms(self) -> np.ndarray:
        """Decoder rows as a dictionary."""
        return normalize_atoms(self.d)

    @classmethod
    def from_atoms(cls, d: np.ndarray, **kw) -> SparseAutoencoder:
        """A dictionary as tied encoder rows."""
        s = cls(len(d), tied=True, **kw)
        s.init(d.shape[1])
        s.w = s.d = normalize_atoms(d)
        return s


@dataclass
class FeatureExtractor:
    """fit / transform / inverse_transform by ``dict`` (dictionary learning), ``sae`` or ``hybrid`` (an
    autoencoder that starts from a learned dictionary)."""

    method: str = "dict"
    n_features: int = 64
    params: dict = field(default_factory=dict)
    model: object = None

    def fit(self, df: DataFrame, **kw) -> FeatureExtractor:
        from .learn import DictionaryLearner

        if self.method == "dict":
            self.model = DictionaryLearner(self.n_features, **self.params).fit(df, **kw)
        elif self.method == "sae":
            self.model = SparseAutoencoder(self.n_features, **self.params).fit(df, **kw)
        elif self.method == "hybrid":
            d = DictionaryLearner(self.n_features, n_steps=3).fit(df).atoms
            self.model = SparseAutoencoder.from_atoms(d, **self.params).fit(df, **kw)
        else:
            raise ValueError(f"unknown method {self.method!r}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        return self.model.encode(df)

    def inverse_transform(self, codes: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        return self.model.decode(codes)
