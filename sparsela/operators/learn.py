"""Dictionary learning: loops on the driver over distributed encodes and aggregates."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.penalties import L1, Penalty, create_penalty
from ..session import checkpoint_dir
from . import dictionary as D
from .encode import coder, decode, encode, heuristic_lambda, normalize_atoms


def initial_atoms(df: DataFrame, n_atoms: int, seed: int = 0, x: str = "x", id_col: str = "sample_id", how: str = "samples") -> np.ndarray:
    """Start: centred, normalised signals picked by hash (random atoms where there are too few), or
    ``random`` / ``orthogonal`` atoms."""
    rng = np.random.default_rng(seed)
    if how == "samples":
        rows = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n_atoms).select(A.doubles(x)).collect()
        d = np.array([r[0] for r in rows], float)
        d = np.vstack([d, rng.normal(size=(n_atoms - len(d), d.shape[1]))]) + 1e-6 * rng.normal(size=(n_atoms, d.shape[1]))
        return normalize_atoms(d - d.mean(1, keepdims=True))
    p = df.select(F.size(x)).first()[0]
    d = rng.normal(size=(n_atoms, p))
    if how == "orthogonal":
        q = np.linalg.qr(d.T if n_atoms <= p else d)[0]
        d = q.T if n_atoms <= p else q
    return normalize_atoms(d)


@dataclass
class DictionaryLearner:
    """Alternates encoding and a dictionary update, and keeps the dictionary it learns.

    update: ``mod``, ``gradient``, ``block_coordinate``, ``ksvd`` or ``online``. lam: a number or
    ``auto`` (share of the standard deviation). anneal: (factor, floor) of lam after each step.
    stop: ``objective``, ``dictionary``, ``both`` or ``none``, with ``patience`` for the objective.
    """

    n_atoms: int = 64
    penalty: str | Penalty = "l1"
    lam: float | str = 0.1
    solver: str = "auto"
    update: str = "mod"
    n_steps: int = 10
    tol: float = 1e-4
    stop: str = "objective"
    patience: int = 1
    anneal: tuple[float, float] | None = None
    replace_dead: bool = True
    adaptive: bool = False
    init: str = "samples"
    seed: int = 0
    rate: float = 0.1
    solver_params: dict = field(default_factory=dict)
    penalty_params: dict = field(default_factory=dict)
    atoms: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        if not 1 <= self.n_atoms <= 10_000:
            raise ValueError("n_atoms must be 1 to 10000")
        if self.n_steps < 1 or not 0 < self.tol < 1:
            raise ValueError("n_steps must be positive and tol in (0, 1)")
        if self.anneal and not (0 < self.anneal[0] < 1 and 0 <= self.anneal[1] < 1):
            raise ValueError("anneal is a factor in (0, 1) and a floor in [0, 1)")
        if self.update not in (*D.UPDATES, "ksvd", "online"):
            raise ValueError(f"unknown update {self.update!r}")

    def _penalty(self, lam: float) -> Penalty:
        if isinstance(self.penalty, Penalty):
            return self.penalty
        return create_penalty(self.penalty, lam=lam, **self.penalty_params)

    def fit(self, df: DataFrame, id_col: str = "sample_id", x: str = "x") -> DictionaryLearner:
        lam = heuristic_lambda(df, x=x) if self.lam == "auto" else float(self.lam)
        d = initial_atoms(df, self.n_atoms, self.seed, x, id_col, self.init) if self.atoms is None else self.atoms
        self.history, shares, calm = [], [], 0
        grad, online = D.GradientUpdate(rate=self.rate), D.OnlineUpdate()
        for step in range(self.n_steps):
            began = time.time()
            pen = self._penalty(lam)
            if self.update == "ksvd":  # a sweep reads the codes once for each atom
                codes = encode(df, d, pen, self.solver, id_col, x, keep=(x,), **self.solver_params).persist()
                s = D.statistics(codes, x, penalty=pen)
                new, _ = D.ksvd(codes, d, x)
                codes.unpersist()
            else:
                s = D.statistics(df, x, penalty=pen, solve=coder(d, pen, self.solver, **self.solver_params))
            obj = 0.5 * s.loss(d) + s.penalty
            if self.update == "ksvd":
                pass
            elif self.update == "gradient":
                new = grad.step(s, d)
            elif self.update == "online":
                new = online.step(s, d)
            else:
                new = D.UPDATES[self.update](s, d)
            shares.append(s.active / max(s.n, 1))
            dead = D.dead_atoms(s)
            if self.replace_dead:
                new = D.replace_dead(df, new, dead, x, id_col, self.seed + step + 1)
            change = float(np.linalg.norm(new - d))
            entry = {"step": step, "lam": lam, "mse": s.loss(d) / (s.n * d.shape[1]), "active_share": float(s.active.sum() / (s.n * len(d))), "dictionary_change": change, "dead_atoms": len(dead), "gradient_norm": float(np.linalg.norm(D.gradient(s, d))), "objective": obj, "seconds": time.time() - began}
            self.history.append(entry)
            if self.adaptive:
                sized = D.adapt_size(new, [v for v in shares if len(v) == len(new)], self.seed + step)
                shares = shares if len(sized) == len(new) else []
                new = sized
            d = new
            if self.anneal:
                lam = max(self.anneal[1], lam * self.anneal[0])
            if self._converged(change, d):
                calm += 1
                if calm >= self.patience:
                    break
            else:
                calm = 0
        self.atoms, self.lam_ = d, lam
        return self

    def _converged(self, change, d) -> bool:
        h = self.history
        still = change <= self.tol * np.sqrt(len(d))
        flat = len(h) > 1 and h[-1]["objective"] is not None and abs(h[-2]["objective"] - h[-1]["objective"]) <= self.tol * max(abs(h[-2]["objective"]), 1e-12)
        return {"objective": flat, "dictionary": still, "both": flat and still, "none": False}[self.stop]

    def _fitted(self) -> np.ndarray:
        if self.atoms is None:
            raise ValueError("not fitted")
        return self.atoms

    def encode(self, df: DataFrame, **kw) -> DataFrame:
        return encode(df, self._fitted(), self._penalty(getattr(self, "lam_", 0.1)), self.solver, **{**self.solver_params, **kw})

    def decode(self, codes: DataFrame, **kw) -> DataFrame:
        return decode(codes, self._fitted(), **kw)

    def score(self, df: DataFrame, x: str = "x") -> float:
        """Minus the mean squared reconstruction error."""
        s = D.statistics(df, x, solve=coder(self._fitted(), self._penalty(getattr(self, "lam_", 0.1)), self.solver, **self.solver_params))
        return -s.loss(self._fitted()) / (s.n * self._fitted().shape[1])

    def reset(self) -> None:
        self.atoms, self.history = None, []

    def history_table(self, spark) -> DataFrame:
        """(step, metric, value)."""
        rows = [(h["step"], k, float(v)) for h in self.history for k, v in h.items() if k != "step" and v is not None]
        return spark.createDataFrame(rows, "step int, metric string, value double")

    def convergence(self) -> dict:
        first, last = self.history[0], self.history[-1]
        return {"steps": len(self.history), "converged": len(self.history) < self.n_steps, "first_mse": first["mse"], "last_mse": last["mse"]}


@dataclass
class OnlineDictionaryLearner:
    """Mini-batch learner; each batch is encoded once and changes the running averages.

    After ``warm_up`` batches the rate decays to ``min_rate``; the rate of an atom used less than half
    as often as the target grows by 1.2, used more than twice as often falls by 0.8."""

    n_atoms: int = 64
    penalty: Penalty = field(default_factory=lambda: L1(0.1))
    update: str = "online"
    schedule: str = "average"
    rate: float = 0.1
    decay: float = 0.99
    min_rate: float = 1e-4
    warm_up: int = 10
    target_usage: float = 0.1
    smoothing: float = 0.9
    n_passes: int = 1
    batch_size: int = 100
    seed: int = 0
    atoms: np.ndarray | None = None
    stats: dict = field(default_factory=dict)

    def __post_init__(self):
        self._online = D.OnlineUpdate(self.schedule, self.rate)
        self._momentum = 0
        self._rates = None

    def partial_fit(self, df: DataFrame, id_col: str = "sample_id", x: str = "x") -> OnlineDictionaryLearner:
        if self.atoms is None:
            self.atoms = initial_atoms(df, self.n_atoms, self.seed, x, id_col)
        s = D.statistics(df, x, solve=coder(self.atoms, self.penalty))
        st, f = self.stats, self.smoothing
        share = s.active / max(s.n, 1)
        now = {"mse": s.loss(self.atoms) / (s.n * self.atoms.shape[1]), "active_share": float(share.mean())}
        st["batches"], st["samples"] = st.get("batches", 0) + 1, st.get("samples", 0) + int(s.n)
        for k, v in now.items():
            st[k] = f * st[k] + (1 - f) * v if k in st else v
        st["usage"] = f * st["usage"] + (1 - f) * share if "usage" in st else share
        if self.update == "online":
            self.atoms = self._online.step(s, self.atoms)
        else:
            if self._rates is None:
                self._rates = np.full(len(self.atoms), self.rate)
            self._momentum = 0.9 * self._momentum + 0.1 * D.gradient(s, self.atoms) / max(s.n, 1)
            self.atoms = normalize_atoms(self.atoms + self._rates[:, None] * self._momentum)
            if st["batches"] > self.warm_up:
                r = np.maximum(self.min_rate, self._rates * self.decay)
                r = np.where(st["usage"] < self.target_usage / 2, r * 1.2, np.where(st["usage"] > 2 * self.target_usage, r * 0.8, r))
                self._rates = np.clip(r, self.min_rate, 10 * self.rate)
        self.atoms = D.replace_dead(df, self.atoms, np.flatnonzero(st["usage"] < 1e-6), x, id_col, self.seed + st["batches"])
        return self

    def fit(self, df: DataFrame, id_col: str = "sample_id", x: str = "x") -> OnlineDictionaryLearner:
        """Passes over mini-batches, dealt by hash: batch sizes are ``batch_size`` on average. A pass
        writes its signals once, a folder for each batch, so that a batch reads its own rows alone."""
        spark, n = df.sparkSession, max(1, round(df.count() / self.batch_size))
        for p in range(self.n_passes):
            dealt = df.select(id_col, x).withColumn("_batch", F.pmod(F.xxhash64(F.lit(self.seed + p), id_col), F.lit(n)).cast("int"))
            path = f"{checkpoint_dir(spark)}/sparsela-{uuid.uuid4().hex}"
            dealt.repartition("_batch").write.partitionBy("_batch").parquet(path)
            table = spark.read.schema(dealt.schema).parquet(path)
            for k in range(n):
                batch = table.where(F.col("_batch") == k)
                if not batch.isEmpty():
                    self.partial_fit(batch, id_col, x)
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return self

    def encode(self, df: DataFrame, **kw) -> DataFrame:
        if self.atoms is None:
            raise ValueError("not fitted")
        return encode(df, self.atoms, self.penalty, **kw)

    def decode(self, codes: DataFrame, **kw) -> DataFrame:
        if self.atoms is None:
            raise ValueError("not fitted")
        return decode(codes, self.atoms, **kw)

    def get_stats(self) -> dict:
        u = self.stats.get("usage", np.zeros(0))
        return {k: v for k, v in self.stats.items() if k != "usage"} | {"usage_mean": float(u.mean()) if len(u) else 0.0, "usage_std": float(u.std()) if len(u) else 0.0, "dead": int((u < 1e-6).sum())}

    def reset(self) -> None:
        self.atoms, self.stats = None, {}
        self.__post_init__()


LEARNERS = {
    "standard": DictionaryLearner,
    "composite": DictionaryLearner,
    "mod": lambda **kw: DictionaryLearner(**{"update": "mod", "solver": "fista", **kw}),
    "ksvd": lambda **kw: DictionaryLearner(**{"update": "ksvd", "solver": "omp", "solver_params": {"n_atoms": 10}, "n_steps": 100, **kw}),
    "olshausen": lambda **kw: DictionaryLearner(**{"penalty": "cauchy", "solver": "gradient", "update": "gradient", **kw}),
    "online": OnlineDictionaryLearner,
}


def create_learner(name: str, **params):
    if name not in LEARNERS:
        raise ValueError(f"unknown learner {name!r}; there are {', '.join(sorted(LEARNERS))}")
    return LEARNERS[name](**params)
