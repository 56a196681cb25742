"""Dictionary updates from aggregates over the data.

The data enter through sums over signals (A'A, A'X, n and the like), made per partition in NumPy
and added up by Spark; only K x (K + p) numbers reach the driver, whatever the number of signals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .encode import BATCH_ROWS, matrix_of, normalize_atoms


#: Partial sums that meet on the driver; those of more partitions are added in as many tasks first.
WIDTH = 16


def _packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([list(v.shape) for v in sums.values()], pa.list_(pa.int64())), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["name", "shape", "v"])


def _add(got: dict[str, np.ndarray], name: str, v: np.ndarray) -> None:
    got[name] = got[name] + v if name in got else v


def _unpack(got: dict[str, np.ndarray], names, shapes, blobs) -> dict[str, np.ndarray]:
    for k, shape, v in zip(names, shapes, blobs):
        _add(got, k, np.frombuffer(v).reshape(shape))
    return got


def summed(df: DataFrame, columns: list[str], part) -> dict[str, np.ndarray]:
    """Sums over all batches of the arrays that ``part(*matrices)`` gives by name.

    A partition gives one packed array for each name. They are added in ``WIDTH`` tasks, one array at a
    time, so the driver gets WIDTH arrays of each name whatever the number of partitions."""

    def run(batches):
        got: dict[str, np.ndarray] = {}
        for b in batches:
            for i in range(0, b.num_rows, BATCH_ROWS):
                for k, v in part(*(matrix_of(c) for c in b.slice(i, BATCH_ROWS).columns)).items():
                    _add(got, k, np.atleast_2d(np.asarray(v, float)))
        if got:
            yield _packed(got)

    def add(batches):
        got: dict[str, np.ndarray] = {}
        for b in batches:
            _unpack(got, *(b.column(k).to_pylist() for k in range(3)))
        if got:
            yield _packed(got)

    schema = "name string, shape array<long>, v binary"
    parts = df.select(*(A.doubles(c) for c in columns)).mapInArrow(run, schema)
    known = df._jdf.queryExecution().executedPlan().outputPartitioning().numPartitions()  # 0: not known
    t = (parts if 0 < known <= WIDTH else parts.repartition(WIDTH).mapInArrow(add, schema)).toArrow()
    return _unpack({}, *(t[c].to_pylist() for c in ("name", "shape", "v")))


@dataclass
class Stats:
    """Sums over signals: codes' Gram matrix (K x K), codes times signals (K x p), and scalars."""

    gram: np.ndarray
    cross: np.ndarray
    n: float
    energy: float
    usage: np.ndarray
    active: np.ndarray
    penalty: float = 0.0

    def loss(self, d: np.ndarray) -> float:
        """Sum of squared residuals for a dictionary and these codes."""
        return float(self.energy - 2 * (self.cross * d).sum() + ((self.gram @ d) * d).sum())


def statistics(df: DataFrame, x: str = "x", a: str | None = "a", threshold: float = 1e-6, penalty=None, solve=None) -> Stats:
    """All sums in one job; ``penalty`` adds the sum of its values. With ``solve(signals)``, which gives
    the codes, there is no column of codes: they are made and summed in one step and never leave the worker."""

    def part(xs, cs=None):
        cs = solve(xs) if cs is None else cs
        return {"penalty": [penalty.np_value(cs).sum() if penalty else 0.0], "gram": cs.T @ cs, "cross": cs.T @ xs, "n": [len(xs)], "energy": [(xs * xs).sum()], "usage": (cs * cs).sum(0), "active": (np.abs(cs) > threshold).sum(0)}

    s = summed(df, [x] if solve else [x, a], part)
    return Stats(s["gram"], s["cross"], float(s["n"][0, 0]), float(s["energy"][0, 0]), s["usage"][0], s["active"][0], float(s["penalty"][0, 0]))


def mod(stats: Stats, ridge: float = 1e-6, max_condition: float = 1e12) -> np.ndarray:
    """Optimal directions: (A'A + ridge I)^-1 A'X, normalised; pseudo-inverse if badly conditioned."""
    g = stats.gram + ridge * np.eye(len(stats.gram))
    d = np.linalg.pinv(g) @ stats.cross if np.linalg.cond(g) > max_condition else np.linalg.solve(g, stats.cross)
    return normalize_atoms(d)


def gradient(stats: Stats, d: np.ndarray) -> np.ndarray:
    """Descent direction of half the squared residuals: A'(X - A D)."""
    return stats.cross - stats.gram @ d


@dataclass
class GradientUpdate:
    """Gradient step by ``basic``, ``momentum``, ``adagrad`` or ``adam``; the loss goes down.

    normalisation: ``l2`` (unit atoms), ``soft`` (at most unit), ``spherical`` (step along the
    sphere) or ``none``. mean divides by the number of signals."""

    rate: float = 0.1
    optimizer: str = "basic"
    momentum: float = 0.9
    normalisation: str = "l2"
    mean: bool = True
    state: dict = field(default_factory=dict)

    def step(self, stats: Stats, d: np.ndarray) -> np.ndarray:
        g = gradient(stats, d) / (max(stats.n, 1) if self.mean else 1)
        s = self.state
        s["t"] = s.get("t", 0) + 1
        if self.normalisation == "spherical":
            g = g - (g * d).sum(1, keepdims=True) * d
        if self.optimizer == "momentum":
            s["m"] = self.momentum * s.get("m", 0) + (1 - self.momentum) * g
            g = s["m"]
        elif self.optimizer == "adagrad":
            s["v"] = s.get("v", 0) + g * g
            g = g / (np.sqrt(s["v"]) + 1e-8)
        elif self.optimizer == "adam":
            s["m"], s["v"] = 0.9 * s.get("m", 0) + 0.1 * g, 0.999 * s.get("v", 0) + 0.001 * g * g
            g = (s["m"] / (1 - 0.9 ** s["t"])) / (np.sqrt(s["v"] / (1 - 0.999 ** s["t"])) + 1e-8)
        elif self.optimizer != "basic":
            raise ValueError(f"unknown optimizer {self.optimizer!r}")
        new = d + self.rate * g
        if self.normalisation in ("l2", "spherical"):
            return normalize_atoms(new)
        if self.normalisation == "soft":
            return new / np.maximum(1, np.sqrt((new * new).sum(1, keepdims=True)))
        return new


def block_coordinate(stats: Stats, d: np.ndarray, passes: int = 1) -> np.ndarray:
    """Each atom in turn to its best value for the others, then normalised."""
    d = d.copy()
    for _ in range(passes):
        for k in range(len(d)):
            h = stats.gram[k, k]
            if h > 1e-12:
                d[k] += (stats.cross[k] - stats.gram[k] @ d) / h
                d[k] /= np.sqrt((d[k] ** 2).sum()) + A.EPS
    return d


def ksvd(df: DataFrame, d: np.ndarray, x: str = "x", a: str = "a", approximate: bool = False) -> tuple[np.ndarray, DataFrame]:
    """One sweep of K-SVD: the dictionary and the data with updated codes.

    Atom by atom, one aggregate each: the p x p Gram matrix of the residuals restricted to the
    signals that use the atom gives its leading singular vector (``approximate``: one power step,
    a sum of p numbers). The updates made so far are replayed in the workers, so nothing is
    written between atoms; K aggregates a sweep mean small dictionaries. An atom without signals
    stays as it is.
    """
    start, d = d.copy(), d.copy()

    def replay(xs, cs, upto, atoms):
        cs, r = cs.copy(), xs - cs @ start
        for k in range(upto):
            use = np.abs(cs[:, k]) > 1e-12
            e = r[use] + cs[use, k : k + 1] * start[k]
            cs[use, k] = e @ atoms[k]
            r[use] = e - cs[use, k : k + 1] * atoms[k]
        return cs, r

    for k in range(len(d)):

        def part(xs, cs, k=k, atoms=d.copy()):
            cs, r = replay(xs, cs, k, atoms)
            use = np.abs(cs[:, k]) > 1e-12
            e = r[use] + cs[use, k : k + 1] * start[k]
            return {"m": cs[use, k] @ e if approximate else e.T @ e, "n": [use.sum()]}

        s = summed(df, [x, a], part)
        if s["n"][0, 0] > 0:
            if approximate:
                v = s["m"][0]
            else:
                w, vec = np.linalg.eigh(s["m"])
                v = vec[:, -1]
                v = v * np.sign(v @ start[k] or 1.0)
            if np.linalg.norm(v) > 1e-12:
                d[k] = v / np.linalg.norm(v)
    final = d.copy()
    names = df.columns
    ix, ia = names.index(x), names.index(a)

    def run(batches):
        from .encode import list_column

        for b in batches:
            cs, _ = replay(matrix_of(b.column(ix)), matrix_of(b.column(ia)), len(final), final)
            yield b.set_column(ia, a, list_column(cs))

    src = df.withColumns({x: A.doubles(x), a: A.doubles(a)})
    return d, src.mapInArrow(run, src.schema)


@dataclass
class OnlineUpdate:
    """Running averages of A'A and A'X, then a block-coordinate pass or a solve.

    schedule of the weight of new data: ``robbins_monro`` (t^-0.7), ``constant`` (rate),
    ``adaptive`` (rate / (1 + 0.01 t)), ``cyclic`` (cosine between rate and rate / 10) or
    ``average`` (share of the signals so far). solver: ``block``, ``direct``, ``svd`` or
    ``iterative`` (conjugate gradients)."""

    schedule: str = "average"
    rate: float = 0.1
    solver: str = "block"
    ridge: float = 1e-6
    t: int = 0
    n: float = 0.0
    gram: np.ndarray | None = None
    cross: np.ndarray | None = None

    def weight(self, n: float) -> float:
        t = self.t + 1
        return {
            "robbins_monro": t**-0.7,
            "constant": self.rate,
            "adaptive": self.rate / (1 + 0.01 * t),
            "cyclic": self.rate * (0.55 + 0.45 * np.cos(2 * np.pi * t / 20)),
            "average": n / max(self.n + n, 1),
        }[self.schedule]

    def step(self, stats: Stats, d: np.ndarray) -> np.ndarray:
        n = max(stats.n, 1)
        w = 1.0 if self.gram is None else self.weight(n)
        old = (0, 0) if self.gram is None else (self.gram, self.cross)
        self.gram, self.cross = (1 - w) * old[0] + w * stats.gram / n, (1 - w) * old[1] + w * stats.cross / n
        self.t, self.n = self.t + 1, self.n + n
        mean = Stats(self.gram, self.cross, 1, 0, np.diag(self.gram), np.diag(self.gram))
        if self.solver == "block":
            return block_coordinate(mean, d)
        g = self.gram + self.ridge * np.eye(len(self.gram))
        if self.solver == "direct":
            new = np.linalg.solve(g, self.cross)
        elif self.solver == "svd":
            new = np.linalg.pinv(g) @ self.cross
        elif self.solver == "iterative":
            new, r = d.copy(), self.cross - g @ d
            p, rr = r.copy(), (r * r).sum()
            for _ in range(100):
                if rr < 1e-18:
                    break
                q = g @ p
                s = rr / (p * q).sum()
                new, r = new + s * p, r - s * q
                p, rr = r + (r * r).sum() / rr * p, (r * r).sum()
        else:
            raise ValueError(f"unknown solver {self.solver!r}")
        return normalize_atoms(new)


def homeostatic_gain(stats: Stats, alpha: float = 0.1) -> np.ndarray:
    """Gain of each atom towards equal usage: (mean usage / usage)^alpha, usage the root mean square code."""
    u = np.sqrt(stats.usage / max(stats.n, 1) + 1e-12)
    return (u.mean() / u) ** alpha


def dead_atoms(stats: Stats, share: float = 1e-3) -> np.ndarray:
    """Atoms active in fewer than this share of the signals."""
    return np.flatnonzero(stats.active / max(stats.n, 1) < share)


def replace_dead(df: DataFrame, d: np.ndarray, dead: np.ndarray, x: str = "x", id_col: str = "sample_id", seed: int = 0) -> np.ndarray:
    """Dead atoms become signals, picked by the hash of their id, centred and normalised."""
    if not len(dead):
        return d
    d = d.copy()
    rows = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(len(dead)).select(A.doubles(x)).collect()
    for k, r in zip(dead, rows):
        v = np.array(r[0]) - np.mean(r[0])
        if np.linalg.norm(v) > 1e-12:
            d[k] = v / np.linalg.norm(v)
    return d


def adapt_size(d: np.ndarray, shares: list[np.ndarray], seed: int = 0, low: float = 0.01, high: float = 0.05, grow: int = 5) -> np.ndarray:
    """Drop up to half of the underused atoms where over 30 % are (mean of the last five usages), or
    add ``grow`` random atoms where all are well used."""
    if len(shares) < 5:
        return d
    use = np.mean(shares[-5:], axis=0)
    weak = np.flatnonzero(use < low)
    if len(weak) > 0.3 * len(d):
        drop = weak[np.argsort(use[weak], kind="stable")][: len(weak) // 2]
        return np.delete(d, drop, axis=0)
    if (use > high).all():
        return np.vstack([d, normalize_atoms(np.random.default_rng(seed).normal(size=(grow, d.shape[1])))])
    return d


UPDATES = {"mod": lambda s, d: mod(s), "gradient": lambda s, d: GradientUpdate().step(s, d), "block_coordinate": block_coordinate}


def recommend_update(scenario: str) -> str:
    """Update for a scenario: batch, online, fast or stable."""
    return {"batch": "ksvd", "online": "online", "fast": "mod", "stable": "block_coordinate"}[scenario]
