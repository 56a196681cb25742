"""Penalties with value, proximal operator and gradient.

Each element-wise rule is written once over a small set of operations, for Spark columns
(``value``, ``prox``, ``grad``: arguments are array columns) and for NumPy arrays of one signal a
row (``np_value``, ``np_prox``, ``np_grad``), which the batch kernels use. A penalty acts on every
signal by itself, so results don't depend on how signals are dealt out.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import col, total


class _Columns:
    """Element-wise operations on Spark columns."""

    abs, sign, log1p, exp, sqrt = F.abs, F.signum, F.log1p, F.exp, F.sqrt

    @staticmethod
    def where(c, a, b):
        return F.when(c, a).otherwise(b)

    @staticmethod
    def positive(v):
        return F.greatest(v, F.lit(0.0))

    @staticmethod
    def iterate(n, start, step):
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda v, _: step(v))


class _Numpy:
    """The same on NumPy arrays."""

    abs, sign, log1p, exp, sqrt, where = np.abs, np.sign, np.log1p, np.exp, np.sqrt, np.where

    @staticmethod
    def positive(v):
        return np.maximum(v, 0.0)

    @staticmethod
    def iterate(n, start, step):
        return reduce(lambda v, _: step(v), range(n), start)


def shrink(b, v, t):
    return b.sign(v) * b.positive(b.abs(v) - t)


@dataclass
class Penalty:
    """Base: element-wise penalties give ``value_of``, ``prox_of`` and ``grad_of``."""

    lam: float = 0.1
    prox_friendly = True
    differentiable = False

    def __post_init__(self):
        if not self.lam >= 0:
            raise ValueError("lam must not be negative")

    def value_of(self, b, v):
        raise NotImplementedError

    def prox_of(self, b, z, t):
        raise NotImplementedError

    def grad_of(self, b, v):
        raise NotImplementedError(f"{type(self).__name__} has no gradient")

    def value(self, a) -> Column:
        return total(F.transform(col(a), lambda v: self.value_of(_Columns, v)))

    def prox(self, z, t: float) -> Column:
        return F.transform(col(z), lambda v: self.prox_of(_Columns, v, t))

    def grad(self, a) -> Column:
        return F.transform(col(a), lambda v: self.grad_of(_Columns, v))

    def np_value(self, a: np.ndarray) -> np.ndarray:
        return self.value_of(_Numpy, a).sum(-1)

    def np_prox(self, z: np.ndarray, t) -> np.ndarray:
        return self.prox_of(_Numpy, z, t)

    def np_grad(self, a: np.ndarray) -> np.ndarray:
        return self.grad_of(_Numpy, a)


@dataclass
class L1(Penalty):
    """lam |a|; clipping: none, non_negative, or symmetric (to the largest |z| of the signal)."""

    clipping: str = "none"

    def value_of(self, b, v):
        return self.lam * b.abs(v)

    def prox_of(self, b, z, t):
        s = shrink(b, z, t * self.lam)
        return b.positive(s) if self.clipping == "non_negative" else s

    def prox(self, z, t):
        p = super().prox(z, t)
        if self.clipping != "symmetric":
            return p
        top = F.array_max(F.transform(col(z), F.abs))
        return F.transform(p, lambda v: F.least(F.greatest(v, -top), top))

    def grad_of(self, b, v):
        return b.where(b.abs(v) < 1e-15, 0.0, self.lam * b.sign(v))


@dataclass
class NonNegativeL1(L1):
    """lam times the sum for vectors without a negative element, infinite otherwise."""

    clipping: str = "non_negative"

    def prox_of(self, b, z, t):
        return b.positive(z - t * self.lam)

    def value_of(self, b, v):
        return b.where(v < 0, float("inf"), self.lam * v)


@dataclass
class L2(Penalty):
    """lam / 2 a^2."""

    differentiable = True

    def value_of(self, b, v):
        return 0.5 * self.lam * v * v

    def prox_of(self, b, z, t):
        return z / (1 + t * self.lam)

    def grad_of(self, b, v):
        return self.lam * v


@dataclass
class ElasticNet(Penalty):
    """lam (ratio |a| + (1 - ratio) / 2 a^2)."""

    l1_ratio: float = 0.5

    def value_of(self, b, v):
        return self.lam * self.l1_ratio * b.abs(v) + 0.5 * self.lam * (1 - self.l1_ratio) * v * v

    def prox_of(self, b, z, t):
        return shrink(b, z, t * self.lam * self.l1_ratio) / (1 + t * self.lam * (1 - self.l1_ratio))

    def grad_of(self, b, v):
        return b.where(b.abs(v) < 1e-15, 0.0, self.lam * self.l1_ratio * b.sign(v)) + self.lam * (1 - self.l1_ratio) * v


@dataclass
class Cauchy(Penalty):
    """lam log(1 + (a / sigma)^2); prox by Newton steps, with a damped denominator."""

    sigma: float = 1.0
    steps: int = 10
    differentiable = True

    def value_of(self, b, v):
        return self.lam * b.log1p((v / self.sigma) * (v / self.sigma))

    def grad_of(self, b, v):
        return 2 * self.lam * (v / self.sigma**2) / (1 + (v / self.sigma) * (v / self.sigma))

    def hessian_of(self, b, v):
        s = (v / self.sigma) * (v / self.sigma)
        return self.lam * (2 / self.sigma**2) * (1 - s) / ((1 + s) * (1 + s))

    def hessian(self, a) -> Column:
        return F.transform(col(a), lambda v: self.hessian_of(_Columns, v))

    def prox_of(self, b, z, t):
        def step(v):
            h = 1 + t * self.hessian_of(b, v)
            return v - (v - z + t * self.grad_of(b, v)) / b.where(b.abs(h) < 1e-8, 1e-8, h)

        return b.iterate(self.steps, z, step)


@dataclass
class LogSum(Penalty):
    """lam log(1 + |a| / epsilon); prox by re-weighted soft thresholds."""

    epsilon: float = 0.01
    steps: int = 20

    def value_of(self, b, v):
        return self.lam * b.log1p(b.abs(v) / self.epsilon)

    def grad_of(self, b, v):
        return self.lam * b.sign(v) / (self.epsilon + b.abs(v))

    def prox_of(self, b, z, t):
        return b.iterate(self.steps, z, lambda v: shrink(b, z, t * self.lam / (self.epsilon + b.abs(v))))


@dataclass
class SCAD(Penalty):
    """Smoothly clipped absolute deviation with parameter a > 2."""

    a: float = 3.7

    def value_of(self, b, v):
        m, lam, a = b.abs(v), self.lam, self.a
        middle = -(m * m - 2 * a * lam * m + lam * lam) / (2 * (a - 1))
        return b.where(m <= lam, lam * m, b.where(m <= a * lam, middle, (a + 1) * lam * lam / 2 + 0 * m))

    def prox_of(self, b, z, t):
        m, lam, a = b.abs(z), self.lam, self.a
        middle = shrink(b, z, t * a * lam / (a - 1)) * ((a - 1) / (a - 1 - t))
        return b.where(m <= lam * (1 + t), shrink(b, z, t * lam), b.where(m <= a * lam, middle, z))

    def grad_of(self, b, v):
        m, lam, a = b.abs(v), self.lam, self.a
        return b.where(m <= lam, lam * b.sign(v), b.where(m <= a * lam, b.sign(v) * (a * lam - m) / (a - 1), 0 * v))


@dataclass
class Welsch(Penalty):
    """lam (1 - exp(-(a / sigma)^2)), also called student_t; prox by Newton steps."""

    sigma: float = 1.0
    steps: int = 20
    differentiable = True

    def __post_init__(self):
        if not (self.lam > 0 and self.sigma > 0):
            raise ValueError("lam and sigma must be positive")

    def value_of(self, b, v):
        return self.lam * (1 - b.exp(-(v / self.sigma) * (v / self.sigma)))

    def grad_of(self, b, v):
        return (2 * self.lam / self.sigma**2) * v * b.exp(-(v / self.sigma) * (v / self.sigma))

    def prox_of(self, b, z, t):
        def step(v):
            s = (v / self.sigma) * (v / self.sigma)
            h = 1 + t * (2 * self.lam / self.sigma**2) * b.exp(-s) * (1 - 2 * s)
            return v - (v - z + t * self.grad_of(b, v)) / b.where(b.abs(h) < 1e-8, 1e-8, h)

        return b.iterate(self.steps, z, step)


@dataclass
class Huber(Penalty):
    """lam times a^2 / 2 up to delta, linear beyond; prox is the exact one of this value."""

    lam: float = 1.0
    delta: float = 1.0
    differentiable = True

    def value_of(self, b, v):
        m = b.abs(v)
        return self.lam * b.where(m <= self.delta, 0.5 * v * v, self.delta * (m - 0.5 * self.delta))

    def prox_of(self, b, z, t):
        s = t * self.lam
        return b.where(b.abs(z) <= self.delta * (1 + s), z / (1 + s), z - s * self.delta * b.sign(z))

    def grad_of(self, b, v):
        return self.lam * b.where(b.abs(v) <= self.delta, v, self.delta * b.sign(v))


@dataclass
class TopK(Penalty):
    """Constraint to k elements that are not zero; of equal magnitudes the first ones stay."""

    k: int = 5
    prox_friendly = True

    def _kept(self, z):
        z = col(z)
        ranked = F.array_sort(F.transform(z, lambda v, i: F.struct((-F.abs(v)).alias("m"), i.alias("i"))))
        return F.transform(F.slice(ranked, 1, self.k), lambda r: r["i"]) if self.k > 0 else F.expr("cast(array() as array<int>)")

    def value(self, a) -> Column:
        return F.when(F.size(F.filter(col(a), lambda v: F.abs(v) > 1e-15)) <= self.k, 0.0).otherwise(float("inf"))

    def prox(self, z, t: float = 1.0) -> Column:
        kept = self._kept(z)
        return F.transform(col(z), lambda v, i: F.when(F.array_contains(kept, i), v).otherwise(0.0))

    def grad(self, a) -> Column:
        """0 on the kept elements; a steep slope towards zero elsewhere."""
        kept, top = self._kept(a), F.array_max(F.transform(col(a), F.abs))
        slope = F.greatest(F.lit(1e3), 100 * top) if self.k > 0 else F.lit(1e10)
        return F.transform(col(a), lambda v, i: F.when(F.array_contains(kept, i), 0.0).otherwise(F.signum(v) * slope))

    def np_value(self, a):
        return np.where((np.abs(a) > 1e-15).sum(-1) <= self.k, 0.0, np.inf)

    def np_prox(self, z, t=1.0):
        if self.k >= z.shape[-1]:
            return z.copy()
        keep = np.argsort(-np.abs(z), axis=-1, kind="stable")[..., : self.k]
        out = np.zeros_like(z)
        np.put_along_axis(out, keep, np.take_along_axis(z, keep, -1), -1)
        return out


@dataclass
class GroupLasso(Penalty):
    """lam sum of w_g ||a_g||; without groups the L1 penalty. Elements of no group become 0 in prox."""

    groups: list[list[int]] = field(default_factory=list)
    weights: list[float] | None = None

    def _w(self):
        return self.weights or [1.0] * len(self.groups)

    def _norms(self, a):
        return [F.sqrt(reduce(operator.add, (F.get(col(a), i) * F.get(col(a), i) for i in g))) for g in self.groups]

    def _by_element(self, a, f) -> Column:
        """f(w_g, norm of a's group) times a, element by element."""
        where = {i: k for k, g in enumerate(self.groups) for i in g}
        factor = [f(w, n) for w, n in zip(self._w(), self._norms(a))]
        size = 1 + max(where)
        each = F.array(*(factor[where[i]] if i in where else F.lit(0.0) for i in range(size)))
        return F.zip_with(col(a), each, lambda v, s: v * F.coalesce(s, F.lit(0.0)))

    def value(self, a):
        if not self.groups:
            return L1(self.lam).value(a)
        return self.lam * reduce(operator.add, (w * n for w, n in zip(self._w(), self._norms(a))))

    def prox(self, z, t):
        if not self.groups:
            return L1(self.lam).prox(z, t)
        return self._by_element(z, lambda w, n: F.when(n > t * self.lam * w, 1 - t * self.lam * w / n).otherwise(0.0))

    def grad(self, a):
        if not self.groups:
            return L1(self.lam).grad(a)
        return self._by_element(a, lambda w, n: F.when(n > 1e-12, self.lam * w / n).otherwise(0.0))

    def np_value(self, a):
        if not self.groups:
            return L1(self.lam).np_value(a)
        return self.lam * sum(w * np.sqrt((a[..., g] ** 2).sum(-1)) for g, w in zip(self.groups, self._w()))

    def np_prox(self, z, t):
        if not self.groups:
            return L1(self.lam).np_prox(z, t)
        out = np.zeros_like(z)
        for g, w in zip(self.groups, self._w()):
            n = np.sqrt((z[..., g] ** 2).sum(-1, keepdims=True))
            out[..., g] = z[..., g] * np.maximum(0, 1 - t * self.lam * w / np.maximum(n, 1e-300))
        return out


PENALTIES = {"l1": L1, "l2": L2, "elastic_net": ElasticNet, "top_k": TopK, "cauchy": Cauchy, "log_sum": LogSum, "group_lasso": GroupLasso, "scad": SCAD, "student_t": Welsch, "huber": Huber, "non_negative_l1": NonNegativeL1}


def create_penalty(name: str, **params) -> Penalty:
    if name not in PENALTIES:
        raise ValueError(f"unknown penalty {name!r}; there are {', '.join(sorted(PENALTIES))}")
    return PENALTIES[name](**params)
