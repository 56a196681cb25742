"""Encoding signals over a dictionary, and linear decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions.penalties import L1, Penalty
from . import solvers

#: A dictionary is sent to every worker; larger ones must be cut by the caller.
MAX_DICTIONARY_BYTES = 256 << 20
BATCH_ROWS = 2048
RESULT = T.StructType().add("a", T.ArrayType(T.DoubleType())).add("iterations", T.LongType()).add("converged", T.BooleanType()).add("objective", T.DoubleType()).add("reason", T.StringType())


def check_signals(df: DataFrame, x: str = "x") -> int:
    """The common length of the signals; raises for no rows, uneven lengths or values that are
    not finite. One aggregate."""
    n, lo, hi, bad = df.agg(F.count("*"), F.min(F.coalesce(F.size(x), F.lit(-1))), F.max(F.size(x)), F.count_if(~A.all_finite(x))).first()
    if not n:
        raise ValueError("no signals")
    if bad or lo != hi or lo < 1:
        raise ValueError(f"signals must be finite and of one length: {bad} are not finite, lengths {lo} to {hi}")
    return hi


def atoms_of(atoms) -> np.ndarray:
    """A dictionary as a matrix with an atom a row, from a table (atom_id, atom) or an array."""
    if isinstance(atoms, DataFrame):
        rows = atoms.select("atom_id", A.doubles("atom")).orderBy("atom_id").collect()
        d = np.array([r[1] for r in rows], float)
    else:
        d = np.asarray(atoms, float)
    if d.ndim != 2 or not d.size or not np.isfinite(d).all() or not d.any():
        raise ValueError("a dictionary is a finite matrix with atoms as rows, not all zero")
    if d.nbytes > MAX_DICTIONARY_BYTES:
        raise ValueError(f"a dictionary of {d.nbytes} bytes is too large to be sent to workers")
    return d


def atoms_table(spark: SparkSession, d: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(d)], "atom_id int, atom array<double>")


def normalize_atoms(d: np.ndarray) -> np.ndarray:
    return d / (np.sqrt((d * d).sum(1, keepdims=True)) + A.EPS)


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def list_column(a: np.ndarray) -> pa.Array:
    n, k = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(a, float).ravel()))


def encode(df: DataFrame, atoms, penalty: Penalty | None = None, solver: str = "auto", id_col: str = "sample_id", x: str = "x", keep: tuple[str, ...] = (), **params) -> DataFrame:
    """Codes of all signals: id, the columns in ``keep``, a, iterations, converged, objective, reason.

    Narrow: each batch of signals is solved with the broadcast dictionary."""
    d, pen = atoms_of(atoms), penalty or L1(0.1)
    solve = solvers.get_solver(solvers.auto_solver(pen) if solver == "auto" else solver)
    names = [id_col, *keep]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, BATCH_ROWS):
                p = b.slice(i, BATCH_ROWS)
                r = solve(matrix_of(p.column(0)), d, pen, **params)
                yield pa.RecordBatch.from_arrays([*p.columns[1:], list_column(r.a), pa.array(r.iterations), pa.array(r.converged), pa.array(r.objective), pa.array(r.reason, pa.string())], [*names, "a", "iterations", "converged", "objective", "reason"])

    src = df.select(A.doubles(x).alias("_x"), *names)
    return src.mapInArrow(run, T.StructType([*src.schema.fields[1:], *RESULT]))


def coder(atoms, penalty: Penalty, solver: str = "auto", **params):
    """Function from a matrix of signals to their codes, for use in the workers."""
    d = atoms_of(atoms)
    solve = solvers.get_solver(solvers.auto_solver(penalty) if solver == "auto" else solver)
    return lambda xs: solve(xs, d, penalty, **params).a


def somp(df: DataFrame, atoms, n_atoms: int, id_col: str = "sample_id", x: str = "x", criterion: str = "max") -> DataFrame:
    """Simultaneous OMP: one support for all signals. Each step is one aggregate over the data:
    the largest (``max``) or summed (``sum``) absolute correlation of each atom with the residuals."""
    d = atoms_of(atoms)
    norms, g, support = np.maximum(np.sqrt((d * d).sum(1)), 1e-12), d @ d.T, []
    src = df.select(A.doubles(x).alias("_x"), id_col)

    def coefficients(xs, s):
        c = xs @ d.T
        return c, (np.linalg.lstsq(g[np.ix_(s, s)], c[:, s].T, rcond=None)[0].T if s else np.zeros((len(xs), 0)))

    for _ in range(min(n_atoms, len(d))):
        chosen = list(support)

        def part(batches, chosen=chosen):
            most = None
            for b in batches:
                c, coef = coefficients(matrix_of(b.column(0)), chosen)
                r = np.abs(c - coef @ g[chosen]) / norms if chosen else np.abs(c) / norms
                v = r.max(0) if criterion == "max" else r.sum(0)
                most = v if most is None else np.maximum(most, v) if criterion == "max" else most + v
            if most is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(d), dtype=np.int32)), pa.array(most)], ["k", "v"])

        parts = src.mapInArrow(part, "k int, v double")
        score = parts.groupBy("k").agg((F.max if criterion == "max" else F.sum)("v").alias("v"))
        best = score.where(~F.col("k").isin(chosen) if chosen else F.lit(True)).orderBy(F.desc("v"), "k").first()
        if best is None or best["v"] <= 1e-10:
            break
        support.append(best["k"])

    def run(batches):
        for b in batches:
            xs = matrix_of(b.column(0))
            a = np.zeros((len(xs), len(d)))
            a[:, support] = coefficients(xs, support)[1]
            yield pa.RecordBatch.from_arrays([b.column(1), list_column(a)], [id_col, "a"])

    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[1][1]}, a array<double>")


def correlations(x, d: np.ndarray) -> Column:
    """Products of a signal column with all atoms (literal rows), in the JVM."""
    return A.matvec(A.matrix(d), x)


def decode(codes: DataFrame, atoms, a: str = "a", out: str = "x_hat", bias=None) -> DataFrame:
    """Adds the linear reconstruction; for dictionaries that fit into an expression."""
    x = A.combine(A.matrix(atoms_of(atoms)), a)
    return codes.withColumn(out, x if bias is None else A.add(x, A.vector(bias)))


def decode_long(codes_long: DataFrame, atoms: DataFrame) -> DataFrame:
    """Reconstruction from (sample_id, atom_id, coef): join with the atoms and sum by element."""
    each = codes_long.join(atoms, "atom_id").select("sample_id", "coef", F.posexplode("atom").alias("feature", "v"))
    return each.groupBy("sample_id", "feature").agg(F.sum(F.col("coef") * F.col("v")).alias("x_hat"))


def to_long(codes: DataFrame, a: str = "a", threshold: float = 0.0) -> DataFrame:
    """(sample_id, atom_id, coef) without zeros."""
    return codes.select("sample_id", F.posexplode(a).alias("atom_id", "coef")).where(F.abs("coef") > threshold)


def heuristic_lambda(df: DataFrame, mode: str = "l1", x: str = "x", atoms=None, exact: bool = False) -> float:
    """Default penalty weight: a share of the standard deviation of all entries (l1 0.1, log 0.05,
    paper and olshausen 0.14), or ``median``: 0.1 times the median absolute correlation, by a sketch of
    bounded size (relative rank error 1e-5) unless ``exact``, which keeps every distinct value."""
    if mode == "median":
        c = df.select(F.explode(F.transform(correlations(A.doubles(x), atoms_of(atoms)), F.abs)).alias("c"))
        median = F.percentile("c", F.lit(0.5)) if exact else F.percentile_approx("c", 0.5, 100_000)
        return 0.1 * c.agg(median).first()[0]
    share = {"l1": 0.1, "transcoder": 0.1, "log": 0.05, "paper": 0.14, "olshausen": 0.14}[mode]
    return share * df.select(F.explode(A.doubles(x)).alias("v")).agg(F.stddev_pop("v")).first()[0]
