"""Registered queries of the core operators and DuckDB SQL with the same columns.

Signals are the embeddings (64 values), the dictionary is the first K of them, normalised, and
codes are ``soft_threshold(D x, 0.1)`` unless a query is about solvers. A query with a vector per
sample returns three digests of it: sum, sum weighted by position, largest magnitude.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import penalties as P
from ..operators import analytics, encode as E, preprocess
from ..operators import dictionary as D
from ..operators.learn import DictionaryLearner
from ..operators.sae import SparseAutoencoder
from ..sources.tables import export_sql, signals
from . import monitor

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
K, LAM = 8, 0.1


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- inputs -------------------------------------------------------------------------------


def sig(spark, sf) -> DataFrame:
    return signals(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", ("label",))


def atoms(spark, sf, k: int = K) -> np.ndarray:
    """The first k embeddings by id, normalised: k rows reach the driver."""
    rows = sig(spark, sf).where(F.col("sample_id") < k).orderBy("sample_id").select("x").collect()
    return E.normalize_atoms(np.array([r[0] for r in rows]))


def corr(spark, sf, k: int = K) -> DataFrame:
    return sig(spark, sf).withColumn("c", E.correlations("x", atoms(spark, sf, k)))


def codes(spark, sf, k: int = K) -> DataFrame:
    return corr(spark, sf, k).withColumn("a", A.soft_threshold("c", LAM)).drop("c")


def scaled(spark, sf) -> DataFrame:
    return sig(spark, sf).select("sample_id", A.scale("x", 4.0).alias("y"))


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def digest(df: DataFrame, r: Column) -> DataFrame:
    df = df.select("sample_id", r.alias("r"))
    weighted = F.transform("r", lambda v, i: v * (i + 1))
    return df.select("sample_id", r6(A.total("r")).alias("total"), r6(A.total(weighted)).alias("moment"), r6(A.norm("r", float("inf"))).alias("peak"))


# ---- SQL parts ----------------------------------------------------------------------------

PRE = """WITH RECURSIVE s AS (SELECT vec_id AS sample_id, label, embedding::DOUBLE[] AS x FROM embeddings),
sy AS (SELECT sample_id, list_transform(x, lambda v: v * 4.0) AS y FROM s),
atm AS (SELECT sample_id AS k, list_transform(x, lambda v: v / (sqrt(list_dot_product(x, x)) + 1e-12)) AS d FROM s WHERE sample_id < 8),
dl AS (SELECT list(d ORDER BY k) AS ds FROM atm),
g AS (SELECT list_transform(ds, lambda u: list_transform(ds, lambda w: list_dot_product(u, w))) AS g FROM dl),
c AS (SELECT sample_id, label, x, list_transform(ds, lambda d: list_dot_product(d, x)) AS c FROM s, dl),
codes AS (SELECT sample_id, label, x, list_transform(c, lambda v: sign(v) * greatest(abs(v) - 0.1, 0.0)) AS a FROM c),
lng AS (SELECT sample_id, label, unnest(range(8)) AS atom_id, unnest(a) AS coef FROM codes)
"""


def s6(x: str) -> str:
    return f"(round(({x})::DOUBLE, 6) + 0.0)"


def digest_sql(expr: str, table: str, more: str = "") -> str:
    return f"""{PRE}{more} SELECT sample_id, {s6("list_sum(r)")} AS total, {s6("list_sum(list_transform(r, lambda v, i: v * i))")} AS moment,
{s6("list_max(list_transform(r, lambda v: abs(v)))")} AS peak FROM (SELECT sample_id, ({expr})::DOUBLE[] AS r FROM {table})"""


def value_sql(expr: str, table: str = "sy", more: str = "") -> str:
    return f"{PRE}{more} SELECT sample_id, {s6(expr)} AS value FROM {table}"


def shrink_sql(v: str, t: str) -> str:
    return f"(sign({v}) * greatest(abs({v}) - {t}, 0.0))"


# ---- penalties ----------------------------------------------------------------------------

T, W = 0.5, 0.3  # step and weight
_newton = lambda grad, hess, n: f"list_transform(y, lambda z: list_reduce(list_prepend(z, list_transform(range({n}), lambda i: 0.0::DOUBLE)), lambda v, i: v - (v - z + {T} * ({grad})) / (CASE WHEN abs(1 + {T} * ({hess})) < 1e-8 THEN 1e-8 ELSE 1 + {T} * ({hess}) END)))"
_each = lambda e: f"list_transform(y, lambda v: {e})"
_cgrad, _chess = f"2 * {W} * v / (1 + v * v)", f"{W} * 2 * (1 - v * v) / ((1 + v * v) * (1 + v * v))"
_wgrad, _whess = f"2 * {W} * v * exp(-v * v)", f"2 * {W} * exp(-v * v) * (1 - 2 * v * v)"
_rank = "list_transform(list_sort(list_transform(y, lambda v, i: {'m': -abs(v), 'i': i})), lambda r: r.i)"
_grp = [list(range(g, g + 8)) for g in range(0, 64, 8)]
_gn = "list_transform(range(8), lambda q: sqrt(list_dot_product(y[8 * q + 1:8 * q + 8], y[8 * q + 1:8 * q + 8])))"
_scad = {
    "value": _each(f"CASE WHEN abs(v) <= {W} THEN {W} * abs(v) WHEN abs(v) <= 3.7 * {W} THEN -(v * v - 2 * 3.7 * {W} * abs(v) + {W} * {W}) / (2 * 2.7) ELSE 4.7 * {W} * {W} / 2 END"),
    "prox": _each(f"CASE WHEN abs(v) <= {W} * (1 + {T}) THEN {shrink_sql('v', f'{T} * {W}')} WHEN abs(v) <= 3.7 * {W} THEN {shrink_sql('v', f'{T} * 3.7 * {W} / 2.7')} * (2.7 / (2.7 - {T})) ELSE v END"),
    "grad": _each(f"CASE WHEN abs(v) <= {W} THEN {W} * sign(v) WHEN abs(v) <= 3.7 * {W} THEN sign(v) * (3.7 * {W} - abs(v)) / 2.7 ELSE 0 END"),
}
PENALTY_SQL = {
    "l1": (P.L1(W), {"value": _each(f"{W} * abs(v)"), "prox": _each(shrink_sql("v", f"{T} * {W}")), "grad": _each(f"CASE WHEN abs(v) < 1e-15 THEN 0 ELSE {W} * sign(v) END")}),
    "l2": (P.L2(W), {"value": _each(f"0.5 * {W} * v * v"), "prox": _each(f"v / (1 + {T} * {W})"), "grad": _each(f"{W} * v")}),
    "elastic_net": (P.ElasticNet(W, 0.5), {"value": _each(f"{W} * 0.5 * abs(v) + 0.25 * {W} * v * v"), "prox": _each(f"{shrink_sql('v', f'{T} * {W} * 0.5')} / (1 + {T} * {W} * 0.5)"), "grad": _each(f"CASE WHEN abs(v) < 1e-15 THEN 0 ELSE {W} * 0.5 * sign(v) END + {W} * 0.5 * v")}),
    "cauchy": (P.Cauchy(W), {"value": _each(f"{W} * ln(1 + v * v)"), "prox": _newton(_cgrad, _chess, 10), "grad": _each(_cgrad), "hessian": _each(_chess)}),
    "log_sum": (P.LogSum(W, 0.01, 20), {"value": _each(f"{W} * ln(1 + abs(v) / 0.01)"), "prox": f"list_transform(y, lambda z: list_reduce(list_prepend(z, list_transform(range(20), lambda i: 0.0::DOUBLE)), lambda v, i: {shrink_sql('z', f'{T} * {W} / (0.01 + abs(v))')}))", "grad": _each(f"{W} * sign(v) / (0.01 + abs(v))")}),
    "scad": (P.SCAD(W), _scad),
    "student_t": (P.Welsch(W), {"value": _each(f"{W} * (1 - exp(-v * v))"), "prox": _newton(_wgrad, _whess, 20), "grad": _each(_wgrad)}),
    "huber": (P.Huber(W, 0.7), {"value": _each(f"{W} * CASE WHEN abs(v) <= 0.7 THEN 0.5 * v * v ELSE 0.7 * (abs(v) - 0.35) END"), "prox": _each(f"CASE WHEN abs(v) <= 0.7 * (1 + {T} * {W}) THEN v / (1 + {T} * {W}) ELSE v - {T} * {W} * 0.7 * sign(v) END"), "grad": _each(f"{W} * CASE WHEN abs(v) <= 0.7 THEN v ELSE 0.7 * sign(v) END")}),
    "top_k": (P.TopK(k=5), {"prox": f"list_transform(y, lambda v, i: CASE WHEN list_contains(({_rank})[1:5], i) THEN v ELSE 0 END)", "grad": f"list_transform(y, lambda v, i: CASE WHEN list_contains(({_rank})[1:5], i) THEN 0 ELSE sign(v) * greatest(1000.0, 100 * list_max(list_transform(y, lambda u: abs(u)))) END)"}),
    "group_lasso": (P.GroupLasso(W, _grp), {"value": f"list_transform({_gn}, lambda n: {W} * n)", "prox": f"list_transform(y, lambda v, i: v * greatest(0.0, 1 - {T} * {W} / ({_gn})[((i - 1) // 8) + 1]))", "grad": f"list_transform(y, lambda v, i: v * {W} / ({_gn})[((i - 1) // 8) + 1])"}),
    "l1_nonneg": (P.NonNegativeL1(W), {"prox": _each(f"greatest(v - {T} * {W}, 0.0)")}),
    "l1_symmetric": (P.L1(W, "symmetric"), {"prox": _each(shrink_sql("v", f"{T} * {W}"))}),
}


def _penalty_queries() -> None:
    for name, (pen, sql) in PENALTY_SQL.items():
        for part, expr in sql.items():
            if part == "value":
                query(f"{name}_value", value_sql(f"list_sum({expr})"))(lambda s, d, p=pen: scaled(s, d).select("sample_id", r6(p.value("y")).alias("value")))
            elif part == "prox":
                query(f"{name}_prox", digest_sql(expr, "sy"))(lambda s, d, p=pen: digest(scaled(s, d), p.prox("y", T)))
            else:
                query(f"{name}_{part}", digest_sql(expr, "sy"))(lambda s, d, p=pen, m=part: digest(scaled(s, d), getattr(p, m)("y")))


_penalty_queries()


@query("top_k_value", f"{PRE} SELECT sample_id, len(list_filter(a, lambda v: abs(v) > 1e-15)) > 3 AS infinite FROM codes")
def top_k_value(s, d):
    return codes(s, d).select("sample_id", (P.TopK(k=3).value("a") == float("inf")).alias("infinite"))


@query("l1_nonneg_value", f"{PRE} SELECT sample_id, list_min(a) < 0 AS infinite FROM codes")
def l1_nonneg_value(s, d):
    return codes(s, d).select("sample_id", (P.NonNegativeL1(W).value("a") == float("inf")).alias("infinite"))


# ---- arrays and validation ----------------------------------------------------------------


@query("soft_threshold", digest_sql(f"list_transform(x, lambda v: {shrink_sql('v', '0.05')})", "s"))
def soft_threshold(s, d):
    return digest(sig(s, d), A.soft_threshold("x", 0.05))


@query("normalize_columns", digest_sql("list_transform(y, lambda v: v / (sqrt(list_dot_product(y, y)) + 1e-12))", "sy"))
def normalize_columns(s, d):
    return digest(scaled(s, d), A.normalize("y"))


@query("vector_norms", f"{PRE} SELECT sample_id, {s6('list_sum(list_transform(y, lambda v: abs(v)))')} AS n1, {s6('sqrt(list_dot_product(y, y))')} AS n2, {s6('list_max(list_transform(y, lambda v: abs(v)))')} AS ninf FROM sy")
def vector_norms(s, d):
    return scaled(s, d).select("sample_id", r6(A.norm("y", 1)).alias("n1"), r6(A.norm("y")).alias("n2"), r6(A.norm("y", float("inf"))).alias("ninf"))


@query("spectral_bound_gershgorin", f"{PRE} SELECT {s6('list_max(list_transform(g, lambda r: list_sum(list_transform(r, lambda v: abs(v)))))')} AS bound FROM g")
def spectral_bound_gershgorin(s, d):
    a = atoms(s, d)
    return s.range(1).select(r6(A.gershgorin(A.matrix(a @ a.T))).alias("bound"))


_power_sql = f"""{PRE}, pw AS (SELECT 0 AS i, list_transform(range(8), lambda q: 1.0::DOUBLE + 0.1 * q) AS v FROM g
UNION ALL SELECT i + 1, list_transform(list_transform(g, lambda r: list_dot_product(r, v)), lambda z: z / sqrt(list_dot_product(list_transform(g, lambda r: list_dot_product(r, v)), list_transform(g, lambda r: list_dot_product(r, v))))) FROM pw, g WHERE i < 2000)
SELECT {s6('sqrt(list_dot_product(list_transform(g, lambda r: list_dot_product(r, v)), list_transform(g, lambda r: list_dot_product(r, v))))')} AS norm FROM pw, g WHERE i = 2000"""


@query("spectral_norm_power", _power_sql)
def spectral_norm_power(s, d):
    from ..operators.solvers import power_iteration

    return s.createDataFrame([(round(float(power_iteration(atoms(s, d), 2000, 1e-14)), 6),)], "norm double")


@query("matmul_outer_trace", f"{PRE} SELECT sample_id, {s6('list_dot_product(a, a)')} AS trace FROM codes")
def matmul_outer_trace(s, d):
    m = A.matmul(A.outer("a", "a"), A.eye(K))
    return codes(s, d).select("sample_id", r6(A.total(F.transform(m, lambda r, i: F.get(r, i)))).alias("trace"))


@query("finite_check", "SELECT count(*) AS n, min(len(embedding)) AS lo, max(len(embedding)) AS hi, count(*) FILTER (len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))) > 0) AS bad FROM embeddings")
def finite_check(s, d):
    return sig(s, d).agg(F.count("*").alias("n"), F.min(F.size("x")).cast("long").alias("lo"), F.max(F.size("x")).cast("long").alias("hi"), F.count_if(~A.all_finite("x")).alias("bad"))


@query("codes_long_explode", f"{PRE} SELECT sample_id, atom_id, {s6('coef')} AS coef FROM lng WHERE abs(coef) > 0")
def codes_long_explode(s, d):
    return E.to_long(codes(s, d)).select("sample_id", F.col("atom_id").cast("long").alias("atom_id"), r6(F.col("coef")).alias("coef"))


@query("decode_linear", digest_sql("list_transform(range(1, 65), lambda j: list_sum(list_transform(ds, lambda d, k: d[j] * a[k])))", "codes, dl"))
def decode_linear(s, d):
    return digest(E.decode(codes(s, d), atoms(s, d)), F.col("x_hat"))


@query("decode_long_join", f"{PRE}, e AS (SELECT k, unnest(range(64)) AS feature, unnest(d) AS v FROM atm) SELECT sample_id, feature, {s6('sum(coef * v)')} AS x_hat FROM lng JOIN e ON k = atom_id WHERE abs(coef) > 0 GROUP BY ALL")
def decode_long_join(s, d):
    out = E.decode_long(E.to_long(codes(s, d)), E.atoms_table(s, atoms(s, d)))
    return out.select("sample_id", F.col("feature").cast("long").alias("feature"), r6(F.col("x_hat")).alias("x_hat"))


@query("atom_names", f"{PRE} SELECT DISTINCT atom_id, 'atom_' || atom_id AS name FROM lng")
def atom_names(s, d):
    return codes(s, d).select(F.posexplode("a").alias("atom_id", "v")).select(F.col("atom_id").cast("long").alias("atom_id"), F.concat(F.lit("atom_"), "atom_id").alias("name")).distinct()


@query("correlation_cross", f"{PRE} SELECT sample_id, k AS atom_id, {s6('list_dot_product(d, x)')} AS c FROM s, atm")
def correlation_cross(s, d):
    return corr(s, d).select("sample_id", F.posexplode("c").alias("atom_id", "c")).select("sample_id", F.col("atom_id").cast("long").alias("atom_id"), r6(F.col("c")).alias("c"))


@query("atoms_not_selected", f"{PRE} SELECT sample_id, len(list_filter(a, lambda v: v = 0)) AS unused FROM codes")
def atoms_not_selected(s, d):
    used = F.filter(F.transform("a", lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    every = F.sequence(F.lit(0), F.lit(K - 1))
    return codes(s, d).select("sample_id", F.size(F.array_except(every, used)).cast("long").alias("unused"))


@query("export_expression", digest_sql("a", "codes"))
def export_expression(s, d):
    return digest(sig(s, d), F.expr(export_sql(atoms(s, d), LAM)))


# ---- encoding -----------------------------------------------------------------------------

STEPS = 10


def _ista_sql(step: str, n: int = STEPS, lam: float = 0.05) -> str:
    more = f""", it AS (SELECT sample_id, 0 AS k, list_transform(c, lambda v: 0.0::DOUBLE) AS a, c FROM c
UNION ALL SELECT sample_id, k + 1, list_transform(list_transform(range(1, 9), lambda i: a[i] - 0.25 * (list_dot_product(g.g[i], a) - c[i])), lambda u: {step}), c FROM it, g WHERE k < {n})"""
    return digest_sql("a", f"(SELECT * FROM it WHERE k = {n})", more)


def _fixed(s, d, pen, solver, **kw):
    return digest(E.encode(sig(s, d).repartition(8), atoms(s, d), pen, solver, max_iter=STEPS, tol=0, step=0.25, **kw), F.col("a"))


@query("encode_ista_fixed", _ista_sql(shrink_sql("u", "0.25 * 0.05")))
def encode_ista_fixed(s, d):
    return _fixed(s, d, P.L1(0.05), "ista")


@query("encode_elastic_net_fixed", _ista_sql(f"{shrink_sql('u', '0.25 * 0.05 * 0.5')} / (1 + 0.25 * 0.05 * 0.5)"))
def encode_elastic_net_fixed(s, d):
    return _fixed(s, d, P.ElasticNet(0.05, 0.5), "ista")


@query("encode_nonneg_fixed", _ista_sql("greatest(u - 0.25 * 0.05, 0.0)"))
def encode_nonneg_fixed(s, d):
    return _fixed(s, d, P.NonNegativeL1(0.05), "ista")


@query("encode_ridge_fixed", _ista_sql("u / (1 + 0.25 * 0.05)"))
def encode_ridge_fixed(s, d):
    return _fixed(s, d, P.L2(0.05), "ista")


_fista_more = f""", it AS (SELECT sample_id, 0 AS k, list_transform(c, lambda v: 0.0::DOUBLE) AS a, list_transform(c, lambda v: 0.0::DOUBLE) AS y, 1.0::DOUBLE AS t, c FROM c
UNION ALL SELECT sample_id, k + 1, z, list_transform(range(1, 9), lambda i: z[i] + (t - 1) / ((1 + sqrt(1 + 4 * t * t)) / 2) * (z[i] - a[i])), (1 + sqrt(1 + 4 * t * t)) / 2, c
FROM (SELECT sample_id, k, a, t, c, list_transform(list_transform(range(1, 9), lambda i: y[i] - 0.25 * (list_dot_product(g.g[i], y) - c[i])), lambda u: {shrink_sql("u", "0.25 * 0.05")}) AS z FROM it, g WHERE k < {STEPS}))"""


@query("encode_fista_fixed", digest_sql("a", f"(SELECT * FROM it WHERE k = {STEPS})", _fista_more))
def encode_fista_fixed(s, d):
    return _fixed(s, d, P.L1(0.05), "fista")


_hard = "list_transform(u, lambda v, i: CASE WHEN list_contains(list_transform(list_sort(list_transform(u, lambda q, j: {'m': -abs(q), 'j': j})), lambda r: r.j)[1:3], i) THEN v ELSE 0 END)"
_iht_more = f""", it AS (SELECT sample_id, 0 AS k, list_transform(c, lambda v: 0.0::DOUBLE) AS a, c FROM c
UNION ALL SELECT sample_id, k + 1, {_hard}, c FROM (SELECT sample_id, k, c, list_transform(range(1, 9), lambda i: a[i] - 0.25 * (list_dot_product(g.g[i], a) - c[i])) AS u FROM it, g WHERE k < {STEPS}))"""


@query("encode_iht_topk_fixed", digest_sql("a", f"(SELECT * FROM it WHERE k = {STEPS})", _iht_more))
def encode_iht_topk_fixed(s, d):
    return _fixed(s, d, P.TopK(k=3), "ista")


_gd_more = f""", it AS (SELECT sample_id, 0 AS k, list_transform(c, lambda v: 0.0::DOUBLE) AS a, c FROM c
UNION ALL SELECT sample_id, k + 1, list_transform(range(1, 9), lambda i: a[i] - 0.1 * (list_dot_product(g.g[i], a) - c[i] + 0.05 * 2 * a[i] / (1 + a[i] * a[i]))), c FROM it, g WHERE k < 1)"""


@query("encode_gradient_step", digest_sql("a", "(SELECT * FROM it WHERE k = 1)", _gd_more))
def encode_gradient_step(s, d):
    return digest(E.encode(sig(s, d), atoms(s, d), P.Cauchy(0.05), "gradient", max_iter=1, rate=0.1), F.col("a"))


def _kkt(s, d, solver, **kw):
    """Optimality of L1 codes: |D r| = lam with the sign of a where a is not 0, at most lam elsewhere."""
    lam, a = 0.05, atoms(s, d)
    return _violations(E.decode(E.encode(sig(s, d), a, P.L1(lam), solver, keep=("x",), max_iter=5000, tol=1e-12, **kw), a), a, lam)


def _violations(c, a, lam, *more):
    g = E.correlations(A.subtract("x", "x_hat"), a)
    wrong = F.exists(F.zip_with("a", g, lambda v, q: F.when(F.abs(v) > 1e-9, F.abs(q - lam * F.signum(v)) > 1e-6).otherwise(F.abs(q) > lam + 1e-6)), lambda b: b)
    return c.agg(F.count("*").alias("n"), *more, F.count_if(wrong).alias("violations"))


_kkt_sql = "SELECT count(*) AS n, 0::BIGINT AS violations FROM embeddings"
for _name, _solver, _kw in (("encode_l1_kkt", "fista", {}), ("encode_ista_kkt", "ista", {}), ("encode_cd_kkt", "coordinate_descent", {}), ("encode_fista_backtracking_kkt", "fista", {"step": "backtracking"}), ("encode_fista_monotone_kkt", "fista", {"monotone": True}), ("encode_fista_restart_kkt", "fista", {"restart": "gradient"})):
    query(_name, _kkt_sql)(lambda s, d, n=_solver, kw=_kw: _kkt(s, d, n, **kw))


def _orthogonal(s, d, variant):
    """Residuals of pursuits are orthogonal to the chosen atoms, and at most 3 are chosen."""
    a = atoms(s, d)
    c = E.decode(E.encode(sig(s, d), a, P.L1(0.0), "omp", keep=("x",), n_atoms=3, variant=variant), a)
    g = E.correlations(A.subtract("x", "x_hat"), a)
    wrong = F.exists(F.zip_with("a", g, lambda v, q: (v != 0) & (F.abs(q) > 1e-8)), lambda b: b) | (A.count_active("a") > 3)
    return c.agg(F.count("*").alias("n"), F.count_if(wrong).alias("violations"))


for _v in ("standard", "weak", "stagewise", "regularized"):
    query(f"encode_omp_{_v}_orthogonality", _kkt_sql)(lambda s, d, v=_v: _orthogonal(s, d, v))


@query("encode_omp_first_atom", f"{PRE} SELECT sample_id, list_position(list_transform(c, lambda v: abs(v)), list_max(list_transform(c, lambda v: abs(v)))) - 1 AS atom_id, {s6('list_max(list_transform(c, lambda v: abs(v)))')} AS coef FROM c")
def encode_omp_first_atom(s, d):
    c = E.encode(sig(s, d), atoms(s, d), solver="omp", n_atoms=1)
    return c.select("sample_id", (F.array_position(F.transform("a", lambda v: (v != 0).cast("int")), 1) - 1).cast("long").alias("atom_id"), r6(A.norm("a", 1)).alias("coef"))


@query("somp_support", f"{PRE}, m AS (SELECT k, max(abs(list_dot_product(d, x))) AS v FROM s, atm GROUP BY 1) SELECT (SELECT k FROM m ORDER BY v DESC, k LIMIT 1) AS atom_id, count(*) AS n FROM s")
def somp_support(s, d):
    c = E.somp(sig(s, d), atoms(s, d), 1)
    return E.to_long(c, threshold=1e-15).groupBy(F.col("atom_id").cast("long").alias("atom_id")).agg(F.count("*").alias("n"))


@query("encode_ncg_gradient", _kkt_sql)
def encode_ncg_gradient(s, d):
    """Gradient of the log-prior objective is near zero at the codes."""
    a, pen = atoms(s, d), P.Cauchy(0.05)
    c = E.decode(E.encode(sig(s, d), a, pen, "ncg", keep=("x",), max_iter=500, tol=1e-8), a)
    g = A.subtract(pen.grad("a"), E.correlations(A.subtract("x", "x_hat"), a))
    return c.agg(F.count("*").alias("n"), F.count_if(A.norm(g) > 1e-5).alias("violations"))


@query("encode_log_prior_gradient", _kkt_sql)
def encode_log_prior_gradient(s, d):
    """The same for the solver of the log prior by name."""
    a, pen = atoms(s, d), P.Cauchy(0.05)
    c = E.decode(E.encode(sig(s, d), a, pen, "log_prior", keep=("x",), max_iter=500, tol=1e-8, lam=0.05), a)
    g = A.subtract(pen.grad("a"), E.correlations(A.subtract("x", "x_hat"), a))
    return c.agg(F.count("*").alias("n"), F.count_if(A.norm(g) > 1e-5).alias("violations"))


# ---- dictionary updates -------------------------------------------------------------------


def _matrix_table(spark, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(np.round(m, 6) + 0.0)], "i long, j long, value double")


@query("gram_aat", f"{PRE} SELECT p.atom_id AS i, q.atom_id AS j, {s6('sum(p.coef * q.coef)')} AS value FROM lng p JOIN lng q USING (sample_id) GROUP BY ALL")
def gram_aat(s, d):
    return _matrix_table(s, D.statistics(codes(s, d)).gram)


@query("cross_xat", f"{PRE}, e AS (SELECT sample_id, unnest(range(64)) AS j, unnest(x) AS v FROM s) SELECT atom_id AS i, j, {s6('sum(coef * v)')} AS value FROM lng JOIN e USING (sample_id) GROUP BY ALL")
def cross_xat(s, d):
    return _matrix_table(s, D.statistics(codes(s, d)).cross)


_step_sql = """, e AS (SELECT sample_id, unnest(range(64)) AS j, unnest(x) AS v FROM s),
gr AS (SELECT p.atom_id AS i, q.atom_id AS m, sum(p.coef * q.coef) AS w FROM lng p JOIN lng q USING (sample_id) GROUP BY ALL),
cr AS (SELECT atom_id AS i, j, sum(coef * v) AS w FROM lng JOIN e USING (sample_id) GROUP BY ALL),
de AS (SELECT k, unnest(range(64)) AS j, unnest(d) AS v FROM atm),
ga AS (SELECT i, j, sum(gr.w * v) AS w FROM gr JOIN de ON m = k GROUP BY ALL),
nw AS (SELECT k AS i, de.j, v + 0.5 * (cr.w - ga.w) / (SELECT count(*) FROM s) AS v FROM de JOIN cr ON cr.i = k AND cr.j = de.j JOIN ga ON ga.i = k AND ga.j = de.j)"""


@query("gradient_update_step", f"{PRE}{_step_sql} SELECT i, j, {s6('v / (sqrt(sum(v * v) OVER (PARTITION BY i)) + 1e-12)')} AS value FROM nw")
def gradient_update_step(s, d):
    return _matrix_table(s, D.GradientUpdate(rate=0.5).step(D.statistics(codes(s, d)), atoms(s, d)))


#: A'A and A'X as lists of rows, and a table of a list of atoms.
_lists_sql = """, ev AS (SELECT sample_id, unnest(range(64)) AS j, unnest(x) AS v FROM s),
gm AS (SELECT list(r ORDER BY i) AS gm FROM (SELECT i, list(w ORDER BY m) AS r FROM (SELECT p.atom_id AS i, q.atom_id AS m, sum(p.coef * q.coef) AS w FROM lng p JOIN lng q USING (sample_id) GROUP BY ALL) GROUP BY 1)),
cm AS (SELECT list(r ORDER BY i) AS cm FROM (SELECT i, list(w ORDER BY j) AS r FROM (SELECT atom_id AS i, j, sum(coef * v) AS w FROM lng JOIN ev USING (sample_id) GROUP BY ALL) GROUP BY 1))"""
_atoms_sql = f"SELECT i, unnest(range(64)) AS j, unnest(list_transform(r, lambda v: {s6('v')})) AS value FROM (SELECT unnest(range(8)) AS i, unnest(fin) AS r FROM fin)"
_unit = lambda r: f"list_transform({r}, lambda z: z / (sqrt(list_dot_product({r}, {r})) + 1e-12))"
#: Gauss-Jordan elimination of (A'A + ridge | A'X), a row at a time.
_solve_sql = f"""{PRE}{_lists_sql}, el AS (SELECT 1 AS k, list_transform(gm, lambda r, i: list_concat(list_transform(r, lambda v, j: v + CASE WHEN i = j THEN 1e-6 ELSE 0 END), cm[i])) AS m FROM gm, cm
UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= 8),
fin AS (SELECT list_transform(m, lambda r: {_unit("r[9:72]")}) AS fin FROM el WHERE k = 9) {_atoms_sql}"""


@query("mod_normal_residual", _solve_sql)
def mod_normal_residual(s, d):
    """Atoms of the optimal directions: the normalised solution of (A'A + ridge I) D = A'X."""
    return _matrix_table(s, D.mod(D.statistics(codes(s, d))))


_residual = "list_transform(dd[k], lambda v, j: v + (cm[k][j] - list_sum(list_transform(dd, lambda q, m: gm[k][m] * q[j]))) / gm[k][k])"
_block_sql = f"""{PRE}{_lists_sql}, bc AS (SELECT 1 AS k, ds AS dd FROM dl
UNION ALL SELECT k + 1, list_transform(dd, lambda q, i: CASE WHEN i = k THEN {_unit('nw')} ELSE q END) FROM (SELECT k, dd, {_residual} AS nw FROM bc, gm, cm WHERE k <= 8)),
fin AS (SELECT dd AS fin FROM bc WHERE k = 9) {_atoms_sql}"""


@query("block_coordinate_step", _block_sql)
def block_coordinate_step(s, d):
    return _matrix_table(s, D.block_coordinate(D.statistics(codes(s, d)), atoms(s, d)))


@query("online_update_step", _block_sql)
def online_update_step(s, d):
    """The first step of the averages is a pass over the sums of the first batch, which their scale does not change."""
    return _matrix_table(s, D.OnlineUpdate().step(D.statistics(codes(s, d)), atoms(s, d)))


def _sweep_sql() -> str:
    """A step for each atom: residuals of the signals that use it plus its part, their sum weighted by the
    codes is the new atom, and their products with it are the new codes."""
    sql = f"{PRE}, k0 AS (SELECT sample_id, a, list_transform(x, lambda v, j: v - list_sum(list_transform(ds, lambda d, k: d[j] * a[k]))) AS r FROM codes, dl)"
    for k in range(1, K + 1):
        sql += f""", e{k} AS MATERIALIZED (SELECT sample_id, a, r, abs(a[{k}]) > 1e-12 AS use, list_transform(r, lambda v, j: v + a[{k}] * ds[{k}][j]) AS e FROM k{k - 1}, dl),
u{k} AS (SELECT list(v ORDER BY j) AS u FROM (SELECT j, sum(c * v) AS v FROM (SELECT a[{k}] AS c, unnest(range(64)) AS j, unnest(e) AS v FROM e{k} WHERE use) GROUP BY 1)),
d{k} AS MATERIALIZED (SELECT list_transform(u, lambda v: v / sqrt(list_dot_product(u, u))) AS d FROM u{k}),
k{k} AS MATERIALIZED (SELECT sample_id, CASE WHEN use THEN list_transform(a, lambda v, i: CASE WHEN i = {k} THEN list_dot_product(e, d) ELSE v END) ELSE a END AS a, CASE WHEN use THEN list_transform(e, lambda v, j: v - list_dot_product(e, d) * d[j]) ELSE r END AS r FROM e{k}, d{k})"""
    return sql + f", fin AS (SELECT [{', '.join(f'(SELECT d FROM d{k})' for k in range(1, K + 1))}] AS fin) {_atoms_sql}"


@query("ksvd_sweep", _sweep_sql())
def ksvd_sweep(s, d):
    """Atoms after a sweep with one power step an atom."""
    return _matrix_table(s, D.ksvd(codes(s, d).select("sample_id", "x", "a"), atoms(s, d), approximate=True)[0])


@query("ksvd_sweep_codes", _sweep_sql().split(", fin AS")[0] + f" SELECT sample_id, {s6('list_sum(a)')} AS total, {s6('list_sum(list_transform(a, lambda v, i: v * i))')} AS moment, {s6('list_max(list_transform(a, lambda v: abs(v)))')} AS peak FROM k{K}")
def ksvd_sweep_codes(s, d):
    """Codes after the sweep."""
    return digest(D.ksvd(codes(s, d).select("sample_id", "x", "a"), atoms(s, d), approximate=True)[1], F.col("a"))


@query("atom_usage", f"{PRE} SELECT atom_id, count(*) FILTER (abs(coef) > 1e-6) AS n_active, {s6('sqrt(avg(coef * coef) + 1e-12)')} AS energy FROM lng GROUP BY 1")
def atom_usage(s, d):
    return analytics.long_view(codes(s, d)).groupBy(F.col("atom_id").cast("long").alias("atom_id")).agg(F.count_if(F.abs("coef") > 1e-6).alias("n_active"), r6(F.sqrt(F.avg(F.col("coef") ** 2) + 1e-12)).alias("energy"))


@query("dead_atoms", f"{PRE} SELECT atom_id FROM lng GROUP BY 1 HAVING avg((abs(coef) > 1e-6)::INT) < 0.05")
def dead_atoms(s, d):
    rows = [(int(k),) for k in D.dead_atoms(D.statistics(codes(s, d)), 0.05)]
    return s.createDataFrame(rows, "atom_id long")


@query("homeostatic_gain", f"{PRE}, u AS (SELECT atom_id, sqrt(avg(coef * coef) + 1e-12) AS u FROM lng GROUP BY 1) SELECT atom_id, {s6('pow((SELECT avg(u) FROM u) / u, 0.1)')} AS gain FROM u")
def homeostatic_gain(s, d):
    g = D.homeostatic_gain(D.statistics(codes(s, d)))
    return s.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(g)], "atom_id long, gain double")


#: Codes after STEPS steps from zero, one row for each code, in the place of ``lng``.
_steps_sql = f""", it AS (SELECT sample_id, 0 AS k, list_transform(c, lambda v: 0.0::DOUBLE) AS a, c FROM c
UNION ALL SELECT sample_id, k + 1, list_transform(list_transform(range(1, 9), lambda i: a[i] - 0.25 * (list_dot_product(g.g[i], a) - c[i])), lambda u: {shrink_sql("u", "0.25 * 0.05")}), c FROM it, g WHERE k < {STEPS}),
lit AS (SELECT sample_id, unnest(range(8)) AS atom_id, unnest(a) AS coef FROM it WHERE k = {STEPS})"""


@query("learn_dictionary_step", _solve_sql.replace(f"{PRE}{_lists_sql}", f"{PRE}{_steps_sql}{_lists_sql.replace('lng', 'lit')}"))
def learn_dictionary_step(s, d):
    """Atoms that a learning step gives: the signals encoded, then the optimal directions of their codes."""
    fixed = {"max_iter": STEPS, "tol": 0, "step": 0.25}
    m = DictionaryLearner(n_atoms=K, lam=0.05, solver="ista", solver_params=fixed, n_steps=1, stop="none", replace_dead=False, atoms=atoms(s, d))
    return _matrix_table(s, m.fit(sig(s, d).repartition(8)).atoms)


@query("learn_dictionary_mod", "SELECT true AS descends, 3::BIGINT AS steps")
def learn_dictionary_mod(s, d):
    m = DictionaryLearner(n_atoms=16, lam=0.05, n_steps=3, stop="none", replace_dead=False).fit(sig(s, d))
    e = [h["objective"] if h["objective"] is not None else h["mse"] for h in m.history]
    return s.createDataFrame([(bool(e[-1] < e[0]), len(e))], "descends boolean, steps long")


# ---- metrics and analytics ----------------------------------------------------------------

_recon = ", rc AS (SELECT sample_id, x, a, list_transform(range(1, 65), lambda j: list_sum(list_transform(ds, lambda d, k: d[j] * a[k]))) AS h FROM codes, dl), er AS (SELECT sample_id, x, a, list_transform(x, lambda v, j: v - h[j]) AS e FROM rc)"


@query("reconstruction_mse", f"{PRE}{_recon} SELECT {s6('sum(list_dot_product(e, e)) / sum(len(x))')} AS mse, {s6('sqrt(sum(list_dot_product(e, e)) / sum(list_dot_product(x, x)))')} AS relative_error, {s6('10 * log10(sum(list_dot_product(x, x)) / sum(list_dot_product(e, e)))')} AS snr_db FROM er")
def reconstruction_mse(s, d):
    r = analytics.reconstruction(E.decode(codes(s, d), atoms(s, d)))
    return r.select(*(r6(F.col(c)).alias(c) for c in r.columns))


@query("reconstruction_errors", f"{PRE}{_recon} SELECT sample_id, {s6('list_dot_product(e, e) / 64')} AS mse, {s6('list_max(list_transform(e, lambda v: abs(v)))')} AS max_error FROM er")
def reconstruction_errors(s, d):
    r = monitor.reconstruction_report(E.decode(codes(s, d), atoms(s, d)))
    return r.select("sample_id", r6(F.col("mse")).alias("mse"), r6(F.col("max_error")).alias("max_error"))


@query("objective_l1", f"{PRE}{_recon} SELECT sample_id, {s6('0.5 * list_dot_product(e, e) + 0.1 * list_sum(list_transform(a, lambda v: abs(v)))')} AS objective FROM er")
def objective_l1(s, d):
    e = A.subtract("x", "x_hat")
    return E.decode(codes(s, d), atoms(s, d)).select("sample_id", r6(0.5 * A.dot(e, e) + P.L1(0.1).value("a")).alias("objective"))


@query("objective_log_prior", f"{PRE}{_recon} SELECT sample_id, {s6('0.5 * list_dot_product(e, e) + 0.1 * list_sum(list_transform(a, lambda v: ln(1 + v * v)))')} AS objective FROM er")
def objective_log_prior(s, d):
    e = A.subtract("x", "x_hat")
    return E.decode(codes(s, d), atoms(s, d)).select("sample_id", r6(0.5 * A.dot(e, e) + P.Cauchy(0.1).value("a")).alias("objective"))


@query("sparsity_level", f"{PRE} SELECT {s6('1 - sum(len(list_filter(a, lambda v: abs(v) > 1e-8))) / sum(len(a))')} AS sparsity, {s6('avg(len(list_filter(a, lambda v: abs(v) > 1e-8)))')} AS mean_active, {s6('stddev_pop(len(list_filter(a, lambda v: abs(v) > 1e-8)))')} AS std_active FROM codes")
def sparsity_level(s, d):
    r = analytics.code_summary(codes(s, d))
    return r.select(*(r6(F.col(c)).alias(c) for c in ("sparsity", "mean_active", "std_active")))


@query("code_summary", f"{PRE} SELECT count(DISTINCT sample_id) AS n_samples, {s6('max(abs(coef))')} AS max_activation, {s6('avg(coef) FILTER (abs(coef) > 1e-8)')} AS mean_strength FROM lng")
def code_summary(s, d):
    return analytics.code_summary(codes(s, d)).select("n_samples", r6(F.col("max_activation")).alias("max_activation"), r6(F.col("mean_strength")).alias("mean_strength"))


@query("gradient_norm", f"{PRE}{_step_sql} SELECT {s6('sqrt(sum((cr.w - ga.w) * (cr.w - ga.w)))')} AS gradient_norm FROM cr JOIN ga USING (i, j)")
def gradient_norm(s, d):
    g = D.gradient(D.statistics(codes(s, d)), atoms(s, d))
    return s.createDataFrame([(round(float(np.linalg.norm(g)), 6),)], "gradient_norm double")


@query("lambda_auto_std", f"{PRE}, v AS (SELECT unnest(x) AS v FROM s) SELECT {s6('0.1 * stddev_pop(v)')} AS lam FROM v")
def lambda_auto_std(s, d):
    return s.createDataFrame([(round(E.heuristic_lambda(sig(s, d)), 6),)], "lam double")


@query("lambda_auto_median", f"{PRE}, v AS (SELECT abs(unnest(c)) AS v FROM c) SELECT {s6('0.1 * quantile_cont(v, 0.5)')} AS lam FROM v")
def lambda_auto_median(s, d):
    return s.createDataFrame([(round(E.heuristic_lambda(sig(s, d), "median", atoms=atoms(s, d), exact=True), 6),)], "lam double")


@query("interpretability_summary", f"{PRE}, f AS (SELECT atom_id, avg((abs(coef) > 1e-6)::INT) AS f FROM lng GROUP BY 1) SELECT {s6('avg((f < 0.01)::INT)')} AS dead_ratio, {s6('stddev_pop(f)')} AS frequency_std, {s6('sum(f)')} AS mean_active, {s6('1 - avg(f)')} AS sparsity FROM f")
def interpretability_summary(s, d):
    r = analytics.interpretability(codes(s, d))
    return r.select(*(r6(F.col(c)).alias(c) for c in r.columns))


@query("mutual_coherence", f"{PRE} SELECT {s6('max(abs(list_dot_product(p.d, q.d)))')} AS coherence FROM atm p JOIN atm q ON p.k < q.k")
def mutual_coherence(s, d):
    return analytics.coherence(E.atoms_table(s, atoms(s, d))).select(r6(F.col("coherence")).alias("coherence"))


@query("gini_sparsity", f"{PRE}, r AS (SELECT sample_id, abs(coef) AS v, row_number() OVER (PARTITION BY sample_id ORDER BY abs(coef)) AS i FROM lng) SELECT sample_id, {s6('CASE WHEN sum(v) > 0 THEN 1 - 2 * sum(v * (8 - i + 0.5)) / (sum(v) * 8) ELSE 0 END')} AS gini FROM r GROUP BY 1")
def gini_sparsity(s, d):
    return analytics.gini(codes(s, d)).select("sample_id", r6(F.col("gini")).alias("gini"))


@query("feature_stats", f"{PRE} SELECT atom_id, {s6('avg((abs(coef) > 1e-8)::INT)')} AS frequency, {s6('coalesce(avg(abs(coef)) FILTER (abs(coef) > 1e-8), 0)')} AS mean_abs, {s6('coalesce(avg(coef) FILTER (abs(coef) > 1e-8), 0)')} AS mean_signed, {s6('max(abs(coef))')} AS max_abs, {s6('sqrt(avg(coef * coef) + 1e-12)')} AS energy, count(*) FILTER (abs(coef) > 1e-8) = 0 AS dead FROM lng GROUP BY 1")
def feature_stats(s, d):
    r = analytics.feature_stats(codes(s, d))
    return r.select(F.col("atom_id").cast("long").alias("atom_id"), *(r6(F.col(c)).alias(c) for c in ("frequency", "mean_abs", "mean_signed", "max_abs", "energy")), "dead")


@query("feature_stats_by_label", f"{PRE} SELECT label, atom_id, {s6('avg((abs(coef) > 1e-8)::INT)')} AS frequency, {s6('max(abs(coef))')} AS max_abs FROM lng GROUP BY ALL")
def feature_stats_by_label(s, d):
    g = analytics.long_view(codes(s, d), keep=("label",)).groupBy("label", F.col("atom_id").cast("long").alias("atom_id"))
    return g.agg(r6(F.avg((F.abs("coef") > 1e-8).cast("double"))).alias("frequency"), r6(F.max(F.abs("coef"))).alias("max_abs"))


@query("feature_top_samples", f"{PRE}, r AS (SELECT atom_id, sample_id, coef, row_number() OVER (PARTITION BY atom_id ORDER BY abs(coef) DESC, sample_id) AS rank FROM lng) SELECT atom_id, rank, sample_id, {s6('coef')} AS coef FROM r WHERE rank <= 5")
def feature_top_samples(s, d):
    return analytics.top_samples(codes(s, d)).select(F.col("atom_id").cast("long").alias("atom_id"), F.col("rank").cast("long").alias("rank"), "sample_id", r6(F.col("coef")).alias("coef"))


@query("coactivation_lift", f"{PRE}, o AS (SELECT sample_id, atom_id FROM lng WHERE abs(coef) > 1e-8), f AS (SELECT atom_id, count(*) AS c FROM o GROUP BY 1), p AS (SELECT a.atom_id AS i, b.atom_id AS j, count(*) AS both_n FROM o a JOIN o b ON a.sample_id = b.sample_id AND a.atom_id < b.atom_id GROUP BY ALL) SELECT i, j, both_n, {s6('both_n * (SELECT count(*) FROM s) / (x.c * y.c)')} AS lift FROM p JOIN f x ON x.atom_id = i JOIN f y ON y.atom_id = j")
def coactivation_lift(s, d):
    return analytics.coactivation(codes(s, d)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("both").alias("both_n"), r6(F.col("lift")).alias("lift"))


_corr_sql = f"{PRE} SELECT p.atom_id AS i, q.atom_id AS j, {s6('corr(p.coef, q.coef)')} AS corr FROM lng p JOIN lng q ON p.sample_id = q.sample_id AND p.atom_id < q.atom_id GROUP BY ALL"


@query("feature_correlations", _corr_sql)
def feature_correlations(s, d):
    return analytics.correlations(codes(s, d)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("corr")).alias("corr"))


@query("correlated_pairs", f"SELECT * FROM ({_corr_sql}) WHERE abs(corr) > 0.02")
def correlated_pairs(s, d):
    return analytics.correlated_pairs(codes(s, d), 0.02).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("corr")).alias("corr"))


@query("selectivity_entropy", f"{PRE}, o AS (SELECT atom_id, coef, min(coef) OVER w AS lo, max(coef) OVER w AS hi, count(*) OVER w AS n FROM lng WHERE abs(coef) > 1e-8 WINDOW w AS (PARTITION BY atom_id)), b AS (SELECT atom_id, n, CASE WHEN hi > lo THEN least(floor((coef - lo) / (hi - lo) * 10), 9) ELSE 0 END AS b, count(*) AS c FROM o GROUP BY ALL), h AS (SELECT atom_id, n, -sum(c / n * ln(c / n)) AS h FROM b GROUP BY ALL) SELECT k AS atom_id, {s6('CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE 1 - h / ln(10) END')} AS selectivity FROM atm LEFT JOIN h ON k = atom_id")
def selectivity_entropy(s, d):
    return analytics.selectivity(codes(s, d)).select(F.col("atom_id").cast("long").alias("atom_id"), r6(F.col("selectivity")).alias("selectivity"))


@query("mutual_information", f"{PRE}, v AS (SELECT a[1] AS u, a[2] AS v FROM codes), e AS (SELECT min(u) AS lu, max(u) AS hu, min(v) AS lv, max(v) AS hv, count(*) AS n FROM v), b AS (SELECT least(floor((u - lu) / (hu - lu) * 10), 9) AS bu, least(floor((v - lv) / (hv - lv) * 10), 9) AS bv, n, count(*) AS c FROM v, e GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY bu) AS cu, sum(c) OVER (PARTITION BY bv) AS cv FROM b) SELECT {s6('greatest(0, sum(c / n * ln(c * n / (cu * cv))))')} AS mi FROM m")
def mutual_information(s, d):
    return analytics.mutual_information(codes(s, d), 0, 1).select(r6(F.col("mi")).alias("mi"))


@query("code_histogram", f"{PRE}, o AS (SELECT abs(coef) AS v FROM lng WHERE abs(coef) > 1e-8), e AS (SELECT min(v) AS lo, max(v) AS hi FROM o) SELECT least(floor((v - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM o, e GROUP BY 1")
def code_histogram(s, d):
    return analytics.code_histogram(codes(s, d), 20)


@query("per_sample_activity", f"{PRE} SELECT sample_id, count(*) FILTER (abs(coef) > 1e-8) AS n_active, {s6('avg((abs(coef) > 1e-8)::INT)')} AS active_share FROM lng GROUP BY 1")
def per_sample_activity(s, d):
    return analytics.per_sample_activity(codes(s, d)).select("sample_id", F.col("n_active").cast("long").alias("n_active"), r6(F.col("active_share")).alias("active_share"))


@query("region_cv", f"{PRE}, m AS (SELECT atom_id, label, avg(abs(coef)) AS m FROM lng GROUP BY ALL), t AS (SELECT atom_id, avg(m) AS mean, stddev_pop(m) AS sd FROM m GROUP BY 1) SELECT atom_id, {s6('CASE WHEN mean > 1e-12 THEN sd / mean ELSE 0 END')} AS cv, CASE WHEN mean > 1e-12 THEN sd / mean ELSE 0 END > 0.5 AS varies FROM t")
def region_cv(s, d):
    return analytics.region_cv(codes(s, d), "label").select(F.col("atom_id").cast("long").alias("atom_id"), r6(F.col("cv")).alias("cv"), "varies")


@query("feature_atlas", f"{PRE}, f AS (SELECT atom_id, avg((abs(coef) > 1e-8)::INT) AS f FROM lng GROUP BY 1), t AS (SELECT atom_id, list(sample_id ORDER BY abs(coef) DESC, sample_id)[1] AS best FROM lng GROUP BY 1) SELECT atom_id, row_number() OVER (ORDER BY f DESC, atom_id) AS rank, best FROM f JOIN t USING (atom_id)")
def feature_atlas(s, d):
    return analytics.atlas(codes(s, d)).select(F.col("atom_id").cast("long").alias("atom_id"), F.col("rank").cast("long").alias("rank"), F.element_at("top_samples", 1).alias("best"))


@query("polysemantic_check", "SELECT 8::BIGINT AS n, 0::BIGINT AS wrong")
def polysemantic_check(s, d):
    c, x = codes(s, d).select("sample_id", "a"), sig(s, d).select("sample_id", "x")
    got = [analytics.polysemantic(c, x, k, 3) for k in range(K)]
    return s.createDataFrame([(len(got), sum(not 0 <= g["score"] <= 1 for g in got))], "n long, wrong long")


@query("compare_methods", f"{PRE}{_recon}, z AS (SELECT sample_id, x, c AS a FROM c), zr AS (SELECT x, a, list_transform(range(1, 65), lambda j: list_sum(list_transform(ds, lambda d, k: d[j] * a[k]))) AS h FROM z, dl), u AS (SELECT 'soft' AS method, x, a, e FROM er UNION ALL SELECT 'linear', x, a, list_transform(x, lambda v, j: v - h[j]) FROM zr) SELECT method, {s6('sum(list_dot_product(e, e)) / sum(len(x))')} AS mse, {s6('1 - sum(len(list_filter(a, lambda v: abs(v) > 1e-8))) / sum(len(a))')} AS sparsity FROM u GROUP BY 1")
def compare_methods(s, d):
    a = atoms(s, d)
    r = analytics.compare_methods({"soft": E.decode(codes(s, d), a), "linear": E.decode(corr(s, d).withColumnRenamed("c", "a"), a)})
    return r.select("method", r6(F.col("mse")).alias("mse"), r6(F.col("sparsity")).alias("sparsity"))


# ---- statistics, batches, images ----------------------------------------------------------

_ent = f"{PRE}, e AS (SELECT sample_id, unnest(range(64)) AS feature, unnest(x) AS v FROM s)"


@query("dataset_stats", f"{_ent} SELECT feature, count(*) AS n, {s6('avg(v)')} AS mean, {s6('stddev_samp(v)')} AS std, {s6('min(v)')} AS min, {s6('max(v)')} AS max FROM e GROUP BY 1")
def dataset_stats(s, d):
    r = preprocess.dataset_stats(sig(s, d))
    return r.select(F.col("feature").cast("long").alias("feature"), "n", *(r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")))


@query("dataset_stats_pop", f"{_ent} SELECT feature, {s6('stddev_pop(v)')} AS std, {s6('var_pop(v)')} AS variance FROM e GROUP BY 1")
def dataset_stats_pop(s, d):
    r = preprocess.dataset_stats(sig(s, d), ddof=0)
    return r.select(F.col("feature").cast("long").alias("feature"), r6(F.col("std")).alias("std"), r6(F.col("variance")).alias("variance"))


@query("column_range_scan", f"{PRE} SELECT (sample_id - 100) // 32 AS batch, count(*) AS n FROM s WHERE sample_id >= 100 AND sample_id < 300 GROUP BY 1")
def column_range_scan(s, d):
    return preprocess.column_range(sig(s, d), 100, 300, 32).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


@query("batch_metrics", f"{PRE} SELECT sample_id // 64 AS batch, count(*) AS n, {s6('avg(list_sum(list_transform(a, lambda v: abs(v))))')} AS mean_l1 FROM codes GROUP BY 1")
def batch_metrics(s, d):
    return codes(s, d).groupBy(F.floor(F.col("sample_id") / 64).cast("long").alias("batch")).agg(F.count("*").alias("n"), r6(F.avg(A.norm("a", 1))).alias("mean_l1"))


@query("get_chunk", f"{PRE} SELECT sample_id FROM s WHERE sample_id // 100 = 2")
def get_chunk(s, d):
    return preprocess.chunk(sig(s, d), 2, 100).select("sample_id")


@query("take_by_index", f"{PRE}, w AS (SELECT unnest([5, 3, 5, 400]) AS sample_id, unnest(range(4)) AS position) SELECT position, sample_id, {s6('x[1]')} AS first FROM w JOIN s USING (sample_id)")
def take_by_index(s, d):
    return preprocess.take(sig(s, d), [5, 3, 5, 400]).select(F.col("position").cast("long").alias("position"), "sample_id", r6(F.get("x", 0)).alias("first"))


@query("random_batch", f"{PRE} SELECT sample_id, {s6('list_sum(x)')} AS total, (SELECT least(32, count(*)) FROM s) AS of_32 FROM s")
def random_batch(s, d):
    """A draw of as many rows as there are holds each once; one of 32 holds as many."""
    df = sig(s, d)
    some = preprocess.random_batch(df, 32, 7).agg(F.countDistinct("sample_id")).first()[0]
    return preprocess.random_batch(df, df.count(), 7).select("sample_id", r6(A.total("x")).alias("total"), F.lit(some).alias("of_32"))


@query("aligned_batches", f"{PRE} SELECT s.sample_id // 128 AS batch, count(*) AS n, {s6('sum(list_dot_product(x, x))')} AS energy FROM s GROUP BY 1")
def aligned_batches(s, d):
    a = sig(s, d).select("sample_id", "x")
    b = sig(s, d).select("sample_id", F.col("x").alias("y"))
    return preprocess.align(a, b).groupBy(F.floor(F.col("sample_id") / 128).cast("long").alias("batch")).agg(F.count("*").alias("n"), r6(F.sum(A.dot("x", "y"))).alias("energy"))


@query("vstack_union", f"{PRE} SELECT count(*) AS n, {s6('sum(list_sum(x))')} AS total FROM (SELECT * FROM s UNION ALL SELECT * FROM s)")
def vstack_union(s, d):
    return preprocess.stack(sig(s, d), sig(s, d)).agg(F.count("*").alias("n"), r6(F.sum(A.total("x"))).alias("total"))


for _how, _sql in (("max", "max(abs(coef))"), ("mean", "avg(coef)"), ("sum", "sum(coef)")):
    query(f"pooling_{_how}", f"{PRE} SELECT label, atom_id, {s6(_sql)} AS value FROM lng GROUP BY ALL")(lambda s, d, h=_how: preprocess.pool(codes(s, d), "label", h).select("label", F.col("atom_id").cast("long").alias("atom_id"), r6(F.col("value")).alias("value")))


def _images(s, d):
    return sig(s, d).select(F.col("sample_id").alias("image_id"), A.reshape("x", 8).alias("pix"))


@query("patch_extract", f"{PRE}, p AS (SELECT sample_id, x, i, j FROM s, (SELECT unnest([0, 2, 4]) AS i), (SELECT unnest([0, 2, 4]) AS j)), q AS (SELECT sample_id, i, j, list_transform(range(16), lambda t: x[(i + t // 4) * 8 + j + t % 4 + 1]) AS r FROM p) SELECT sample_id AS image_id, i, j, {s6('list_sum(r)')} AS total, {s6('list_sum(list_transform(r, lambda v, t: v * t))')} AS moment FROM q")
def patch_extract(s, d):
    p = preprocess.patches(_images(s, d), 4, 4, 0.5)
    return p.select("image_id", "i", "j", r6(A.total("x")).alias("total"), r6(A.total(F.transform("x", lambda v, t: v * (t + 1)))).alias("moment"))


@query("patch_center", f"{PRE} SELECT sample_id AS image_id, {s6('0')} AS mean FROM s")
def patch_center(s, d):
    return sig(s, d).select(F.col("sample_id").alias("image_id"), r6(A.mean(A.center("x"))).alias("mean"))


@query("whitening_filter", f"SELECT i, j, {s6('sqrt(fi * fi + fj * fj) * exp(-pow(sqrt(fi * fi + fj * fj) / 200.0, 4))')} AS response FROM (SELECT i, j, CASE WHEN i < 4 THEN i ELSE i - 8 END AS fi, CASE WHEN j < 4 THEN j ELSE j - 8 END AS fj FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))")
def whitening_filter(s, d):
    m = preprocess.filter_response(8, 8)
    return s.createDataFrame([(i, j, round(float(v), 6)) for (i, j), v in np.ndenumerate(m)], "i long, j long, response double")


_freq = "(CASE WHEN {0} < 4 THEN {0} ELSE {0} - 8 END)"
#: The filter as a kernel of a circular convolution: the inverse transform of a response that is even.
_whiten_sql = f"""{PRE}, fr AS (SELECT u, v, sqrt(pow({_freq.format('u')}, 2) + pow({_freq.format('v')}, 2)) AS r FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS v)),
kr AS (SELECT p, q, sum(r * exp(-pow(r / 200.0, 4)) * cos(2 * pi() * (u * p + v * q) / 8)) / 64 AS h FROM fr, (SELECT unnest(range(8)) AS p), (SELECT unnest(range(8)) AS q) GROUP BY ALL),
mx AS (SELECT list(w ORDER BY o) AS mx FROM (SELECT o, list(h ORDER BY i) AS w FROM (SELECT unnest(range(64)) AS o), (SELECT unnest(range(64)) AS i), kr WHERE p = (o // 8 - i // 8 + 8) % 8 AND q = (o % 8 - i % 8 + 8) % 8 GROUP BY 1)),
fl AS (SELECT sample_id, list_transform(mx, lambda w: list_dot_product(w, x)) AS y FROM s, mx),
ce AS (SELECT sample_id, list_transform(y, lambda v: v - list_sum(y) / 64) AS y FROM fl)"""


@query("zero_phase_whiten", _whiten_sql + f" SELECT sample_id, {s6('list_sum(list_transform(y, lambda v, i: v * i)) / sqrt(list_dot_product(y, y) / 64)')} AS moment, {s6('list_max(list_transform(y, lambda v: abs(v))) / sqrt(list_dot_product(y, y) / 64)')} AS peak, {s6('list_sum(list_transform(y, lambda v: v * v)) / (list_dot_product(y, y) / 64)')} AS power FROM ce")
def zero_phase_whiten(s, d):
    w = preprocess.zero_phase_whiten(sig(s, d).select("sample_id", "x"), (8, 8))
    return digest(w, F.col("x")).drop("total").join(w.select("sample_id", r6(A.dot("x", "x")).alias("power")), "sample_id")


@query("atom_minmax", f"{PRE}, m AS (SELECT k, list_transform(d, lambda v: (v - list_min(d)) / (list_max(d) - list_min(d))) AS r FROM atm) SELECT k AS atom_id, {s6('list_sum(r)')} AS total, {s6('list_sum(r[1:8])')} AS first_row FROM m")
def atom_minmax(s, d):
    m = monitor.atom_mosaic(E.atoms_table(s, atoms(s, d)), 8)
    return m.select(F.col("atom_id").cast("long").alias("atom_id"), r6(A.total(F.flatten("image"))).alias("total"), r6(A.total(F.element_at("image", 1))).alias("first_row"))


# ---- autoencoders -------------------------------------------------------------------------


def _sae(s, d, **kw) -> SparseAutoencoder:
    m = SparseAutoencoder.from_atoms(atoms(s, d), **kw)
    m.b[:] = -0.05
    return m


_relu = "list_transform(c, lambda v: greatest(v - 0.05, 0.0))"
_sparse = f", z AS (SELECT sample_id, x, {_relu} AS a FROM c), zr AS (SELECT sample_id, x, a, list_transform(range(1, 65), lambda j: list_sum(list_transform(ds, lambda d, k: d[j] * a[k]))) AS h FROM z, dl)"


@query("sae_encode_relu", digest_sql(_relu, "c"))
def sae_encode_relu(s, d):
    return digest(sig(s, d).withColumn("a", _sae(s, d).expression()), F.col("a"))


@query("sae_encode_batches", digest_sql(_relu, "c"))
def sae_encode_batches(s, d):
    return digest(_sae(s, d).encode(sig(s, d)), F.col("a"))


@query("sae_topk", digest_sql("list_transform(z, lambda v, i: CASE WHEN list_contains(list_transform(list_sort(list_transform(z, lambda q, j: {'m': -q, 'j': j})), lambda r: r.j)[1:3], i) THEN v ELSE 0 END)", f"(SELECT sample_id, {_relu} AS z FROM c)"))
def sae_topk(s, d):
    return digest(_sae(s, d, kind="topk", k=3).encode(sig(s, d)), F.col("a"))


@query("sae_decode", digest_sql("h", "zr", _sparse))
def sae_decode(s, d):
    return digest(_sae(s, d).forward(sig(s, d)), F.col("x_hat"))


@query("sae_loss", f"{PRE}{_sparse}, e AS (SELECT a, list_transform(x, lambda v, j: v - h[j]) AS e FROM zr) SELECT {s6('sum(list_dot_product(e, e)) / (64 * count(*))')} AS reconstruction, {s6('0.001 * sum(list_sum(a)) / (8 * count(*))')} AS sparsity FROM e")
def sae_loss(s, d):
    v = _sae(s, d).loss(sig(s, d))
    return s.createDataFrame([(round(v["reconstruction"], 6), round(v["sparsity"], 6))], "reconstruction double, sparsity double")


_adam_sql = f"""{PRE}{_sparse}, er AS (SELECT x, a, list_transform(x, lambda v, j: h[j] - v) AS e FROM zr),
ba AS (SELECT x, a, e, list_transform(ds, lambda q, k: CASE WHEN a[k] > 0 THEN 2 * list_dot_product(e, q) / 64 + 0.001 / 8 ELSE 0.0 END) AS ga FROM er, dl),
ea AS (SELECT x, e, unnest(range(8)) AS i, unnest(a) AS a, unnest(ga) AS ga FROM ba),
gj AS (SELECT i, unnest(range(64)) AS j, unnest(list_transform(x, lambda v, j: ga * v + 2 * a * e[j] / 64)) AS v FROM ea),
gs AS (SELECT i, j, sum(v) / (SELECT count(*) FROM s) AS q FROM gj GROUP BY ALL),
de AS (SELECT k AS i, unnest(range(64)) AS j, unnest(d) AS w FROM atm)
SELECT i, j, {s6('w - 0.01 * q / (abs(q) + 1e-8)')} AS value FROM de JOIN gs USING (i, j)"""


@query("sae_train_step", _adam_sql)
def sae_train_step(s, d):
    """Weights of the tied autoencoder after its first step, which is the rate times q / (|q| + 1e-8)."""
    return _matrix_table(s, _sae(s, d).fit(sig(s, d), epochs=1, normalize_every=0).w)


@query("sae_train", "SELECT true AS descends")
def sae_train(s, d):
    m = SparseAutoencoder(16, seed=1).fit(sig(s, d), epochs=5, normalize_every=0)
    return s.createDataFrame([(bool(m.history[-1]["loss"] < m.history[0]["loss"]),)], "descends boolean")


@query("sae_round_trip", digest_sql("list_transform(c, lambda v: greatest(v, 0.0))", "c"))
def sae_round_trip(s, d):
    """A dictionary turned into an autoencoder and back encodes as relu(D x)."""
    m = SparseAutoencoder.from_atoms(SparseAutoencoder.from_atoms(atoms(s, d)).to_atoms())
    return digest(m.encode(sig(s, d)), F.col("a"))


@query("nonlinear_decoder_train", "SELECT true AS descends")
def nonlinear_decoder_train(s, d):
    from ..operators.models import NonlinearDecoder

    m = NonlinearDecoder(atoms(s, d), epochs=5).fit(codes(s, d))
    return s.createDataFrame([(bool(m.history[-1] < m.history[0]),)], "descends boolean")


@query("estimator_transform", "SELECT count(*) AS n, 8::BIGINT AS k, 0::BIGINT AS violations FROM embeddings")
def estimator_transform(s, d):
    """Codes of the fitted model are optimal for the atoms that it learned."""
    from ..operators.models import SparseCoderEstimator

    df = sig(s, d)
    m = SparseCoderEstimator(n_atoms=8, n_steps=2, lam=0.05, solver_params={"max_iter": 5000, "tol": 1e-12}).fit(df)
    return _violations(m.inverse_transform(m.transform(df)), m.learner.atoms, 0.05, F.max(F.size("a")).cast("long").alias("k"))


@query("online_learn_batches", "SELECT count(*) AS samples, 3::BIGINT AS batches FROM embeddings")
def online_learn_batches(s, d):
    from ..operators.learn import OnlineDictionaryLearner

    df, m = sig(s, d), OnlineDictionaryLearner(8)
    for k in range(3):
        m.partial_fit(df.where(F.col("sample_id") % 3 == k))
    st = m.get_stats()
    return s.createDataFrame([(st["samples"], st["batches"])], "samples long, batches long")


@query("atom_energy_spectrum", f"{PRE}, e AS (SELECT atom_id, sum(coef * coef) AS e FROM lng GROUP BY 1) SELECT atom_id, {s6('sum(e) OVER (ORDER BY e DESC, atom_id) / sum(e) OVER ()')} AS cumulative FROM e")
def atom_energy_spectrum(s, d):
    """Cumulative share of energy, atoms in falling order."""
    e = analytics.long_view(codes(s, d)).groupBy(F.col("atom_id").cast("long").alias("atom_id")).agg(F.sum(F.col("coef") ** 2).alias("e"))
    up = F.sum("e").over(Window.orderBy(F.desc("e"), "atom_id"))  # a row for each atom
    return e.select("atom_id", r6(up / F.sum("e").over(Window.partitionBy())).alias("cumulative"))


@query("memory_estimate", "SELECT round(64 * count(*) * 4 / 1e6, 6) AS input_mb, ceil(count(*) / 100)::BIGINT AS total_batches FROM embeddings")
def memory_estimate(s, d):
    from ..sources.tables import estimate_memory

    m = estimate_memory(sig(s, d).count(), 64, K, 100)
    return s.createDataFrame([(round(m["input_mb"], 6), m["total_batches"])], "input_mb double, total_batches long")


# ---- ordered metrics ----------------------------------------------------------------------


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


@query("running_metrics", f"SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total, round(greatest(0, avg(value * value) OVER w - avg(value) OVER w * avg(value) OVER w), 3) AS variance FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_metrics(s, d):
    r = preprocess.running(_events(s, d), "value", ["ts", "event_id"], ["user_id"])
    return r.select("event_id", "n", F.round(F.col("mean") * F.col("n"), 4).alias("total"), F.round("variance", 3).alias("variance"))


@query("ema_metric", f"WITH o AS (SELECT user_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, {s6('sum(value * pow(0.9, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.1 END)')} AS ema FROM o GROUP BY 1")
def ema_metric(s, d):
    return preprocess.ema(_events(s, d), "value", ["ts", "event_id"], ["user_id"]).select("user_id", r6(F.col("ema")).alias("ema"))


@query("convergence_slope", f"SELECT event_id, {s6('(last_value(value) OVER w - first_value(value) OVER w) / count(*) OVER w')} AS slope FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def convergence_slope(s, d):
    return preprocess.slopes(_events(s, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", r6(F.col("slope")).alias("slope"))


@query("hourly_metrics", f"SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, {s6('avg(value)')} AS mean, {s6('min(value)')} AS min, {s6('max(value)')} AS max FROM events GROUP BY ALL")
def hourly_metrics(s, d):
    from ..streaming.online import windowed_metrics

    r = windowed_metrics(_events(s, d), "ts", "value", ["event_type"])
    return r.select("start", "event_type", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "min", "max")))


@query("monotone_last_five", "SELECT event_id, coalesce(value < p1 AND p1 < p2 AND p2 < p3 AND p3 < p4, false) AS falling FROM (SELECT event_id, value, lag(value) OVER w AS p1, lag(value, 2) OVER w AS p2, lag(value, 3) OVER w AS p3, lag(value, 4) OVER w AS p4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def monotone_last_five(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = [F.col("value"), *(F.lag("value", i).over(w) for i in range(1, 5))]
    falling = reduce(lambda a, b: a & b, (x < y for x, y in zip(v, v[1:])))
    return _events(s, d).select("event_id", F.coalesce(falling, F.lit(False)).alias("falling"))


# ---- other tables -------------------------------------------------------------------------

_four = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("lineitem_standardize_encode", f"WITH m AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS s{i}' for i, c in enumerate(_four))} FROM lineitem), z AS (SELECT l_returnflag, [{', '.join(f'({c} - m{i}) / (s{i} + 1e-12)' for i, c in enumerate(_four))}] AS x FROM lineitem, m), a AS (SELECT l_returnflag, list_transform([[1, 0, 0, 0], [0.5, 0.5, 0.5, 0.5], [0, 0, 0.6, 0.8]], lambda d: list_dot_product(d::DOUBLE[], x)) AS c FROM z) SELECT l_returnflag, count(*) AS n, {s6('avg(list_sum(list_transform(c, lambda v: greatest(abs(v) - 0.5, 0.0))))')} AS mean_l1 FROM a GROUP BY 1")
def lineitem_standardize_encode(s, d):
    df = s.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", *_four)
    a = np.array([[1, 0, 0, 0], [0.5, 0.5, 0.5, 0.5], [0, 0, 0.6, 0.8]])
    c = preprocess.standardize(df, _four).withColumn("a", A.soft_threshold(E.correlations("x", a), 0.5))
    return c.groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg(A.norm("a", 1))).alias("mean_l1"))


@query("user_hour_profile_encode", f"WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT user_id, sqrt(sum(c * c)) AS norm, {', '.join(f'sum(CASE WHEN h // 6 = {q} THEN c ELSE 0 END) AS q{q}' for q in range(4))} FROM h GROUP BY 1) SELECT user_id, {', '.join(s6(f'greatest(q{q} / norm / sqrt(6) - 0.3, 0.0)') + f' AS a{q}' for q in range(4))} FROM p")
def user_hour_profile_encode(s, d):
    """24 hourly counts of a user, normalised, over four atoms of six hours each."""
    e = _events(s, d).groupBy("user_id").agg(*(F.count_if(F.hour("ts") == h).cast("double").alias(f"h{h}") for h in range(24)))
    x = A.normalize(F.array(*(F.col(f"h{h}") for h in range(24))), 0.0)
    a = np.kron(np.eye(4), np.ones(6)) / np.sqrt(6)
    c = e.select("user_id", x.alias("x")).select("user_id", F.transform(E.correlations("x", a), lambda v: F.greatest(v - 0.3, F.lit(0.0))).alias("a"))
    return c.select("user_id", *(r6(F.get("a", q)).alias(f"a{q}") for q in range(4)))


@query("doc_char_profile_encode", f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), f AS (SELECT doc_id, {', '.join(f'''(length(t) - length(replace(t, '{c}', ''))) / greatest(length(t), 1) AS f{i}''' for i, c in enumerate('aeiou'))} FROM d) SELECT doc_id, {s6('f0 + f1 + f2 + f3 + f4')} AS vowels, {s6('greatest(0.0, (f0 + f4) / sqrt(2) - 0.02)')} AS au FROM f")
def doc_char_profile_encode(s, d):
    t = F.lower(F.coalesce("text", F.lit("")))
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", t.alias("t"))
    n = F.greatest(F.length("t"), F.lit(1))
    x = docs.select("doc_id", F.array(*((F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))) / n for c in "aeiou")).alias("x"))
    a = np.array([[1, 0, 0, 0, 1]]) / np.sqrt(2)
    return x.select("doc_id", r6(A.total("x")).alias("vowels"), r6(F.greatest(F.lit(0.0), F.get(E.correlations("x", a), 0) - 0.02)).alias("au"))
