import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparsela.functions import penalties as P

ALL = [P.L1(0.3), P.L2(0.3), P.ElasticNet(0.3), P.Cauchy(0.2), P.LogSum(0.05, 0.5), P.SCAD(0.3), P.Welsch(0.2), P.Huber(0.5, 0.7), P.TopK(k=2), P.GroupLasso(0.3, [[0, 1], [2, 3]]), P.NonNegativeL1(0.3)]
VECTOR = st.lists(st.floats(-5, 5), min_size=4, max_size=4)


@pytest.mark.parametrize("pen", ALL, ids=lambda p: type(p).__name__)
@given(z=VECTOR, u=VECTOR)
@settings(max_examples=60, deadline=None)
def test_prox_is_no_worse_than_other_points(pen, z, u):
    """prox minimises |v - z|^2 / 2 + t value(v): neither z, 0 nor any other point is clearly better."""
    z, u, t = np.array([z]), np.array([u]), 0.5
    f = lambda v: 0.5 * ((v - z) ** 2).sum() + t * pen.np_value(v)[0]
    best = f(pen.np_prox(z, t))
    if type(pen) in (P.Cauchy, P.Welsch, P.LogSum):  # stationary points of functions that are not convex
        assert best <= f(z) + 1e-6
    else:
        for v in (z, 0 * z, u):
            assert best <= f(v) + 1e-9


@pytest.mark.parametrize("pen", [P.L2(0.3), P.Cauchy(0.2), P.Welsch(0.2), P.Huber(0.5, 0.7), P.SCAD(0.3), P.ElasticNet(0.3), P.LogSum(0.05, 0.5)], ids=lambda p: type(p).__name__)
def test_gradient_is_the_slope_of_the_value(pen):
    a = np.array([[-2.0, -0.4, 0.25, 1.7]])
    h = 1e-6
    for i in range(4):
        e = np.zeros_like(a)
        e[0, i] = h
        assert abs((pen.np_value(a + e) - pen.np_value(a - e))[0] / (2 * h) - pen.np_grad(a)[0, i]) < 1e-5


@pytest.mark.parametrize(("x", "t", "want"), [(2, 0.5, 1.5), (-2, 0.5, -1.5), (0.3, 0.5, 0), (-0.5, 0.5, 0)])
def test_soft_threshold_values(x, t, want):
    assert P.L1(1.0).np_prox(np.array([[x]], float), t)[0, 0] == want


@pytest.mark.parametrize("pen", ALL, ids=lambda p: type(p).__name__)
def test_columns_agree_with_numpy(spark, pen):
    from pyspark.sql import functions as F

    z = np.round(np.random.default_rng(1).normal(size=(30, 4)) * 1.5, 3)
    z[0], z[1, 2] = 0, 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "i long, z array<double>")
    rows = df.select(F.col("i"), pen.prox("z", 0.5).alias("p"), pen.value("z").alias("v")).orderBy("i").collect()
    np.testing.assert_allclose([r["p"] for r in rows], pen.np_prox(z, 0.5), atol=1e-9)
    np.testing.assert_allclose([r["v"] for r in rows], pen.np_value(z), atol=1e-9)


def test_top_k_ties_keep_the_first():
    assert P.TopK(k=2).np_prox(np.array([[1.0, -1, 1, 0.5]])).tolist() == [[1, -1, 0, 0]]


def test_unknown_and_wrong_parameters():
    with pytest.raises(ValueError):
        P.create_penalty("nothing")
    with pytest.raises(ValueError):
        P.L1(-1)
    with pytest.raises(ValueError):
        P.Welsch(0.0)
