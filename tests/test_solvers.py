import numpy as np
import pytest

from sparsela.functions import penalties as P
from sparsela.operators import solvers as S
from sparsela.operators.encode import normalize_atoms

R = np.random.default_rng(42)
D = normalize_atoms(R.normal(size=(20, 32)))
A = np.where(R.random((15, 20)) < 0.2, R.normal(size=(15, 20)), 0)
X = A @ D + 0.01 * R.normal(size=(15, 32))


def kkt(a, lam):
    g = (X - a @ D) @ D.T
    on = np.abs(a) > 1e-9
    return np.abs(g - lam * np.sign(a))[on].max(initial=0), (np.abs(g)[~on].max(initial=0) - lam)


@pytest.mark.parametrize("kw", [{}, {"step": "backtracking"}, {"monotone": True}, {"restart": "gradient"}, {"restart": "function"}, {"restart": "periodic"}, {"accelerated": False}])
def test_proximal_gradient_is_optimal(kw):
    a = S.proximal_gradient(X, D, P.L1(0.05), max_iter=5000, tol=1e-12, **kw).a
    on, off = kkt(a, 0.05)
    assert on < 1e-6 and off < 1e-6


def test_coordinate_descent_agrees_and_takes_any_norm():
    a = S.coordinate_descent(X, D, P.L1(0.05), max_iter=2000, tol=1e-12).a
    np.testing.assert_allclose(a, S.fista(X, D, P.L1(0.05), max_iter=5000, tol=1e-13).a, atol=1e-6)
    d = D * R.uniform(0.5, 2, (20, 1))
    np.testing.assert_allclose(S.coordinate_descent(X, d, P.L1(0.05), 3000, 1e-13).a, S.fista(X, d, P.L1(0.05), max_iter=20000, tol=1e-13).a, atol=1e-5)


def test_signals_do_not_depend_on_their_batch():
    for solver, pen in ((S.fista, P.L1(0.05)), (S.ista, P.ElasticNet(0.05)), (S.coordinate_descent, P.L1(0.05)), (S.omp, None), (S.conjugate_gradient, P.Cauchy(0.05)), (S.gradient_descent, P.Cauchy(0.05))):
        whole = solver(X, D, pen).a
        parts = np.vstack([solver(X[i : i + 1], D, pen).a for i in range(len(X))])
        np.testing.assert_allclose(whole, parts, atol=1e-10)


def test_almost_no_penalty_is_least_squares():
    a = S.fista(X, D, P.L1(1e-10), max_iter=20000, tol=1e-14).a
    np.testing.assert_allclose(a, np.linalg.lstsq(D.T, X.T, rcond=None)[0].T, atol=1e-4)


def test_sparsity_rises_with_the_weight():
    n = [(np.abs(S.fista(X, D, P.L1(lam)).a) > 1e-9).sum() for lam in (0.01, 0.05, 0.2, 1.0)]
    assert n == sorted(n, reverse=True) and n[0] > n[-1]


@pytest.mark.parametrize("variant", ["standard", "weak", "stagewise", "regularized"])
def test_pursuit_is_orthogonal(variant):
    r = S.omp(X, D, n_atoms=4, variant=variant)
    assert ((r.a != 0).sum(1) <= 4).all()
    assert (np.abs((X - r.a @ D) @ D.T) * (r.a != 0)).max() < 1e-9


@pytest.mark.parametrize("beta", ["pr+", "fr", "dy", "hs", "steepest"])
def test_conjugate_gradient_reaches_the_ridge_solution(beta):
    r = S.conjugate_gradient(X, D, P.L2(0.1), max_iter=3000, tol=1e-9, beta=beta)
    np.testing.assert_allclose(r.a, np.linalg.solve(D @ D.T + 0.1 * np.eye(20), D @ X.T).T, atol=1e-5)


def test_edge_cases():
    zero = S.fista(np.zeros((2, 32)), D, P.L1(0.1))
    assert not zero.a.any() and zero.converged.all()
    assert S.omp(np.zeros((1, 32)), D).a.any() == False  # noqa: E712
    assert not S.fista(X, D, P.L1(1e6)).a.any()
    assert S.fista(X[:, :3], normalize_atoms(D[:1, :3]), P.L1(0.1)).a.shape == (15, 1)


def test_power_iteration_and_choice():
    assert abs(S.power_iteration(D, 5000, 1e-15) - S.lipschitz(D)) < 1e-6
    assert S.auto_solver(P.L1()) == "fista" and S.auto_solver(P.TopK()) == "fista"
    with pytest.raises(ValueError):
        S.get_solver("nothing")
    with pytest.raises(ValueError):
        S.conjugate_gradient(X, D, P.L1(0.1))
