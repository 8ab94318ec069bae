import math

import numpy as np
import pytest

from netloom.functions import tails
from netloom.operators import communities as C
from netloom.operators import kernels as K


def rng(seed=0):
    return np.random.default_rng(seed)


def test_message_passing_converges_and_follows_relabelling():
    r = rng()
    w, p, c = r.normal(size=(6, 9)), np.eye(6), K.correlation(r.normal(size=(9, 20)))
    out, steps, change, *_ = K.panda(K.normalize(c), K.normalize(p), K.normalize(w))
    assert change < 0.001 and steps < 500 and np.isfinite(out).all()
    i, j = r.permutation(6), r.permutation(9)
    again, *_ = K.panda(K.normalize(c[np.ix_(j, j)]), K.normalize(p[np.ix_(i, i)]), K.normalize(w[np.ix_(i, j)]))
    assert np.allclose(again, out[np.ix_(i, j)])


def test_variances_of_covariances():
    x = np.array([[1, 2, 9], [3, 1, 7], [5, 12, 8]], float)
    assert np.allclose(K.var_s(x), [[4, 37, 1], [37, 342.25, 9.25], [1, 9.25, 0.25]])
    assert np.allclose(K.esq_s(x), [[16, 100, 1], [100, 1369, 0.25], [1, 0.25, 1]])


def test_dragon_inverse_and_empty_diagonal():
    r = rng(1)
    d = K.dragon(r.normal(size=(30, 4)), r.normal(size=(30, 5)))
    assert np.allclose(d["prec"] @ d["cov"], np.eye(9), atol=1e-8)
    assert not np.diag(d["ggm"]).any()
    assert d["risk_grid"].shape == (101, 101) and ((0 <= d["lambdas"]) & (d["lambdas"] <= 1)).all()


def test_cobra_with_a_constant_gives_the_whole_variance():
    r = rng(2)
    out = K.cobra(np.ones((12, 1)), r.normal(size=(20, 12)))
    qg = out["Q"].T @ out["G"]
    assert np.allclose(out["psi"][0], np.diag(qg @ qg.T))


def test_transitions():
    a = rng(3).normal(size=(4, 15))
    assert not K.transition_ols(a, a).any()
    assert np.allclose(K.transition_kabsch(a.T, a.T), np.eye(4))
    q, _ = np.linalg.qr(rng(4).normal(size=(4, 4)))
    q[:, 0] *= np.sign(np.linalg.det(q))
    assert np.allclose((a.T - a.T.mean(0)) @ K.transition_kabsch(a.T, a.T @ q), (a.T - a.T.mean(0)) @ q)
    assert np.isclose(np.linalg.det(K.transition_kabsch(a.T, a.T @ q)), 1)


@pytest.mark.parametrize("seed", range(3))
def test_perturbation_keeps_strengths(seed):
    w = rng(seed).random((5, 7))
    x = K.crane_bipartite(w, 0.2, 0.0, seed)
    assert np.allclose(x.sum(0), w.sum(0)) and np.allclose(x.sum(1), w.sum(1)) and not np.allclose(x, w)
    a = rng(seed).random((6, 6))
    a = (a + a.T) * (1 - np.eye(6))
    y = K.crane_unipartite(a, 0.2, seed)
    assert np.allclose(y.sum(0), a.sum(0)) and np.allclose(y, y.T) and not np.diag(y).any()


def test_tiger_keeps_support_and_signs():
    r = rng(5)
    prior = np.where(r.random((3, 12)) < 0.5, np.sign(r.normal(size=(3, 12))), 0)
    fit = K.tiger(r.normal(size=(12, 8)), prior)
    assert not fit["W"][prior.T == 0].any() and (fit["W"] * prior.T >= 0).all() and (fit["Z"] >= 0).all()


def test_clusters_and_scaling():
    x = np.r_[rng(6).normal(0, 0.1, (4, 2)), rng(7).normal(9, 0.1, (5, 2))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert K.complete_linkage(d, 2).tolist() == [1] * 4 + [2] * 5
    y = K.classical_scaling(d, 2)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d)


def test_louvain_finds_blocks():
    a = np.kron(np.eye(3), np.ones((4, 4))) - np.eye(12)
    k = a.sum(1)
    assert C.louvain(a - np.outer(k, k) / k.sum()).tolist() == [0] * 4 + [1] * 4 + [2] * 4


def test_tails_against_closed_forms():
    assert math.isclose(tails.normal_cdf(1.959963984540054), 0.975, rel_tol=1e-12)
    assert math.isclose(tails.t_two_sided(1.0, 1), 0.5, rel_tol=1e-10)
    assert math.isclose(tails.f_upper(4.0, 2, 10), (1 + 2 * 4 / 10) ** -5, rel_tol=1e-10)
    assert math.isclose(tails.hypergeometric_upper(2, 3, 7, 4), 1 - (35 + 3 * 35) / 210, rel_tol=1e-10)
    assert tails.rank_sum_greater([3, 4], [1, 2])[0] == 4


def test_enrichment_score_of_a_leading_set():
    order = np.arange(10)
    assert math.isclose(K.enrichment_score(order, order < 3, np.linspace(5, 1, 10)), 1.0)
