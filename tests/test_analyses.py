"""Whole methods against plain loops, small known cases and invariants."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.functions import stats, tails
from netloom.operators import communities as C
from netloom.operators import inference as I
from netloom.operators import kernels as K
from netloom.operators import modules as M
from netloom.operators import networks as N
from netloom.operators import preprocessing as P
from netloom.operators import subnetworks as S
from netloom.operators import tables as T
from netloom.sources import readers as R
from netloom.streaming.degrees import windowed_degrees


def rng(seed=0):
    return np.random.default_rng(seed)


def long_frame(spark, m, rows, cols, names):
    return spark.createDataFrame([(rows[i], cols[j], float(m[i, j])) for i in range(len(rows)) for j in range(len(cols))], names)


# --- message passing, descent, shrinkage: plain loops ------------------------------------


def loop_normalize(x):
    out = np.zeros_like(x)
    for i in range(x.shape[0]):
        for j in range(x.shape[1]):
            out[i, j] = ((x[i, j] - x[i].mean()) / x[i].std() + (x[i, j] - x[:, j].mean()) / x[:, j].std()) / math.sqrt(2)
    return out


def loop_similarity(x, y):
    out = np.zeros((len(x), y.shape[1]))
    for i in range(len(x)):
        for j in range(y.shape[1]):
            a = float(x[i] @ y[:, j])
            out[i, j] = a / math.sqrt(abs((x[i] ** 2).sum() + (y[:, j] ** 2).sum() - abs(a)))
    return out


def loop_diagonal(m, num, alpha, step):
    for i in range(len(m)):
        m[i, i] = np.delete(m[i], i).std() * num * math.exp(2 * alpha * step)


def test_message_passing_against_a_loop(spark):
    r = rng(11)
    tfs, genes = [f"t{i}" for i in range(4)], [f"g{i}" for i in range(6)]
    motif, expr = r.random((4, 6)), r.normal(size=(6, 9))
    ppi = r.random((4, 4))
    ppi = (ppi + ppi.T) / 2
    np.fill_diagonal(ppi, 1)
    w, p, c = loop_normalize(motif), loop_normalize(ppi), loop_normalize(np.corrcoef(expr))
    change, step = 1.0, 0
    while change > 0.001:
        ra = (loop_similarity(p, w) + loop_similarity(w, c)) / 2
        change = np.abs(w - ra).mean()
        w = 0.9 * w + 0.1 * ra
        if change > 0.001:
            new = loop_similarity(w, w.T)
            loop_diagonal(new, 4, 0.1, step)
            p = 0.9 * p + 0.1 * new
            new = loop_similarity(w.T, w)
            loop_diagonal(new, 6, 0.1, step)
            c = 0.9 * c + 0.1 * new
        step += 1
    m = long_frame(spark, motif, tfs, genes, "tf string, gene string, weight double")
    e = long_frame(spark, expr, genes, list(range(9)), "gene string, sample int, value double")
    q = long_frame(spark, ppi, tfs, tfs, "i string, j string, weight double")
    got = I.panda(e, m, q).toPandas().pivot(index="tf", columns="gene", values="score").to_numpy()
    assert np.allclose(got, w)
    out = I.puma(e, m, q, output=("regulatory", "cooperative", "coregulatory"))
    assert np.allclose(out["regulatory"].toPandas().pivot(index="tf", columns="gene", values="score").to_numpy(), w)
    assert np.allclose(out["cooperative"].toPandas().pivot(index="i", columns="j", values="score").to_numpy(), p)
    frozen = I.puma(e, m, q, mirs=["t1"], output=("cooperative",))["cooperative"].toPandas().pivot(index="i", columns="j", values="score").to_numpy()
    assert len({round(float(x), 9) for x in frozen[1, [0, 2, 3]]}) <= 3 and not np.allclose(frozen, p)
    for options in ({"correlate": "spearman"}, {"correlate": "kendall"}, {"by_presence": True}, {"randomize": "within"}, {"randomize": "by"}, {"samples": [0, 1, 2, 3]}):
        other = I.puma(e, m, q, **options).toPandas()
        assert np.isfinite(other["score"]).all() and not np.allclose(other.pivot(index="tf", columns="gene", values="score").to_numpy(), w)
    with pytest.raises(ValueError, match="randomize"):
        I.panda(e, m, q, randomize="x")
    with pytest.raises(ValueError, match="correlation"):
        I.panda(e, m, q, correlate="x")
    none = I.panda(e, None).toPandas()
    assert np.allclose(none.pivot(index="tf", columns="gene", values="score").to_numpy(), np.corrcoef(expr))
    with pytest.raises(ValueError, match="neither"):
        I.panda(None, None)
    full, less = I.lioness(e, m, q, start=2, end=3).toPandas(), I.lioness(e, m, q, samples=[1], output="gene_targeting").toPandas()
    assert set(full["sample"]) == {1, 2} and set(less["sample"]) == {1}
    sums = full[full["sample"] == 1].groupby("gene")["score"].sum()
    assert np.allclose(less.set_index("gene")["score"].sort_index(), sums.sort_index())


def test_message_passing_that_does_not_settle_is_an_error():
    r = rng(0)
    with pytest.raises(RuntimeError, match="settle"):
        K.panda(K.normalize(K.correlation(r.normal(size=(5, 9)))), K.normalize(r.random((3, 3))), K.normalize(r.random((3, 5))), rounds=2)


def test_rank_correlations_against_pairs():
    r = rng(5)
    x = np.round(r.normal(size=(4, 8)), 1)
    x[0, :3] = x[0, 0]
    tau = K.kendall_correlation(x)
    for a in range(4):
        for b in range(a):
            s = [(np.sign(x[a, i] - x[a, j]), np.sign(x[b, i] - x[b, j])) for i in range(8) for j in range(i)]
            d = math.sqrt(sum(u * u for u, _ in s) * sum(v * v for _, v in s))
            assert math.isclose(tau[a, b], sum(u * v for u, v in s) / d, abs_tol=1e-12)
    ranks = pd.DataFrame(x.T).rank()
    assert np.allclose(K.rank_correlation(x), ranks.corr())


def test_descent_against_a_loop():
    r = rng(6)
    w, p, c = r.random((3, 5)), r.random((3, 3)), K.correlation(r.normal(size=(5, 8)))
    p = p + p.T
    lam, gamma, eta = 0.035, 0.335, 1e-5
    x = w / np.sqrt((w * w).sum())
    a, b = -(1 - lam) * p / np.trace(p) + gamma * np.eye(3), -lam * c / np.trace(c)
    m, v = np.zeros((3, 5)), np.zeros((3, 5))
    for i in range(1, 61):
        g = x @ x.T @ x + a @ x + x @ b
        m, v = 0.9 * m + 0.4 * g, 0.999 * v + 0.016 * g * g
        lead, root = 1 - 0.9 ** (i + 1), math.sqrt(1 - 0.999 ** (i + 1))
        x = x - root / lead * eta * m / (1e-8 * root + np.sqrt(v))
    assert np.allclose(K.otter(w, p, c), x, atol=1e-12)


def test_shrinkage_against_loops_and_terms():
    r = rng(7)
    a, b = r.normal(size=(12, 3)), r.normal(size=(12, 2))
    x = np.hstack([a, b])
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    n = len(x)
    var, esq = np.zeros((5, 5)), np.zeros((5, 5))
    for i in range(5):
        for j in range(5):
            w = x[:, i] * x[:, j]
            var[i, j], esq[i, j] = n / (n - 1) ** 3 * ((w - w.mean()) ** 2).sum(), (n / (n - 1) * w.mean()) ** 2
    s = np.cov(x, rowvar=False)
    best = None
    for g1 in np.linspace(0, 1, 101):
        for g2 in np.linspace(0, 1, 101):
            l1, l2 = 1 - g1 * g1, 1 - g2 * g2
            risk = 0.0
            for i in range(5):
                for j in range(5):
                    if i == j:
                        continue
                    one, two = i < 3, j < 3
                    keep = 1 - l1 if one and two else 1 - l2 if not one and not two else g1 * g2
                    risk += keep * keep * var[i, j] + (1 - keep) ** 2 * (esq[i, j] - var[i, j])
            best = min(best or (risk, g1, g2), (risk, g1, g2))
    fit = K.dragon(a, b)
    assert np.allclose(np.diag(fit["cov"]), np.diag(s))
    assert fit["risk_grid"].shape == (101, 101) and ((fit["gammas"] >= 0) & (fit["gammas"] <= 1)).all()
    g = np.ones((5, 5))
    g[:3, :3], g[3:, 3:], g[:3, 3:], g[3:, :3] = fit["gammas"][0] ** 2, fit["gammas"][1] ** 2, fit["gammas"].prod(), fit["gammas"].prod()
    np.fill_diagonal(g, 1)
    assert np.allclose(fit["cov"], s * g) and K.gaussian_log_likelihood(fit["cov"], s, n) < 0
    assert math.isclose(K.gaussian_log_likelihood(np.eye(2), np.eye(2), 10), -5 * (2 * math.log(2 * math.pi) + 2))


def test_partial_correlations_are_shrunk_by_an_estimated_share(spark):
    r = rng(8)
    z = r.normal(size=400)
    x = np.array([z, z + 0.3 * r.normal(size=400), -z + 0.3 * r.normal(size=400), r.normal(size=400)])
    pc = K.shrunken_partial_correlation(x)
    exact = K.partial_correlation(np.linalg.inv(np.corrcoef(x)))
    assert np.allclose(pc[~np.eye(4, dtype=bool)], exact[~np.eye(4, dtype=bool)], atol=0.1) and np.allclose(np.diag(pc), 1)
    few = K.shrunken_partial_correlation(r.normal(size=(30, 5)))  # more genes than samples
    assert np.isfinite(few).all() and np.abs(few[~np.eye(30, dtype=bool)]).max() < 0.9
    names = ["a", "b", "c", "d"]
    e = long_frame(spark, x, names, list(range(400)), "gene string, sample int, value double")
    prior = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("a", "z", 1.0), ("q", "b", 1.0)], "tf string, gene string, weight double")
    got = {(t, g): w for t, g, w in I.signed_prior(e, prior).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 1e-6}


def test_covariates(spark):
    r = rng(9)
    e = r.normal(size=(6, 10))
    x = np.column_stack([np.ones(10), r.normal(size=10)])
    df = long_frame(spark, e, [f"g{i}" for i in range(6)], list(range(10)), "gene string, sample int, value double")
    design = pd.DataFrame(x, index=range(10))
    for method, kw in (("pearson", {}), ("pcorsh", {}), ("dragon", {"second": df.withColumn("gene", F.concat(F.lit("m"), "gene"))})):
        out = I.cobra(design, df, method, **kw)
        qg = out["Q"].T @ out["G"]
        hat = np.linalg.pinv(x.T @ x) @ x.T
        assert np.allclose(out["psi"], [np.diag(qg @ np.diag(10 * h) @ qg.T) for h in hat], atol=1e-8)
    with pytest.raises(ValueError, match="method"):
        I.cobra(design, df, "other")
    with pytest.raises(ValueError, match="second"):
        I.cobra(design, df, "dragon")


# --- transitions and perturbation ------------------------------------------------------------


def test_transitions_of_permuted_designs(spark, tmp_path):
    r = rng(12)
    genes = [f"g{i}" for i in range(8)]
    e = long_frame(spark, r.normal(size=(8, 12)), genes, list(range(12)), "gene string, sample int, value double")
    m = spark.createDataFrame([(t, g, float(r.random() < 0.5)) for t in ("g0", "g1", "t2") for g in genes], "tf string, gene string, weight double")
    design = {s: (None if s == 11 else s % 2) for s in range(12)}
    for network in ("bere", "pearson", "cd"):
        tm = I.monster_permuted(e, design, m, permutations=3, network=network, path=f"file://{tmp_path}/{network}").toPandas()
        assert sorted(tm["perm"].unique()) == [0, 1, 2, 3] and len(tm) == 4 * 9 and np.isfinite(tm["v"]).all()
        assert not tm[tm["tf_from"] == tm["tf_to"]]["v"].any()
    entries = I.monster_permuted(e, design, m, permutations=1, resample="entries", cutoff=0.5, remove_diagonal=False).toPandas()
    assert len(entries) == 18
    tm = spark.read.parquet(f"file://{tmp_path}/bere")
    assert T.transition_summary(tm, 8, (6, 5)).where("what = 'permutations'").first()["n"] == 3
    assert len(T.transition_heatmap(tm)) == 9 and len(T.transition_heatmap(tm, "euclidean")) == 9
    assert set(T.transition_components(tm)["node"]) == {"g0", "g1", "t2"}
    assert T.transition_network(tm, 2, 3).count() == 2
    for how in ("none", "significance", "magnitude"):
        assert T.involvement(tm, how).count() == 12
    for kw, what in (({"motif": None}, "motif"), ({"method": "x"}, "method"), ({"network": "x"}, "networks"), ({"design": {0: 0, 1: 1}}, "samples")):
        with pytest.raises(ValueError, match=what):
            I.monster_permuted(**{"expr": e, "design": design, "motif": m, "permutations": 1} | kw)
    assert I.check_expression(e.withColumn("value", F.col("value").cast("string"))).dtypes[2] == ("value", "double")
    with pytest.raises(ValueError, match="columns"):
        I.check_expression(e.drop("sample"))


def test_transitions_between_ready_networks(spark):
    r = rng(13)
    a = r.normal(size=(3, 20))
    names = [f"g{i}" for i in range(20)]
    one = long_frame(spark, a, ["x", "y", "z"], names, "tf string, gene string, score double")
    more = one.unionByName(spark.createDataFrame([("w", "g0", 1.0), ("x", "h", 1.0)], "tf string, gene string, score double"))
    tm = I.monster_networks(one, more, permutations=2).toPandas()
    assert set(tm["tf_from"]) == {"x", "y", "z"} and np.allclose(tm[tm["perm"] == 0]["v"], 0) and not np.allclose(tm[tm["perm"] == 1]["v"], 0)
    with pytest.raises(ValueError, match="common"):
        I.monster_networks(one, one.withColumn("gene", F.concat(F.lit("q"), "gene")), 1)


def test_row_wise_perturbation():
    r = rng(14)
    w = r.random((9, 12)) + 1
    for beta in (0.0, -0.01):
        x = K.crane_bipartite(w, 0.1, beta, 3)
        assert x is not None and not np.allclose(x, w)
        assert np.allclose(x.sum(), w.sum(), rtol=0.2)
        if not beta:
            assert np.allclose(x.sum(0), w.sum(0)) and np.allclose(x.sum(1), w.sum(1))
            assert x.min() > w.min() - 0.5 and x.max() < w.max() + 0.5
    a = w[:, :9] + w[:, :9].T
    kept = K.crane_unipartite(a, 0.05, 1, self_loops=True)
    assert np.allclose(kept.sum(0), a.sum(0)) and np.allclose(np.diag(kept), np.diag(a)) and np.allclose(kept, kept.T)
    s = r.normal(size=2000) * 50
    assert np.array_equal(K.jutter_degree(s, 0), s)
    wide, narrow = (K.jutter_degree(s, -1.0, sloped, 5) - s for sloped in (True, False))
    assert 0.9 < narrow.std() < 1.1 and wide[s > 50].std() > wide[s < -50].std() > 1.5


def test_replicates_of_differential_modules(spark):
    net, _ = M.simulate(spark, [(4, 6), (4, 6)], [[20, 3], [3, 20]], [(3, 3, 1.0)], 2)
    net = C.checkpoint_ready(N.merge_networks(N.dense(net, "a").withColumnRenamed("a", "score"), N.dense(net, "b").withColumnRenamed("b", "score")))
    out = I.alpaca_crane(net.withColumn("b", F.col("b") + 0.5), alpha=0.05, replicates=2).toPandas()
    assert set(out["side"]) == {"tf", "gene"} and np.isfinite(out["score"]).all() and ((out["p"].isna()) | out["p"].between(0, 1)).all()
    same = M.compare_modules(net.select("tf", "gene", F.col("a").alias("score")), net.select("tf", "gene", F.col("b").alias("score"))).toPandas()
    assert set(same["side"]) == {"tf", "gene"} and np.isfinite(same["score"]).all()


# --- communities -------------------------------------------------------------------------------


@pytest.mark.parametrize("method", sorted(C.SEEDS))
def test_seeds_find_blocks(spark, method):
    a = np.kron(np.eye(3), np.ones((4, 4))) - np.eye(12)
    k = a.sum(1)
    label = C.SEEDS[method](a - np.outer(k, k) / k.sum())
    assert len(set(label)) == 3 and all(len(set(label[i : i + 4])) == 1 for i in (0, 4, 8))
    edges = spark.createDataFrame([(f"r{i}", f"b{j}", 1.0) for i in range(6) for j in range(4) if i // 3 == j // 2] + [("r0", "b3", 1.0)], "red string, blue string, weight double")
    for project in (True, False) if method == "LCS" else (True,):
        red, blue, q = C.condor_cluster(edges, method=method, project=project)
        com = {x["node"]: x["com"] for x in red.unionByName(blue).collect()}
        assert com["b0"] == com["b1"] != com["b2"] == com["b3"] and com["r0"] == com["b0"] and com["r5"] == com["b3"]
    with pytest.raises(ValueError, match="method"):
        C.seed_communities(edges, "x")


def test_module_analyses(spark):
    e = [("t1", "g1"), ("t1", "g2"), ("t2", "g1"), ("t2", "g2"), ("t3", "g3"), ("t3", "g4"), ("t4", "g3"), ("t4", "g4"), ("t1", "g3")]
    net = spark.createDataFrame([(t, g, 1.0, 2.0) for t, g in e], "tf string, gene string, a double, b double")
    for method in ("condor", "louvain"):
        d = {(x.side, x.node): x.module for x in M.delta_modules(net, method).collect()}
        assert d["tf", "t1"] == d["gene", "g1"] != d["tf", "t4"] == d["gene", "g4"]
    assert M.rotation(net, "louvain").agg(F.max("deviation")).first()[0] == 0
    for wrong in (M.rotation, M.delta_modules):
        with pytest.raises(ValueError, match="condor or louvain"):
            wrong(net, "x").collect()
    run = M.condor_run(net.select("tf", "gene", F.col("a").alias("weight")), scores=True, method="FG").toPandas()
    assert run["node"].str.endswith(("_A", "_B")).all() and abs(run.groupby(["side", "com"])["q"].sum() - 0.5).max() < 1e-9
    with pytest.raises(ValueError, match="target"):
        M.members(net, "x")
    terms = spark.createDataFrame([("m", "s", 5, 0.001), ("m", "u", 2, 0.001), ("m", "v", 9, 0.9)], "module string, set string, overlap int, p double")
    assert [r.set for r in M.enriched_terms(terms).collect()] == ["s"]


def test_core_enrichment_and_node_ranks():
    q = pd.DataFrame({"node": list("abcdefghij"), "q": np.arange(10.0)})
    high, low = C.core_enrichment(list("ghij"), q, permutations=50, seed=1), C.core_enrichment(list("abcd"), q)
    assert high["ks_d"] == 1 and high["w"] == 24 and high["ks_p"] < 0.1 < low["ks_p"] and high["w_perm"] <= 0.1
    t = C.test_node_rank([f"n{i}" for i in range(40)], {"n0", "n1", "n2", "n3", "n30"})
    assert t["fisher_p"] < 0.001 and t["rank_sum_p"] < 0.05 and t["odds"] == float("inf")


# --- subnetworks -----------------------------------------------------------------------------------


def test_hop_errors_and_arguments(spark):
    df = spark.createDataFrame([("tf1", "A", 0.01), ("tf1", "B", 0.02), ("tf2", "A", 0.03)], "tf string, gene string, p double")
    nodes = lambda *x: spark.createDataFrame([(v,) for v in x], "node string")
    for start, out, from_tf, what in (
        (("x",), (), True, "Starting nodes do not"), (("A",), (), True, "Starting nodes do not"), (("tf1",), (), False, "Starting nodes do not"),
        (("A",), ("x",), False, "exclude does not"), (("A",), ("A",), False, "cannot overlap"),
    ):
        with pytest.raises(ValueError, match=what):
            S.breadth_first(df, nodes(*start), nodes(*out), from_tf)
    got = lambda *a, **k: {tuple(r) for r in S.breadth_first(df, *a, **k).collect()}
    assert got(nodes("A"), nodes(), False) == {("tf1", "A"), ("tf2", "A")}
    assert got(nodes("A"), nodes("tf1"), False) == {("tf2", "A")}
    assert got(nodes("tf1"), nodes("B"), True) == {("tf1", "A")}
    assert got(nodes("A"), nodes(), False, top=1) == {("tf1", "A")}
    net = df.select("tf", "gene", F.lit(1.0).alias("score"))
    null = net.select("score")
    for kw, what in (
        ({"seeds": "A"}, "Wrong input"), ({"networks": net}, "Wrong input"), ({"alpha": "x"}, "Wrong input"), ({"networks": [df]}, "columns"),
        ({"alpha": 0}, "between 0 and 1"), ({"hops": 1}, "even number"), ({"null": null.withColumn("score", F.lit("x"))}, "numeric"),
    ):
        with pytest.raises(ValueError, match=what):
            S.subnetwork(**{"seeds": ["A"], "networks": [net], "null": null} | kw)


def test_rank_sum_of_several_networks_against_brute_force(spark):
    r = random.Random(3)
    value = lambda: round(r.gauss(0, 1), 1)
    nets = [[(f"t{i}", f"g{j}", value() + i) for i in range(3) for j in range(5)] for _ in range(3)]
    null = [value() for _ in range(60)]
    frames = [spark.createDataFrame(n, "tf string, gene string, score double") for n in nets]
    got = {(t, g): p for t, g, p in S.p_values(S.combine(frames), spark.createDataFrame([(v,) for v in null], "score double")).collect()}
    for k, (t, g, _) in enumerate(nets[0]):
        assert math.isclose(got[t, g], tails.rank_sum_greater([n[k][2] for n in nets], null)[1], rel_tol=1e-9)


def test_orders_by_ranges_against_pandas(spark):
    r = rng(21)
    x = np.round(r.normal(size=300), 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(300, None)], "i int, v double")
    s = pd.Series([*x, np.nan])
    e = stats.ecdf(df, "v", "f").toPandas().set_index("i")["f"].sort_index()
    assert np.allclose(e[:300], (1 + s[:300].rank(method="max")) / 301) and math.isclose(e[300], 1 / 301)
    for ties, down in (("mean", False), ("min", True)):
        got = stats.global_rank(df.where("v IS NOT NULL"), "v", "k", down, ties).toPandas().set_index("i")["k"].sort_index()
        assert np.allclose(got, s[:300].rank(method={"mean": "average", "min": "min"}[ties], ascending=not down))
    p = np.round(r.random(200), 2)
    q = stats.benjamini_hochberg(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double"), "p", "q").toPandas().set_index("i")["q"].sort_index()
    order = np.argsort(-p, kind="stable")
    want = np.empty(200)
    want[order] = np.minimum.accumulate(np.minimum(1, p[order] * 200 / np.arange(200, 0, -1)))
    assert np.allclose(q, want)


# --- preprocessing -----------------------------------------------------------------------------------


def test_moderated_t(spark):
    r = rng(22)
    y = r.normal(size=(60, 12)) * np.sqrt(1 / r.gamma(4, 0.25, size=(60, 1)))
    y[:5, 6:] += 4
    df = long_frame(spark, y, [f"g{i}" for i in range(60)], list(range(12)), "gene string, sample int, score double").withColumn("tf", F.lit("t"))
    design = pd.DataFrame({"one": 1.0, "group": [0.0] * 6 + [1.0] * 6}, index=range(12))
    out = P.moderated_t(df, design, 1).toPandas().set_index("gene")
    x = design.to_numpy()
    b = np.linalg.lstsq(x, y.T, rcond=None)[0]
    s2 = ((y.T - x @ b) ** 2).sum(0) / 10
    assert np.allclose(out.loc[[f"g{i}" for i in range(60)], "effect"], b[1])
    plain = b[1] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
    t = out.loc[[f"g{i}" for i in range(60)], "t"].to_numpy()
    ratio = np.abs(plain / t)
    assert ratio[np.argmin(s2)] > 1 > ratio[np.argmax(s2)]  # small variances are raised, large ones lowered
    assert set(out.sort_values("p").index[:5]) == {f"g{i}" for i in range(5)} and (out["q"] >= out["p"]).all()
    assert math.isclose(tails.digamma(1), -0.5772156649015329, rel_tol=1e-10) and math.isclose(tails.trigamma(1), math.pi**2 / 6, rel_tol=1e-9)
    assert math.isclose(tails.trigamma(tails.trigamma_inverse(0.37)), 0.37, rel_tol=1e-9)


def test_annotation_and_tissues(spark):
    r = rng(23)
    x = np.abs(r.normal(size=(20, 8)))
    x[:3, 4:] += 30
    e = long_frame(spark, x, [f"g{i}" for i in range(20)], list(range(8)), "gene string, sample int, value double")
    at = P.check_annotation(e, spark.createDataFrame([("g0",), ("g1",), ("g2",)], "gene string"))
    assert (at.loc[:3, 0] > 0).all() != (at.loc[4:, 0] > 0).all() and abs(at.loc[:3, 0].mean() - at.loc[4:, 0].mean()) > 20
    flat = P.scaling(e, distance=lambda d: P.sample_distance(d).withColumn("d", F.lit(1.0)))
    assert len(flat) == 8 and np.abs(flat.to_numpy()).max() <= 1
    groups = spark.createDataFrame([(s, "x" if s < 6 else "y", f"m{s % 2}") for s in range(8)], "sample int, major string, minor string")
    out = P.tissues_to_merge(e, groups, prepare=lambda d: d.where("gene <> 'g19'")).toPandas()
    assert set(out["major"]) == {"x", "y"} and len(out) == 16
    with pytest.raises(ValueError, match="too many"):
        P.tissues_to_merge(e, groups, limit=2)
    assert T.top_matrix(e, 3).select("gene").distinct().count() == 3


def test_smooth_quantiles_keep_what_groups_differ_in(spark):
    r = rng(24)
    x = r.normal(size=(30, 6))
    x[:, 3:] += 100
    e = long_frame(spark, x, [f"g{i}" for i in range(30)], list(range(6)), "gene string, sample int, value double")
    groups = spark.createDataFrame([(s, s // 3) for s in range(6)], "sample int, grp int")
    out = P.qsmooth(e, groups).toPandas().groupby("sample")["value"].mean()
    assert (out[3:].mean() - out[:3].mean()) > 90  # variation between groups stays
    p = P.qsmooth(e.where("sample < 3"), groups.where("sample < 3")).toPandas()
    cols = [np.sort(p[p["sample"] == s]["value"]) for s in range(3)]
    assert np.allclose(cols[0], cols[1]) and np.allclose(cols[1], cols[2])


def test_genotype_networks(spark):
    r = rng(25)
    m = long_frame(spark, r.random((3, 4)), ["t0", "t1", "t2"], ["g0", "g1", "g2", "g3"], "tf string, gene string, weight double")
    e = long_frame(spark, r.normal(size=(4, 8)), ["g0", "g1", "g2", "g3"], list(range(8)), "gene string, sample int, value double")
    p = spark.createDataFrame([("t0", "t1", 1.0)], "i string, j string, weight double")
    eqtl = spark.createDataFrame([("t0", "g0", "s", -0.5)], "tf string, gene string, snp string, beta double")
    qbic = spark.createDataFrame([("s", "t0", "g0", -0.4)], "snp string, tf string, gene string, effect double")
    geno = spark.createDataFrame([("s", 2)], "snp string, alt int")
    plain, changed = I.egret(e, m, p, eqtl, qbic, geno)
    a, b = (x.toPandas().set_index(["tf", "gene"]).sort_index() for x in (plain, changed))
    assert math.isclose(b.loc[("t0", "g0"), "motif"] - a.loc[("t0", "g0"), "motif"], 0.4) and not np.allclose(a["score"], b["score"])
    _, less = I.egret(e, m, p, eqtl, qbic, geno, sign="abs")
    assert math.isclose(less.where("tf = 't0' AND gene = 'g0'").first()["motif"], a.loc[("t0", "g0"), "motif"] - 0.4)


def test_null_scores_leave_out_the_prior(spark):
    m = spark.createDataFrame([("t0", "g0", 1.0), ("t1", "g1", 1.0), ("t2", "g2", 1.0)], "tf string, gene string, weight double")
    p = spark.createDataFrame([("t0", "t1", 1.0)], "i string, j string, weight double")
    assert I.null_scores(m, p, samples=8, networks=2).count() == 2 * (9 - 3 - 2)


def test_activities(spark, tmp_path):
    r = rng(26)
    prior = long_frame(spark, np.where(r.random((3, 8)) < 0.5, 1.0, 0.0), ["g0", "t1", "t2"], [f"g{i}" for i in range(8)], "tf string, gene string, weight double")
    e = long_frame(spark, r.normal(size=(8, 10)), [f"g{i}" for i in range(8)], list(range(10)), "gene string, sample int, value double")
    fit = I.tiger(e, prior, expressed=True, baseline=False, out_path=f"file://{tmp_path}/fit")
    assert fit["tfs"] == ["g0"] and (fit["Z"] >= 0).all() and not fit["b"].any()
    from netloom.sources.sinks import read_fit

    assert np.allclose(read_fit(spark, f"file://{tmp_path}/fit", "W"), fit["W"])
    with pytest.raises(ValueError, match="no name"):
        I.tiger(e, prior.withColumn("gene", F.lit("x")))


def test_edge_helpers(spark):
    e = spark.createDataFrame([("b", "x", 1.0), ("a", "y", 2.0), ("a", "x", 3.0)], "tf string, gene string, weight double")
    assert [tuple(r)[:2] for r in N.sort_edges(e).collect()] == [("a", "x"), ("b", "x"), ("a", "y")]
    loops = e.unionByName(e.limit(1).withColumns({"tf": F.lit("x"), "gene": F.lit("x"), "weight": F.lit(9.0)}))
    assert N.top_edges(loops, 1, "weight").first().tf == "x" and N.top_edges(loops, 1, "weight", loops=False).first().weight == 3.0
    s = N.shuffle_within(e, "tf", "weight", 1)
    assert sorted(r.weight for r in s.where("tf = 'a'").collect()) == [2.0, 3.0] and s.columns == e.columns
    assert R.annotate(e, spark.createDataFrame([("x", 2, "later"), ("x", 1, "first")], "gene string, o int, name string"), "gene", ["o"]).where("gene = 'x' AND name = 'first'").count() == 2


def test_windowed_degrees_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "t", "g", 1.0), ("2024-01-01 00:20:00", "u", "g", 2.0), ("2024-01-01 03:00:00", "t", "g", 4.0), ("2024-01-01 00:15:00", "t", "g", 8.0)]
    for i, r in enumerate(rows):  # the last comes after its window has closed
        spark.createDataFrame([r], "ts string, tf string, gene string, weight double").coalesce(1).write.json(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema("ts timestamp, tf string, gene string, weight double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).json(f"file://{tmp_path}/in")
    q = windowed_degrees(stream).writeStream.format("memory").queryName("degrees").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT window.start AS s, degree FROM degrees").collect()
    assert [r.degree for r in got] and got[0].degree in (3.0, 11.0)
