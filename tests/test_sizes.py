"""What must hold of steps that larger tables have stopped: whole results, and no dense or paired intermediates."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from compare import database, sql_rows

from netloom.plans import catalog, files, steps  # noqa: F401
from netloom.sources import fixtures as X
from netloom.sources import readers as R


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gmt_keeps_all_genes_of_a_long_set(spark, tmp_path):
    n = (1 << 20) + 7
    (tmp_path / "s.gmt").write_text("long\tlink\t" + "\t".join(map(str, range(n))) + "\nshort\tlink\t1\t1\t\t2\nnone\tlink\nname\n")
    out = R.read_gmt(spark, str(tmp_path / "s.gmt"))
    assert {r[0]: r[1] for r in out.groupBy("set").count().collect()} == {"long": n, "short": 2}


def test_gmt_lines_are_not_carried_along_with_their_genes(spark, tmp_path):
    (tmp_path / "s.gmt").write_text("a\tlink\t1\t2\n")
    spread = [x for x in plan_of(R.read_gmt(spark, str(tmp_path / "s.gmt"))).splitlines() if "Generate explode" in x]
    above = plan_of(R.read_gmt(spark, str(tmp_path / "s.gmt"))).split("Generate explode")[0]
    assert spread and "split(" not in above


def test_interactions_follow_their_sql_without_a_look_up_of_pairs(spark, tmp_path):
    rows = [(1, 5), (2, 5), (3, 5), (4, 6), (7, None), (8, None)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    p = X.ppi(spark, f"file://{tmp_path}")
    got = sorted(tuple(r) for r in p.collect())
    _, want = sql_rows(database(str(tmp_path)), f"WITH {catalog._PPI} SELECT * FROM ppi")
    assert got == want and len(got) == 10
    assert "Aggregate" not in plan_of(p) and "Deduplicate" not in plan_of(p)


@pytest.fixture(scope="module")
def inputs(spark):
    """Expression, prior and interactions of 30 tfs and 7 genes; interactions differ by their direction."""
    r = np.random.default_rng(3)
    tfs, genes = list(range(10, 40)), [f"g{k}" for k in range(7)]
    e = spark.createDataFrame([(g, s, float(r.normal())) for g in genes for s in range(9)], "gene string, sample int, value double")
    m = spark.createDataFrame([(t, g, float(r.random() < 0.4)) for t in tfs for g in genes], "tf bigint, gene string, weight double")
    p = spark.createDataFrame([(a, b, float(r.random())) for a in tfs for b in tfs if r.random() < 0.2] + [(99, 10, 1.0)], "i bigint, j bigint, weight double")
    return e, m, p


def values(df):
    return df.toPandas().sort_values(df.columns[:2]).iloc[:, -1].to_numpy()


@pytest.mark.parametrize(
    "run",
    [
        lambda I, e, m, p: I.panda(e, m, p), lambda I, e, m, p: I.panda(e, m, None), lambda I, e, m, p: I.puma(e, m, p, mirs=[12, 17]),
        lambda I, e, m, p: I.spider(e, m, m, p), lambda I, e, m, p: I.otter(e, m, p, rounds=5),
    ],
    ids=["panda", "panda alone", "puma", "spider", "otter"],
)
def test_blocks_give_what_the_whole_matrix_gives(monkeypatch, inputs, run):
    from netloom.operators import inference as I
    from netloom.operators import tiles as B

    want = values(run(I, *inputs))
    monkeypatch.setattr(B, "DENSE", 100)
    monkeypatch.setattr(B, "WIDTH", 8)
    monkeypatch.setattr(B, "CELLS", 120)

    def dense(*_, **__):
        raise AssertionError("a matrix of all tfs")

    monkeypatch.setattr(I.K, "panda", dense)
    monkeypatch.setattr(I.K, "otter", dense)
    assert np.allclose(values(run(I, *inputs)), want, rtol=1e-9, atol=1e-11)


@pytest.mark.parametrize("n, g", [(30, 7), (6, 9), (2, 3)])
@pytest.mark.parametrize("remove", [True, False])
def test_transitions_by_blocks(monkeypatch, spark, n, g, remove):
    from netloom.operators import inference as I
    from netloom.operators import tiles as B

    r = np.random.default_rng(n)
    a, b = r.normal(size=(2, n, g))
    a[1] = a[0] if n > 6 else a[1]
    net = lambda x: spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(n) for j in range(g)], "tf bigint, gene string, score double")
    want = values(I.monster(net(a), net(b), remove_diagonal=remove))
    monkeypatch.setattr(B, "DENSE", 1)
    monkeypatch.setattr(B, "CELLS", 50)
    monkeypatch.setattr(I, "_frame", None)
    assert np.allclose(values(I.monster(net(a), net(b), remove_diagonal=remove)), want, rtol=1e-7, atol=1e-9)


def test_normal_equations_of_partly_shared_and_unknown_scores(spark):
    from netloom.operators import inference as I

    rows = [(1, "a", 1.0, 2.0), (1, "b", 3.0, 5.0), (1, "b", 4.0, 1.0), (2, "b", 2.0, None), (2, "c", 7.0, 3.0), (3, "d", 1.0, 1.0)]
    net = spark.createDataFrame(rows, "tf bigint, gene string, a double, b double")
    got = {(r.i, r.j): (r.gram, r.cross) for r in I.normal_equations(net).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}
    z = {t: [(g, a - np.mean([x[2] for x in rows if x[0] == t]), None if b is None else b - np.mean([x[3] for x in rows if x[0] == t and x[3] is not None])) for u, g, a, b in rows if u == t] for t in (1, 2, 3)}
    for (i, j), (gram, cross) in got.items():
        pairs = [(x, u, v) for h, x, _ in z[i] for k, u, v in z[j] if h == k]
        assert np.isclose(gram, sum(x * u for x, u, _ in pairs))
        known = [x * v for x, _, v in pairs if v is not None]
        assert cross is None if not known else np.isclose(cross, sum(known))


@pytest.mark.parametrize("name", ["panda_step", "otter_step", "panda_cooperation_step", "puma_cooperation_step", "monster_normal_equations"])
def test_no_pair_of_tfs_is_joined(spark, sf, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    assert "Join" not in plan and "Window" not in plan and "MapInArrow" in plan


def plain_louvain(mat):
    """Generalised Louvain with a matrix of memberships, as the method is described."""
    whole = np.arange(len(mat))
    while True:
        n = len(mat)
        com = np.arange(n)
        moved = True
        while moved:
            moved = False
            for i in range(n):
                gain = np.array([mat[i, (com == c) & (np.arange(n) != i)].sum() for c in range(n)])
                top = int(np.argmax(gain))
                if gain[top] - gain[com[i]] > 1e-12:
                    com[i], moved = top, True
        names = list(dict.fromkeys(com.tolist()))
        com = np.array([names.index(c) for c in com])
        whole = com[whole]
        if len(names) == n:
            return whole
        p = np.eye(len(names))[com]
        mat = p.T @ mat @ p


def test_louvain_of_cells_and_of_factors():
    from netloom.operators import communities as C

    for k in range(6):
        r = np.random.default_rng(k)
        w = r.normal(size=(14, 3))
        sign = np.array([1.0, 1.0, -1.0])
        whole = w * sign @ w.T
        assert C.louvain(whole).tolist() == C.factored_louvain(w, sign).tolist() == plain_louvain(whole).tolist()
        wide = np.zeros((16, 16))
        wide[:5, 5:] = np.where(r.random((5, 11)) < 0.7, r.normal(size=(5, 11)), 0)
        assert C.louvain(wide + wide.T).tolist() == plain_louvain(wide + wide.T).tolist()


def test_seed_is_that_of_the_whole_projection(spark):
    from netloom.operators import communities as C

    r = np.random.default_rng(5)
    w = np.where(r.random((6, 20)) < 0.4, r.random((6, 20)), 0)
    w[0, ~w.any(0)] = 0.5
    e = spark.createDataFrame([(f"r{i}", f"b{j:02}", float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "red string, blue string, weight double")
    m = w.T @ w
    np.fill_diagonal(m, 0)
    k = m.sum(1)
    want = plain_louvain(m - np.outer(k, k) / m.sum())
    got = {x.node: x.com for x in C.seed_communities(e, limit=10).collect()}  # the limit is on what is sequential and dense
    assert [got[f"b{j:02}"] for j in range(20)] == want.tolist()


def test_modules_of_more_nodes_than_a_dense_matrix_may_have(spark):
    from netloom.operators import modules as M

    n = 5200
    d = spark.range(n).selectExpr("concat('t', id) AS tf", "explode(array('a', 'b')) AS gene", "if((id % 2 = 0) = (gene = 'a'), 1D, -1D) AS d")
    tf, gene = M.louvain_modules(d)
    com = {r.node: r.com for r in tf.collect()}
    assert len(com) == n and len(set(com.values())) == 2 and all(com[f"t{k}"] == com[f"t{k % 2}"] for k in range(n))


def test_distances_of_samples_shuffle_no_pairs(spark):
    from netloom.operators import preprocessing as P

    r = np.random.default_rng(2)
    x = np.where(r.random((9, 5)) < 0.5, r.random((9, 5)), 0)
    x[0], x[1], x[2] = [0, 0, 1, 0, 0], [1, 0, 0, 0, 0], [0.2, 0, 0.3, 0, 0]
    d = P.binomial_distance(spark.createDataFrame([(int(i), f"s{s}", float(x[i, s])) for i, s in zip(*np.nonzero(x), strict=True)], "sample bigint, set string, score double"))
    names = [i for i in range(9) if x[i].any()]
    want = {}
    for i in names:
        for j in names:
            if i < j:
                want[i, j] = sum(((a * np.log(a / (a + b)) if a else 0) + (b * np.log(b / (a + b)) if b else 0)) / (a + b) + np.log(2) for a, b in zip(x[i], x[j], strict=True) if a + b > 0)
    got = {(q.i, q.j): q.d for q in d.collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k], atol=1e-12) for k in want)
    assert "Join" not in plan_of(d) and "Aggregate" not in plan_of(d)
