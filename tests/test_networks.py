import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import communities as C
from netloom.operators import inference as I
from netloom.operators import networks as N
from netloom.operators import preprocessing as P
from netloom.operators import subnetworks as S
from netloom.sources import readers as R


def test_brim_from_singletons(spark):
    """Eleven edges whose modularities from one community each are known."""
    e = "Alice-Bob Alice-John Alice-Ed Sue-Bob Sue-John Sue-Hank Janine-Ed Janine-Hank Janine-John Mary-Ed Mary-Hank".split()
    edges = spark.createDataFrame([(*x.split("-"), 1.0) for x in e], "red string, blue string, weight double")
    seed = spark.createDataFrame([(b, i + 1) for i, b in enumerate(["Bob", "Ed", "Hank", "John"])], "node string, com int")
    red, blue, q = C.brim(edges, seed)
    assert q == sorted(q) and len(q) >= 2
    s = {(r["side"], r["com"]): r["q"] for r in C.q_scores(edges, red, blue).groupBy("side", "com").agg(F.sum("q").alias("q")).collect()}
    assert all(abs(v - 0.5) < 1e-9 for v in s.values())
    assert C.components(edges).select("component").distinct().count() == 1


def test_checked_edges(spark):
    bad = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "red string, blue string, weight double")
    with pytest.raises(ValueError, match="both sides"):
        C.condor_object(bad)
    with pytest.raises(ValueError, match="missing"):
        C.condor_object(bad.unionByName(bad.limit(1).withColumn("weight", F.lit(None).cast("double"))))


def test_lioness_closed_form_against_leaving_out(spark):
    x = {"a": [1.0, 1, 2, 3], "b": [1.0, 2, 3, 4], "c": [4.0, 1, 7, 2]}
    e = spark.createDataFrame([(g, s, float(v)) for g, vs in x.items() for s, v in enumerate(vs)], "gene string, sample int, value double")
    for r in N.lioness_pearson(e).collect():
        i, j = np.array(x[r["i"]]), np.array(x[r["j"]])
        keep = np.arange(4) != r["sample"]
        want = 4 * np.corrcoef(i, j)[0, 1] - 3 * np.corrcoef(i[keep], j[keep])[0, 1]
        assert abs(r["score"] - want) < 1e-9


def test_lioness_of_message_passing_runs_a_task_a_sample(spark):
    r = np.random.default_rng(0)
    e = spark.createDataFrame([(f"g{i}", s, float(r.normal())) for i in range(5) for s in range(6)], "gene string, sample int, value double")
    m = spark.createDataFrame([(f"t{t}", f"g{i}", float((t + i) % 2)) for t in range(3) for i in range(5)], "tf string, gene string, weight double")
    out = I.lioness(e, m, samples=[0, 3]).toPandas()
    assert len(out) == 2 * 15 and np.isfinite(out["score"]).all()
    with pytest.raises(ValueError, match="method"):
        I.lioness(e, m, method="other")


def test_connected_seeds(spark):
    """The edges of a small grid that tie four seeds together."""
    edges = [("tf2", "A"), ("tf2", "B"), ("tf3", "A"), ("tf3", "D"), ("tf4", "C"), ("tf4", "D"), ("tf1", "E")]
    df = spark.createDataFrame([(*e, 0.01) for e in edges], "tf string, gene string, p double")
    seeds = lambda s: spark.createDataFrame([(x,) for x in s], "node string")
    got = lambda s, h: {tuple(r) for r in S.connections(S.all_hops(df, seeds(s), h)).collect()}
    assert got("ABCD", 2) == {("tf2", "A"), ("tf2", "B"), ("tf3", "A"), ("tf3", "D"), ("tf4", "C"), ("tf4", "D")}
    assert got("AC", 2) == {("tf3", "A"), ("tf3", "D"), ("tf4", "C"), ("tf4", "D")}
    net = df.select("tf", "gene", F.lit(1.0).alias("score"))
    for kw, what in (({"alpha": 2}, "alpha"), ({"hops": 3}, "even"), ({"networks": []}, "network"), ({"seeds": []}, "seeds")):
        with pytest.raises(ValueError, match=what):
            S.subnetwork(**{"seeds": ["A"], "networks": [net], "null": net.select("score")} | kw)


def test_same_network_twice_has_no_transition(spark):
    r = np.random.default_rng(1)
    net = spark.createDataFrame([(f"t{t}", f"g{g}", float(r.normal())) for t in range(3) for g in range(9)], "tf string, gene string, score double")
    assert I.monster(net, net).where("abs(v) > 1e-9").isEmpty()


def test_quantile_normalised_samples_share_their_values(spark):
    r = np.random.default_rng(2)
    e = spark.createDataFrame([(f"g{g}", s, float(r.normal(s))) for g in range(7) for s in range(4)], "gene string, sample int, value double")
    p = P.quantile_normalize(e).toPandas()
    cols = [np.sort(p[p["sample"] == s]["value"]) for s in range(4)]
    assert all(np.allclose(cols[0], c) for c in cols)


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('"t1"\t"g1"\t1\n"t2"\t"g2"\t0.5\n')
    assert {tuple(r) for r in R.read_motif(spark, str(tmp_path / "m.tsv")).collect()} == {("t1", "g1", 1.0), ("t2", "g2", 0.5)}
    (tmp_path / "e.tsv").write_text("g1\t1\t2\t3\ng2\t4\t5\t6\n")
    assert R.read_expression(spark, str(tmp_path / "e.tsv"), start=2, end=3).count() == 4
    (tmp_path / "s.gmt").write_text("S1\turl\tg1\tg2\nS2\turl\tg3\n")
    assert R.read_gmt(spark, str(tmp_path / "s.gmt")).count() == 3
    (tmp_path / "v.vcf").write_text("chr1\t10\t.\tA\tC\t.\t.\t.\tGT\t0|1\nchr1\t20\t.\tA\tC\t.\t.\t.\tGT\t1|1\n")
    assert {tuple(r) for r in R.read_vcf(spark, str(tmp_path / "v.vcf")).collect()} == {("chr1_10", 1), ("chr1_20", 2)}
    R.write_network(R.read_motif(spark, str(tmp_path / "m.tsv")), str(tmp_path / "out"), "txt")
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "out"), header=True).count() == 2


def test_empty_prior_is_refused(spark):
    with pytest.raises(ValueError, match="no edges"):
        I.panda(None, spark.createDataFrame([], "tf string, gene string, weight double"))
