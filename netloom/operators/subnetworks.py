"""Significant subnetworks between seed genes: p values against a null, alternating hops, and
connections that meet in the middle. Edges are (tf, gene, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.stats import benjamini_hochberg, cuts_of, running
from netloom.functions.tails import normal_cdf
from netloom.sources.sinks import exists


def combine(networks: list[DataFrame]) -> DataFrame:
    """(tf, gene, scores array): networks joined by key, edges in all of them."""
    out = None
    for i, n in enumerate(networks):
        n = n.select("tf", "gene", F.col("score").alias(f"s{i}"))
        out = n if out is None else out.join(n, ["tf", "gene"])
    return out.select("tf", "gene", F.array(*(f"s{i}" for i in range(len(networks)))).alias("scores"))


def empirical_p(edges: DataFrame, null: DataFrame) -> DataFrame:
    """(tf, gene, score, p): share of null scores above each score. Both sides are put in one
    order by distinct values, so no edge meets every null value."""
    e = edges.groupBy(F.col("score").alias("v")).agg(F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("edge"))
    u = e.unionByName(null.groupBy(F.col("score").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("edge")))
    per = u.groupBy("v").agg(F.sum("n").alias("n"), F.max("edge").alias("edge"))
    upto = running(per, "v", "n", "r", cuts_of(null, "score")["score"])
    share = (F.col("r_all") - F.col("r")) / F.greatest("r_all", F.lit(1)).cast("double")
    t = upto.where("edge = 1").select("v", share.alias("p"))
    return edges.join(t, edges["score"] == t["v"]).drop("v")


def rank_sum_p(combined: DataFrame, null: DataFrame) -> DataFrame:
    """(tf, gene, p): rank-sum test that each edge's scores exceed the null. Ranks of all scores
    among the null values come from one ordering by ranges, for all edges together: W adds, over
    an edge's scores, the null values below and half of those equal. The normal tail is corrected
    for continuity, and for ties by counts of equal null values and scores."""
    x = combined.select("tf", "gene", F.explode("scores").alias("score"))
    e = x.groupBy(F.col("score").alias("v")).agg(F.lit(0).cast("bigint").alias("n"))
    per = e.unionByName(null.groupBy(F.col("score").alias("v")).agg(F.count(F.lit(1)).alias("n"))).groupBy("v").agg(F.sum("n").alias("n"))
    at = running(per, "v", "n", "r", cuts_of(null, "score")["score"])
    cube = lambda c: c * c * c - c
    t = null.groupBy("score").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(cube(F.col("c"))).alias("ties"))
    y = x.groupBy("tf", "gene", "score").agg(F.count(F.lit(1)).cast("double").alias("k")).join(at, F.col("score") == F.col("v"))
    own = cube(F.col("k") + F.col("n")) - cube(F.col("n").cast("double"))  # what this edge's scores add to the ties
    g = y.groupBy("tf", "gene").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("r") - F.col("n") / 2)).alias("w"), F.sum(own).alias("own"), F.max("r_all").alias("m"))
    n, m = F.col("n"), F.col("m").cast("double")
    var = n * m / 12 * ((n + m + 1) - (F.col("ties") + F.col("own")) / ((n + m) * F.greatest(n + m - 1, F.lit(1.0))))
    z = F.when(var > 0, (F.col("w") - n * m / 2 - 0.5) / F.sqrt(F.greatest(var, F.lit(0.0))))

    @F.pandas_udf("double")
    def upper(z: pd.Series) -> pd.Series:
        return z.map(lambda v: 1.0 if v != v else 1 - normal_cdf(v))

    return g.crossJoin(F.broadcast(t)).select("tf", "gene", upper(z).alias("p"))  # one row


def p_values(combined: DataFrame, null: DataFrame, fdr: bool = False, cache: str | None = None) -> DataFrame:
    """(tf, gene, p): rank-sum test that an edge's scores exceed the null (the null's share above
    it where there is one score); optionally BH-adjusted. With ``cache`` the table is read from that
    path, and written there first where it isn't yet."""
    if cache and exists(combined.sparkSession, cache):
        return combined.sparkSession.read.parquet(cache)
    if combined.where(F.size("scores") > 1).isEmpty():
        out = empirical_p(combined.select("tf", "gene", F.col("scores")[0].alias("score")), null).drop("score")
    else:
        out = rank_sum_p(combined, null)
    if fdr:
        out = benjamini_hochberg(out, "p", "q").select("tf", "gene", F.col("q").alias("p"))
    if cache:
        out.write.parquet(cache)
        return combined.sparkSession.read.parquet(cache)
    return out


def breadth_first(edges: DataFrame, start: DataFrame, exclude: DataFrame, from_tf: bool, top: int | None = None) -> DataFrame:
    """(tf, gene): one hop over (tf, gene, p) from the nodes ``start`` to nodes of the other side that
    aren't in ``exclude`` (both: node); of these the ``top`` smallest p, ties by ends. Nodes that the
    network lacks, and nodes in both lists, are refused."""
    tfs, genes = edges.select(F.col("tf").alias("node")).distinct(), edges.select(F.col("gene").alias("node")).distinct()
    if not start.join(tfs if from_tf else genes, "node", "left_anti").isEmpty():
        raise ValueError("Starting nodes do not overlap with network nodes")
    if not exclude.join(tfs.union(genes), "node", "left_anti").isEmpty():
        raise ValueError("List of nodes to exclude does not overlap with network nodes")
    if not start.join(exclude, "node", "left_semi").isEmpty():
        raise ValueError("Starting nodes cannot overlap with nodes to exclude")
    near, far = ("tf", "gene") if from_tf else ("gene", "tf")
    got = edges.join(start.select(F.col("node").alias(near)), near, "left_semi").join(exclude.select(F.col("node").alias(far)), far, "left_anti")
    if top is not None:
        got = got.orderBy("p", "tf", "gene").limit(top)
    return got.select("tf", "gene")


def hop(edges: DataFrame, start: DataFrame, visited: DataFrame | None, from_tf: bool, top: int | None = None) -> DataFrame:
    """(seed, tf, gene) edges from the frontier (seed, node) to nodes of the other side that the
    seed has not visited (seed, node); of these the ``top`` times frontier-size smallest p, ties by
    ends. Nothing if none is left."""
    near, far = ("tf", "gene") if from_tf else ("gene", "tf")
    got = edges.join(start.withColumnRenamed("node", near), near)
    if visited is not None:
        got = got.join(visited.withColumnRenamed("node", far), ["seed", far], "left_anti")
    if top is not None:
        size = start.groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
        r = F.row_number().over(W.partitionBy("seed").orderBy("p", "tf", "gene"))
        got = got.withColumn("r", r).join(size, "seed").where(F.col("r") <= F.lit(top) * F.col("size"))
    return got.select("seed", "tf", "gene")


def all_hops(edges: DataFrame, seeds: DataFrame, hops: int, top: int | None = None) -> DataFrame:
    """(seed, hop, tf, gene) for all seeds (node) at once: gene to tf, tf to gene, and so on. Visited
    genes and tfs are kept apart, as both sides may use the same names."""
    from netloom.operators.communities import checkpoint_ready

    front = seeds.select(F.col("node").alias("seed"), "node").distinct()
    visited: dict[str, DataFrame | None] = {"gene": front, "tf": None}
    out = None
    for h in range(1, hops + 1):
        far = "tf" if h % 2 else "gene"
        step = checkpoint_ready(hop(edges, front, visited[far], from_tf=h % 2 == 0, top=top))
        part = step.select("seed", F.lit(h).alias("hop"), "tf", "gene")
        out = part if out is None else out.unionByName(part)
        front = step.select("seed", F.col(far).alias("node")).distinct()
        visited[far] = front if visited[far] is None else visited[far].unionByName(front).distinct()
    return out


def connections(hops: DataFrame) -> DataFrame:
    """(tf, gene): edges on paths between two seeds that meet after equally many hops, traced back
    to both; then other genes and tfs with one edge only are pruned."""
    n = hops.agg(F.max("hop")).first()[0] or 0
    seeds = hops.select("seed").distinct()
    kept = None
    for h in range(1, n + 1):
        end = "tf" if h % 2 else "gene"
        e = hops.where(F.col("hop") == h).select("seed", F.col(end).alias("node")).distinct()
        a, b = e.alias("a"), e.alias("b")
        meet = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.seed") < F.col("b.seed")))
        want = meet.select(F.explode(F.array("a.seed", "b.seed")).alias("seed"), F.col("a.node").alias("node")).distinct()
        for k in range(h, 0, -1):
            end, begin = ("tf", "gene") if k % 2 else ("gene", "tf")
            step = hops.where(F.col("hop") == k).join(want.withColumnRenamed("node", end), ["seed", end]).select("seed", "tf", "gene")
            kept = step.select("tf", "gene") if kept is None else kept.unionByName(step.select("tf", "gene"))
            want = step.select("seed", F.col(begin).alias("node")).distinct()
    if kept is None:
        return hops.select("tf", "gene").limit(0)
    kept = kept.distinct()
    lone = kept.groupBy("gene").count().where("count = 1").join(seeds.withColumnRenamed("seed", "gene"), "gene", "left_anti").select("gene")
    kept = kept.join(lone, "gene", "left_anti")
    lone_tf = kept.groupBy("tf").count().where("count = 1").select("tf")
    return kept.join(lone_tf, "tf", "left_anti").select("tf", "gene")


def subnetwork(seeds: list[str], networks: list[DataFrame], null: DataFrame, alpha: float = 0.05, hops: int = 2, top: int | None = None, fdr: bool = False, cache: str | None = None) -> DataFrame:
    """Significant edges that connect the seed genes within ``hops`` hops; arguments are checked."""
    if not isinstance(seeds, (list, tuple)) or not seeds or not all(isinstance(s, str) for s in seeds):
        raise ValueError("Wrong input type! seeds is a list of gene names")
    if not isinstance(networks, (list, tuple)) or not networks or not all(isinstance(n, DataFrame) for n in networks):
        raise ValueError("Wrong input type! Each network must be a data frame, and at least one network is needed")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in (alpha, hops)):
        raise ValueError("Wrong input type! alpha and hops must be scalar numeric values")
    for n in networks:
        if not {"tf", "gene", "score"} <= set(n.columns):
            raise ValueError("Each network must have the columns tf, gene and score")
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be between 0 and 1, not including 0.")
    if hops < 2 or hops % 2:
        raise ValueError("hops must be an even number of at least 2.")
    if dict(null.dtypes).get("score") not in ("double", "float", "int", "bigint"):
        raise ValueError("the null distribution must be numeric")
    p = p_values(combine(networks), null, fdr, cache).where(F.col("p") < alpha)
    spark = p.sparkSession
    found = all_hops(p, spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "node string"), hops // 2, top)
    return connections(found)
