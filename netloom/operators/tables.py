"""The tables behind plots: what a plotting library needs, one row a point, edge or cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.inference import matrix, transition_stats


def network_plot(net: DataFrame, colors: DataFrame | None = None, tf_color: str = "blue", size: float = 1.0, width: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, side, color, size) and edges (tf, gene, color, width) of (tf, gene): tfs in one
    colour, genes by (gene, color), grey otherwise; edges have their gene's colour."""
    genes = net.select(F.col("gene").cast("string").alias("node")).distinct()
    if colors is not None:
        genes = genes.join(colors.select(F.col("gene").cast("string").alias("node"), "color").dropDuplicates(["node"]), "node", "left")
    else:
        genes = genes.withColumn("color", F.lit(None).cast("string"))
    tfs = net.select(F.col("tf").cast("string").alias("node")).distinct()
    shade = genes.select(F.col("node").alias("gene"), "color")
    nodes = tfs.select("node", F.lit("tf").alias("side"), F.lit(tf_color).alias("color")).unionByName(
        genes.join(tfs, "node", "left_anti").select("node", F.lit("gene").alias("side"), F.coalesce("color", F.lit("gray")).alias("color"))
    )
    edges = net.select(F.col("tf").cast("string").alias("tf"), F.col("gene").cast("string").alias("gene")).join(shade, "gene", "left")
    return nodes.withColumn("size", F.lit(float(size))), edges.select("tf", "gene", "color", F.lit(float(width)).alias("width"))


def community_plot(edges: DataFrame, red: DataFrame, blue: DataFrame) -> DataFrame:
    """(red, blue, x, y, red_com, blue_com, within): links of a community plot. Nodes are numbered
    community by community, in an order by hash within each."""

    def placed(memb: DataFrame, name: str) -> DataFrame:
        sizes = memb.groupBy("com").agg(F.count(F.lit(1)).alias("n"))  # a row a community
        base = sizes.select("com", F.coalesce(F.sum("n").over(W.orderBy("com").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        at = F.col("base") + F.row_number().over(W.partitionBy("com").orderBy(F.xxhash64("node"), "node"))
        return memb.join(base, "com").select(F.col("node").alias(name), F.col("com").alias(f"{name}_com"), at.alias("x" if name == "red" else "y"))

    x = edges.select("red", "blue").join(placed(red, "red"), "red", "left").join(placed(blue, "blue"), "blue", "left")
    return x.select("red", "blue", "x", "y", "red_com", "blue_com", F.coalesce(F.col("red_com") == F.col("blue_com"), F.lit(False)).alias("within"))


def community_heatmap(edges: DataFrame, red: DataFrame, blue: DataFrame) -> DataFrame:
    """(red_com, blue_com, links, weight): a block of the heat map for each pair of communities."""
    x = edges.join(red.select(F.col("node").alias("red"), F.col("com").alias("red_com")), "red").join(blue.select(F.col("node").alias("blue"), F.col("com").alias("blue_com")), "blue")
    return x.groupBy("red_com", "blue_com").agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("weight"))


def enrichment_histogram(null: DataFrame, observed: float, bins: int = 30) -> DataFrame:
    """(lo, n, observed): a histogram of permuted statistics (value), and the bin of the observed one."""
    lo, hi = null.agg(F.min("value"), F.max("value")).first()
    lo, hi = min(lo, observed), max(hi, observed)
    step = (hi - lo) / bins or 1.0
    at = lambda v: F.least(F.floor((v - F.lit(lo)) / F.lit(step)), F.lit(bins - 1))
    n = null.groupBy(at(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = null.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return grid.join(n, "bin", "left").select((F.lit(lo) + F.col("bin") * step).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"), (F.col("bin") == at(F.lit(observed))).alias("observed"))


def observed_transitions(tm: DataFrame) -> DataFrame:
    """(tf_from, tf_to, v) as observed."""
    return tm.where("perm = 0").select("tf_from", "tf_to", "v")


def transition_summary(tm: DataFrame, genes: int, samples: tuple[int, int]) -> DataFrame:
    """(what, n): what an analysis was run on."""
    n = tm.agg(F.count_distinct("tf_to").alias("transcription factors"), F.count_distinct(F.when(F.col("perm") > 0, F.col("perm"))).alias("permutations"))
    n = n.withColumns({"genes": F.lit(genes), "baseline samples": F.lit(samples[0]), "final samples": F.lit(samples[1])})
    return n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("n")) for c in n.columns))).alias("x")).select("x.what", "x.n")


def transition_sigmas(tm: DataFrame) -> DataFrame:
    """(tf_from, tf_to, v, sigma): observed transitions off the diagonal, and how many deviations of
    the permuted ones they lie from these ones' mean."""
    null = tm.where("perm > 0").groupBy("tf_from", "tf_to").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    x = observed_transitions(tm).where("tf_from <> tf_to").join(null, ["tf_from", "tf_to"])
    return x.select("tf_from", "tf_to", "v", F.try_divide(F.col("v") - F.col("m"), F.col("sd")).alias("sigma"))


def transition_network(tm: DataFrame, edges: int = 100, tfs: int = 10) -> DataFrame:
    """(tf_from, tf_to, v, sigma, color): the largest transitions between the tfs of the most
    extreme involvement, ties of size kept; red where fewer than by chance."""
    p = transition_stats(tm).select("tf", (1 - 2 * F.abs(F.lit(0.5) - F.col("p"))).alias("p"))
    top = p.orderBy("p", "tf").limit(tfs)
    x = transition_sigmas(tm).join(top.select(F.col("tf").alias("tf_from")), "tf_from", "left_semi").join(top.select(F.col("tf").alias("tf_to")), "tf_to", "left_semi")
    cut = x.select(F.abs("v").alias("s")).orderBy(F.desc("s")).limit(edges).agg(F.min("s").alias("cut"))
    x = x.crossJoin(F.broadcast(cut)).where(F.abs("v") >= F.col("cut")).drop("cut")  # one row
    return x.withColumn("color", F.when(F.col("sigma") > 0, F.lit("blue")).otherwise(F.lit("red")))


def involvement(tm: DataFrame, rescale: str = "none") -> DataFrame:
    """(tf, perm, value, place): each tf's off-diagonal mass as observed (perm 0) and permuted; with
    ``significance`` in deviations of the permuted ones, tfs placed by it; with ``magnitude`` placed
    by the observed mass; else by name."""
    s = tm.groupBy("perm", F.col("tf_to").alias("tf")).agg(F.sum(F.col("v") * F.col("v")).alias("value"))
    stats = s.groupBy("tf").agg(
        F.avg(F.when(F.col("perm") > 0, F.col("value"))).alias("m"), F.stddev_samp(F.when(F.col("perm") > 0, F.col("value"))).alias("sd"), F.max(F.when(F.col("perm") == 0, F.col("value"))).alias("o")
    )
    if rescale not in ("none", "significance", "magnitude"):
        raise ValueError("rescale is none, significance or magnitude")
    z = lambda v: F.try_divide(v - F.col("m"), F.col("sd"))
    order = {"none": [F.col("tf")], "magnitude": [F.desc("o"), F.col("tf")], "significance": [F.desc(z(F.col("o"))), F.col("tf")]}[rescale]
    place = stats.select("tf", "m", "sd", F.row_number().over(W.orderBy(*order)).alias("place"))  # a row a tf
    x = s.join(place, "tf")
    return x.select("tf", "perm", (z(F.col("value")) if rescale == "significance" else F.col("value")).alias("value"), "place")


def transition_components(tm: DataFrame) -> pd.DataFrame:
    """(node, x, y, size): first two principal components of the observed transitions, and the size
    that a node's label gets from its column's mass."""
    m, rows, cols = matrix(observed_transitions(tm), "tf_from", "tf_to", "v")
    z = m - m.mean(0)
    _, vec = np.linalg.eigh(z.T @ z / len(z))
    at = z @ vec[:, ::-1][:, :2]
    mass = {c: float(m[:, j] @ m[:, j]) for j, c in enumerate(cols)}
    o = np.array([mass.get(r, 0.0) for r in rows])
    size = 2 * (o - o.mean()) / max(o.std(ddof=1), 1e-300) + 4
    return pd.DataFrame({"node": rows, "x": at[:, 0], "y": at[:, 1] if at.shape[1] > 1 else 0.0, "size": size})


def transition_heatmap(tm: DataFrame, method: str = "pearson") -> pd.DataFrame:
    """(tf_from, tf_to, value, row, col): observed transitions, columns as z scores, both sides in the
    order of a complete-linkage tree over correlation or Euclidean distances."""
    m, rows, cols = matrix(observed_transitions(tm), "tf_from", "tf_to", "v")
    sd = m.std(0, ddof=1)
    z = (m - m.mean(0)) / np.where(sd > 0, sd, 1)

    def order(x: np.ndarray) -> list[int]:
        """Leaves of a tree over the columns."""
        if method == "pearson":
            c = x - x.mean(0)
            norm = np.maximum(np.sqrt((c * c).sum(0)), 1e-300)
            d = 1 - (c.T @ c) / np.outer(norm, norm)
        else:
            d = np.sqrt(np.maximum(((x[:, :, None] - x[:, None, :]) ** 2).sum(0), 0))
        d = d.astype(float)
        np.fill_diagonal(d, np.inf)
        leaves = {i: [i] for i in range(len(d))}
        while len(leaves) > 1:
            i, j = sorted(divmod(int(np.argmin(d)), len(d)))
            d[i] = d[:, i] = np.maximum(d[i], d[j])
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            leaves[i] += leaves.pop(j)
        return next(iter(leaves.values()))

    r, c = order(z.T), order(z)
    return pd.DataFrame([(rows[i], cols[j], float(z[i, j]), a, b) for a, i in enumerate(r) for b, j in enumerate(c)], columns=["tf_from", "tf_to", "value", "row", "col"])


def top_matrix(expr: DataFrame, n: int = 100, statistic=F.stddev_samp) -> DataFrame:
    """Expression (gene, sample, value) of the n genes with a positive sum of the largest statistic,
    any aggregate of a column, ties by name: what a heat map shows."""
    s = expr.groupBy("gene").agg(F.sum("value").alias("s"), statistic("value").alias("t")).where("s > 0")
    return expr.join(F.broadcast(s.orderBy(F.desc("t"), "gene").limit(n).select("gene")), "gene", "left_semi")  # n rows
