"""Analyses composed of the community operators: two conditions compared by subtraction, rotation and
differential modules; wrappers, accessors, a simulator, annotation terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import communities as C
from netloom.operators.networks import merge_networks

#: Cells of tfs x genes that the sequential search takes.
CELLS = 50_000_000


def members(result: DataFrame, target: str = "all") -> DataFrame:
    """Rows of (node, side, module, ...) of one side, tf or gene, or of both; without missing modules."""
    if target not in ("tf", "gene", "all"):
        raise ValueError("target is tf, gene or all")
    kept = result.where("module IS NOT NULL")
    return kept if target == "all" else kept.where(F.col("side") == target)


def member_tables(result: DataFrame, tests: DataFrame | None = None) -> dict[str, DataFrame]:
    """A table of memberships and scores for each side, with the tests (node, t, p) of replicates."""
    x = result if tests is None else result.join(tests.select("node", "t", "p"), "node", "left")
    return {side: members(x, side).drop("side") for side in ("tf", "gene")}


def node_to_gene(node: str = "node", whole: bool = True):
    """A node's name without its side tag; with ``whole`` false, what stands before the first ``_``."""
    return F.regexp_replace(node, "_[AB]$", "") if whole else F.substring_index(node, "_", 1)


def top_symbols(top: DataFrame, names: DataFrame) -> DataFrame:
    """Top genes (module, n, node) by their symbols (node, symbol); unknown ones go."""
    return top.join(names.select("node", "symbol").distinct(), "node").select("module", "n", "symbol")


def tagged(edges: DataFrame) -> DataFrame:
    """Positive edges (tf, gene, weight) as (red, blue, weight): genes red, tfs blue, with side tags."""
    return edges.where("weight > 0").select(
        F.concat(F.col("gene").cast("string"), F.lit("_B")).alias("red"), F.concat(F.col("tf").cast("string"), F.lit("_A")).alias("blue"), "weight"
    )


def condor_create(edges: DataFrame) -> DataFrame:
    """Checked edges of the largest component from an edge list (tf, gene, weight)."""
    return C.condor_object(tagged(edges))


def condor_run(edges: DataFrame, scores: bool = False, method: str = "LCS") -> DataFrame:
    """(node, side, com) of both sides, with each node's share of modularity if asked for."""
    e = C.checkpoint_ready(condor_create(edges))
    red, blue, _ = C.condor_cluster(e, method=method)
    both = red.withColumn("side", F.lit("red")).unionByName(blue.withColumn("side", F.lit("blue"))).select("node", "side", "com")
    return both.join(C.q_scores(e, red, blue).select("node", "side", "q"), ["node", "side"], "left") if scores else both


def _sided(table: DataFrame) -> DataFrame:
    """Red and blue nodes with tags as genes and tfs without."""
    side = F.when(F.col("side") == "red", F.lit("gene")).otherwise(F.lit("tf"))
    return table.withColumns({"node": node_to_gene(), "side": side})


def louvain_modules(d: DataFrame, limit: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(node, com) of tfs and of genes by generalised Louvain over (tf, gene, d), whose cells are checked
    against ``limit`` first, as the search is sequential."""
    return C.bipartite_louvain(d, limit)


def wbm_louvain(edges: DataFrame) -> DataFrame:
    """(node, side, module, score) of one network (tf, gene, weight): generalised Louvain on its
    bipartite modularity, and each node's share of its module's modularity."""
    e = edges.select(F.col("tf").cast("string").alias("red"), F.col("gene").cast("string").alias("blue"), "weight").transform(C.checkpoint_ready)
    d = C.checkpoint_ready(C.modularity_matrix(e).select(F.col("red").alias("tf"), F.col("blue").alias("gene"), F.col("b").alias("d")))
    tf, gene = louvain_modules(d)
    return C.module_scores(d, tf, gene)


def gained(net: DataFrame) -> DataFrame:
    """(tf, gene, weight): what edges of (tf, gene, a, b) gain from a to b, where they gain; edges
    that are negative in both are left out."""
    return net.where("(a >= 0 OR b >= 0) AND b > a").select("tf", "gene", (F.col("b") - F.col("a")).alias("weight"))


def delta_modules(net: DataFrame, method: str = "condor") -> DataFrame:
    """(node, side, module, score) of the gained edges, by ``condor`` or ``louvain``."""
    if method == "louvain":
        return wbm_louvain(gained(net))
    if method != "condor":
        raise ValueError("method is condor or louvain")
    r = _sided(condor_run(gained(net), scores=True))
    return r.select("node", "side", F.col("com").alias("module"), F.col("q").alias("score"))


def rotation(net: DataFrame, method: str = "condor") -> DataFrame:
    """(node, deviation, rank): how far nodes move between the communities of the positive edges of
    a and of b in (tf, gene, a, b), each network clustered alone; nodes carry side tags."""

    def clustered(w: str) -> DataFrame:
        e = net.where(F.col(w) > 0).select("tf", "gene", F.col(w).alias("weight"))
        if method == "condor":
            return condor_run(e).select("node", "com")
        if method != "louvain":
            raise ValueError("method is condor or louvain")
        tag = F.when(F.col("side") == "tf", F.lit("_A")).otherwise(F.lit("_B"))
        return wbm_louvain(e).select(F.concat("node", tag).alias("node"), F.col("module").alias("com"))

    return C.rotation_rank(C.checkpoint_ready(clustered("a")), C.checkpoint_ready(clustered("b")))


def compare_modules(one: DataFrame, two: DataFrame, **options) -> DataFrame:
    """Differential modules of two networks (tf, gene, score): the edges in both, from one to two."""
    return C.alpaca(merge_networks(one, two), **options)


def simulate(spark: SparkSession, sizes: list[tuple[int, int]], edges: list[list[int]], modules: list[tuple[int, int, float]] = (), seed: int = 0) -> tuple[DataFrame, list[list[str]]]:
    """Two random networks (tf, gene, a, b) of 0 and 1 with communities of ``sizes`` (tfs, genes), and
    ``edges[i][j]`` edges between the tfs of community i and the genes of j; the second also gets
    ``modules`` (tfs, genes, density), whose nodes are returned. Edges are drawn by a seeded hash."""
    tf_of = [f"A{i + 1}" for i in range(sum(a for a, _ in sizes))]
    gene_of = [f"B{i + 1}" for i in range(sum(b for _, b in sizes))]
    com = lambda k: [i for i, s in enumerate(sizes) for _ in range(s[k])]
    t = spark.createDataFrame(list(zip(tf_of, com(0), strict=True)), "tf string, ti int")
    g = spark.createDataFrame(list(zip(gene_of, com(1), strict=True)), "gene string, gi int")
    many = spark.createDataFrame([(i, j, int(x)) for i, row in enumerate(edges) for j, x in enumerate(row)], "ti int, gi int, m int")
    from pyspark.sql import Window as W

    pairs = t.join(many, "ti").join(g, "gi")
    drawn = lambda net: (F.row_number().over(W.partitionBy("ti", "gi").orderBy(F.xxhash64("tf", "gene", F.lit(seed), F.lit(net)))) <= F.col("m")).cast("double")
    pairs = pairs.withColumns({"a": drawn("a"), "b": drawn("b")})
    r = np.random.default_rng(seed)
    named = []
    for n_tf, n_gene, density in modules:
        tfs, genes = r.choice(tf_of, n_tf, replace=False).tolist(), r.choice(gene_of, n_gene, replace=False).tolist()
        inside = F.col("tf").isin(tfs) & F.col("gene").isin(genes)
        place = F.row_number().over(W.partitionBy(inside).orderBy(F.xxhash64("tf", "gene", F.lit(seed), F.lit(len(named)))))
        pairs = pairs.withColumn("b", F.when(inside & (place <= int(n_tf * n_gene * density)), 1.0).otherwise(F.col("b")))
        named.append([*tfs, *genes])
    return pairs.where("a > 0 OR b > 0").select("tf", "gene", "a", "b"), named


def term_genes(term: str, offspring: DataFrame, annotation: DataFrame) -> DataFrame:
    """(gene) of a term and of all terms below it, from tables (term, offspring) and (term, gene)."""
    terms = offspring.where(F.col("term") == term).select(F.col("offspring").alias("term"))
    terms = terms.unionByName(annotation.where(F.col("term") == term).select("term")).distinct()
    return annotation.join(terms, "term", "left_semi").select("gene").distinct()


def enriched_terms(overlaps: DataFrame, level: float = 0.05, least: int = 2) -> DataFrame:
    """Rows of gene-set overlaps (module, set, overlap, p) with more than ``least`` common genes and a
    BH-adjusted p under ``level`` within the module."""
    from pyspark.sql import Window as W

    w = W.partitionBy("module")
    raw = F.col("p") * F.count(F.lit(1)).over(w) / F.count(F.lit(1)).over(w.orderBy("p"))
    x = overlaps.withColumn("raw", raw).withColumn("q", F.least(F.lit(1.0), F.min("raw").over(w.orderBy(F.desc("p")))))
    return x.where((F.col("q") < level) & (F.col("overlap") > least)).select("module", "set", "overlap", "p", "q")


def common_genes(overlaps: DataFrame, modules: DataFrame, sets: DataFrame) -> DataFrame:
    """(module, set, genes): the genes behind each given overlap, sorted and comma-joined."""
    x = overlaps.select("module", "set").distinct().join(modules.distinct(), "module").join(sets.distinct(), ["set", "gene"])
    return x.groupBy("module", "set").agg(F.array_join(F.sort_array(F.collect_set("gene")), ",").alias("genes"))
