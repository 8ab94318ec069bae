"""Relational operators on networks. Edges are (tf, gene, score) rows unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.stats import cuts_of, ecdf, safe_corr, zscore

ROOT2 = 2**0.5


def in_degree(net: DataFrame, score: str = "score") -> DataFrame:
    return net.groupBy("gene").agg(F.sum(score).alias("degree"))


def out_degree(net: DataFrame, score: str = "score") -> DataFrame:
    return net.groupBy("tf").agg(F.sum(score).alias("degree"))


def degree_difference(net: DataFrame, first: str, second: str, key: str = "gene") -> DataFrame:
    """Difference of the degrees of two score columns: one shuffle for both."""
    return net.groupBy(key).agg((F.sum(first) - F.sum(second)).alias("difference"))


def merge_networks(one: DataFrame, two: DataFrame) -> DataFrame:
    """(tf, gene, a, b) of the edges in both."""
    return one.select("tf", "gene", F.col("score").alias("a")).join(two.select("tf", "gene", F.col("score").alias("b")), ["tf", "gene"])


def diff_edges(net: DataFrame, threshold: float = 0.8, condition: str = "cond") -> DataFrame:
    """Edges of (tf, gene, a, b) that are strong and stronger than in the other condition: the
    product of the empirical distribution functions of score and difference exceeds the
    threshold. ``condition`` is true for edges of ``a``."""
    d = net.withColumns({"d": F.col("a") - F.col("b"), "e": F.col("b") - F.col("a")})
    cuts = cuts_of(d, "a", "b", "d", "e")
    for value, out in (("a", "fa"), ("b", "fb"), ("d", "fd"), ("e", "fe")):
        d = ecdf(d, value, out, cuts[value])
    one = d.where(F.col("fa") * F.col("fd") > threshold).select("tf", "gene", F.col("a").alias("score"), F.lit(True).alias(condition))
    two = d.where(F.col("fb") * F.col("fe") > threshold).select("tf", "gene", F.col("b").alias("score"), F.lit(False).alias(condition))
    return one.unionByName(two)


def symmetric(edges: DataFrame, nodes: DataFrame, diagonal: float | None = None) -> DataFrame:
    """(i, j, weight) both ways, with the given diagonal."""
    both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")).dropDuplicates(["i", "j"])
    if diagonal is None:
        return both
    diag = nodes.select("i", F.col("i").alias("j"), F.lit(float(diagonal)).alias("weight"))
    return both.where("i <> j").unionByName(diag)


def sum_duplicates(edges: DataFrame, last_by: str | None = None) -> DataFrame:
    """One row per edge: the sum of its weights, or the weight of the largest ordinal."""
    w = F.max_by("weight", last_by) if last_by else F.sum("weight")
    return edges.groupBy("tf", "gene").agg(w.alias("weight"))


def el2adj(edges: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """A row per tf and a column per gene, absent edges 0. Give the genes to spare a pass."""
    return edges.groupBy("tf").pivot("gene", genes).agg(F.last("weight", True)).fillna(0.0)


def adj2el(adjacency: DataFrame, key: str = "tf") -> DataFrame:
    """The complete edge list of a wide matrix."""
    return adjacency.unpivot([key], [c for c in adjacency.columns if c != key], "gene", "weight")


def el2regulon(edges: DataFrame) -> DataFrame:
    """(tf, tfmode map of gene to weight, likelihood array of 1)."""
    mode = F.map_from_entries(F.sort_array(F.collect_list(F.struct("gene", "weight"))))
    return edges.groupBy("tf").agg(mode.alias("tfmode"), F.array_repeat(F.lit(1.0), F.count(F.lit(1)).cast("int")).alias("likelihood"))


def adj2regulon(adjacency: DataFrame) -> DataFrame:
    return el2regulon(adj2el(adjacency).where("weight <> 0"))


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("gene", "tf")


def same_edge_order(one: DataFrame, two: DataFrame, ordinal: str) -> bool:
    """Whether two edge lists have the same ends at each ordinal."""
    a, b = one.select(F.col(ordinal).alias("o"), F.struct("tf", "gene").alias("x")), two.select(F.col(ordinal).alias("o"), F.struct("tf", "gene").alias("y"))
    return a.join(b, "o", "full").where(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()


def is_edge_list(df: DataFrame) -> bool:
    kinds = [t for _, t in df.dtypes]
    return len(kinds) >= 3 and kinds[:2] == ["string", "string"] and kinds[2] in ("double", "float", "int", "bigint")


def add_tags(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"tf": F.concat("tf", F.lit("_A")), "gene": F.concat("gene", F.lit("_B"))})


def remove_tags(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"tf": F.regexp_replace("tf", "_A$", ""), "gene": F.regexp_replace("gene", "_B$", "")})


def dense(edges: DataFrame, value: str = "weight") -> DataFrame:
    """Every (tf, gene) pair, absent ones 0. The larger side is not broadcast."""
    grid = edges.select("tf").distinct().crossJoin(edges.select("gene").distinct())
    return grid.join(edges.select("tf", "gene", value), ["tf", "gene"], "left").fillna(0.0, [value])


def align(
    motif: DataFrame, expr: DataFrame, ppi: DataFrame, mode: str = "union", missing_motif: bool = True, missing_expr: bool = False, missing_ppi: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """motif (tf, gene, weight), expr (gene, sample, value), ppi (i, j, weight) on one universe.

    union: genes of motif and expression, missing values 0. intersection: genes in both, and
    interactions between the motif's tfs. legacy: by the three flags, motif edges of genes without
    expression go, expression of genes without a motif goes, and interactions of tfs without a
    motif go; by default the first only.
    """
    if mode == "union":
        genes = motif.select("gene").union(expr.select("gene")).distinct()
        full = genes.crossJoin(F.broadcast(expr.select("sample").distinct()))
        return motif, full.join(expr, ["gene", "sample"], "left").fillna(0.0, ["value"]), ppi
    have = expr.select("gene").distinct()
    m = motif.join(have, "gene", "left_semi") if mode != "legacy" or missing_motif else motif
    if mode == "legacy":
        if missing_expr:
            expr = expr.join(m.select("gene").distinct(), "gene", "left_semi")
        if missing_ppi:
            known = m.select(F.col("tf").alias("i")).distinct()
            ppi = ppi.join(known, "i", "left_semi").join(known.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "weight")
        return m, expr, ppi
    if mode != "intersection":
        raise ValueError("mode is one of union, intersection, legacy")
    tfs = m.select(F.col("tf").alias("i")).distinct()
    p = ppi.join(tfs, "i", "left_semi").join(tfs.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "weight")
    return m, expr.join(m.select("gene").distinct(), "gene", "left_semi"), p


def gene_correlation(expr: DataFrame, by_presence: bool = False) -> DataFrame:
    """(i, j, r) for i <= j: Pearson over shared samples, 0 without variance; optionally times the
    share of samples in which both are positive."""
    a, b = expr.alias("a"), expr.alias("b")
    both = a.join(b, (F.col("a.sample") == F.col("b.sample")) & (F.col("a.gene") <= F.col("b.gene"))).select(
        F.col("a.gene").alias("i"), F.col("b.gene").alias("j"), F.col("a.value").alias("x"), F.col("b.value").alias("y")
    )
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(safe_corr("x", "y"))
    if by_presence:
        r = r * F.count_if((F.col("x") > 0) & (F.col("y") > 0)) / F.count(F.lit(1))
    return both.groupBy("i", "j").agg(r.alias("r"))


def spearman(expr: DataFrame) -> DataFrame:
    from netloom.functions.stats import mean_rank

    return gene_correlation(expr.select("gene", "sample", mean_rank("value", "gene").alias("value")))


def kendall(expr: DataFrame) -> DataFrame:
    """Kendall's tau-b by pairs of samples of each gene pair; for few samples."""
    s = expr.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("v")).select("gene", F.expr("transform(v, x -> x.value)").alias("v"))
    a, b = s.select(F.col("gene").alias("i"), F.col("v").alias("x")), s.select(F.col("gene").alias("j"), F.col("v").alias("y"))
    pairs = a.join(b, F.col("i") < F.col("j"))
    part = lambda e: F.expr(f"aggregate(sequence(0, size(x) - 1), 0D, (s, p) -> s + aggregate(sequence(0, size(x) - 1), 0D, (u, q) -> if(p < q, u + {e}, u)))")
    d, e = "sign(x[p] - x[q])", "sign(y[p] - y[q])"
    tau = F.try_divide(part(f"{d} * {e}"), F.sqrt(part(f"{d} * {d}") * part(f"{e} * {e}")))
    return pairs.select("i", "j", F.coalesce(tau, F.lit(0.0)).alias("r"))


def normalize_network(net: DataFrame, row: str = "tf", col: str = "gene", value: str = "score") -> DataFrame:
    """(row z + column z) / sqrt 2 of a complete matrix; where one has no variance the global z
    takes its place."""
    zr, zc = zscore(value, row), zscore(value, col)
    total = net.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = net.crossJoin(F.broadcast(total)).withColumns({"__r": zr, "__c": zc})  # one row
    za = F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))
    out = (F.coalesce("__r", za) + F.coalesce("__c", za)) / F.lit(ROOT2)
    return z.select(row, col, out.alias(value))


def tanimoto(x: DataFrame, y: DataFrame) -> DataFrame:
    """X(i, k, v) * Y(k, j, v) / sqrt(sum y^2 + sum x^2 - |XY|), complete in i and j."""
    xy = (
        x.select("i", "k", F.col("v").alias("x")).join(y.select("k", "j", F.col("v").alias("y")), "k")
        .groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    )
    nx = x.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("nx"))
    ny = y.groupBy("j").agg(F.sum(F.col("v") * F.col("v")).alias("ny"))
    return xy.join(nx, "i").join(ny, "j").select("i", "j", F.coalesce(F.try_divide("s", F.sqrt(F.abs(F.col("nx") + F.col("ny") - F.abs("s")))), F.lit(0.0)).alias("v"))


def update_diagonal(m: DataFrame, num: int, alpha: float, step: int) -> DataFrame:
    """(i, j, v) with v on the diagonal replaced by the deviation of the row's rest * num * e^(2 alpha step)."""
    rest = F.stddev_pop(F.when(F.col("i") != F.col("j"), F.col("v"))).over(W.partitionBy("i"))
    new = F.coalesce(rest, F.lit(0.0)) * F.lit(float(num)) * F.exp(F.lit(2.0 * alpha * step))
    return m.select("i", "j", F.when(F.col("i") == F.col("j"), new).otherwise(F.col("v")).alias("v"))


def message_step(w: DataFrame, p: DataFrame, c: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(tf, gene, v): regulation after one round of message passing from regulation (tf, gene, v),
    cooperation and co-regulation (i, j, v), all complete and normalised."""
    responsible = tanimoto(p.select("i", F.col("j").alias("k"), "v"), w.select(F.col("tf").alias("k"), F.col("gene").alias("j"), "v"))
    available = tanimoto(w.select(F.col("tf").alias("i"), F.col("gene").alias("k"), "v"), c.select(F.col("i").alias("k"), "j", "v"))
    both = responsible.join(available.withColumnRenamed("v", "u"), ["i", "j"]).select(F.col("i").alias("tf"), F.col("j").alias("gene"), ((F.col("v") + F.col("u")) / 2).alias("u"))
    return w.join(both, ["tf", "gene"]).select("tf", "gene", (F.col("v") * (1 - alpha) + F.col("u") * alpha).alias("v"))


def cooperation_step(w: DataFrame, p: DataFrame, num: int, alpha: float = 0.1, step: int = 0, frozen: list | None = None) -> DataFrame:
    """(i, j, v): cooperation after one round, from regulation (tf, gene, v) and cooperation (i, j, v) of
    ``num`` tfs. The new one's diagonal follows its rows' deviation. Rows and columns of frozen tfs
    keep their values off the diagonal."""
    new = tanimoto(w.select(F.col("tf").alias("i"), F.col("gene").alias("k"), "v"), w.select(F.col("gene").alias("k"), F.col("tf").alias("j"), "v"))
    new = update_diagonal(new, num, alpha, step)
    x = p.join(new.withColumnRenamed("v", "u"), ["i", "j"])
    moved = F.col("v") * (1 - alpha) + F.col("u") * alpha
    held = (F.col("i").isin(frozen) | F.col("j").isin(frozen)) & (F.col("i") != F.col("j")) if frozen else F.lit(False)
    return x.select("i", "j", F.when(held, F.col("v")).otherwise(moved).alias("v"))


def descent_step(w: DataFrame, p: DataFrame, c: DataFrame, lam: float = 0.035, gamma: float = 0.335, eta: float = 1e-5, bexp: float = 1.0) -> DataFrame:
    """(tf, gene, gradient, v): the first step of gradient descent for regulation (tf, gene, v) against
    cooperation and co-regulation (i, j, v), complete, each divided by its trace: the gradient
    W W'W + P W + W C with P and C weighed by ``lam`` and ``gamma``, and W moved by it."""
    trace = lambda m: m.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("t"))
    over = lambda m: m.crossJoin(F.broadcast(trace(m))).withColumn("v", F.col("v") / F.col("t")).drop("t")  # one row
    p, c = over(p), over(c)
    size = w.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("t"))
    w = w.crossJoin(F.broadcast(size)).select("tf", "gene", (F.col("v") / F.col("t")).alias("v"))
    p = p.withColumn("v", F.col("v") * -(1 - lam) + F.when(F.col("i") == F.col("j"), gamma).otherwise(0.0))
    c = c.withColumn("v", F.col("v") * -lam)
    a, b = w.alias("a"), w.alias("b")
    square = a.join(b, F.col("a.tf") == F.col("b.tf")).groupBy(F.col("a.gene").alias("i"), F.col("b.gene").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))
    right = square.unionByName(c.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("u"))  # W'W + C
    one = w.join(right, w["gene"] == right["i"]).groupBy("tf", F.col("j").alias("g")).agg(F.sum(F.col("v") * F.col("u")).alias("x"))
    left = p.select("i", "j", F.col("v").alias("u")).join(w, F.col("j") == F.col("tf")).groupBy(F.col("i").alias("t"), F.col("gene").alias("h")).agg(F.sum(F.col("v") * F.col("u")).alias("y"))
    g = one.join(left, (F.col("tf") == F.col("t")) & (F.col("g") == F.col("h"))).select("tf", F.col("g").alias("gene"), (F.col("x") + F.col("y")).alias("gradient"))
    b1, b2 = 0.9, 0.999  # the moments' decay
    root, lead = (1 - b2 ** (bexp + 1)) ** 0.5, 1 - b1 ** (bexp + 1)
    m, q = 4 * (1 - b1) * F.col("gradient"), 16 * (1 - b2) * F.col("gradient") * F.col("gradient")
    return g.join(w, ["tf", "gene"]).select("tf", "gene", "gradient", (F.col("v") - root / lead * eta * m / (1e-8 * root + F.sqrt(q))).alias("v"))


def dense_square(pairs: DataFrame, nodes: DataFrame, value: str = "weight") -> DataFrame:
    """(i, j, v) for all pairs of nodes (i), absent ones 0: as large as the dense matrix by definition."""
    grid = nodes.select("i").crossJoin(nodes.select(F.col("i").alias("j")))
    return grid.join(pairs.select("i", "j", F.col(value).alias("v")), ["i", "j"], "left").fillna(0.0, ["v"])


def degree_adjust(net: DataFrame, value: str = "score") -> DataFrame:
    """score * sqrt(mean of the column^2 + mean of the row^2) of a complete matrix."""
    r, c = F.avg(value).over(W.partitionBy("tf")), F.avg(value).over(W.partitionBy("gene"))
    return net.select("tf", "gene", (F.col(value) * F.sqrt(r * r + c * c)).alias(value))


def shuffle_within(net: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """Values shuffled within the key, by a seeded hash."""
    cols = [c for c in net.columns if c != value]
    a = net.select(*cols, F.row_number().over(W.partitionBy(key).orderBy(*cols)).alias("__o"))
    b = net.select(F.col(key).alias("__k"), F.col(value), F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), *cols), *cols)).alias("__p"))
    return a.join(b, (F.col(key) == F.col("__k")) & (F.col("__o") == F.col("__p"))).select(*net.columns)


def lioness_pearson(expr: DataFrame) -> DataFrame:
    """(i, j, sample, score), i < j: N r - (N - 1) r without the sample, in closed form from sums."""
    a, b = expr.alias("a"), expr.alias("b")
    p = a.join(b, (F.col("a.sample") == F.col("b.sample")) & (F.col("a.gene") < F.col("b.gene"))).select(
        F.col("a.gene").alias("i"), F.col("b.gene").alias("j"), F.col("a.sample").alias("sample"), F.col("a.value").alias("x"), F.col("b.value").alias("y")
    )
    sums = {"n": F.count(F.lit(1)), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(F.col("x") * F.col("x")), "syy": F.sum(F.col("y") * F.col("y")), "sxy": F.sum(F.col("x") * F.col("y"))}
    p = p.join(p.groupBy("i", "j").agg(*(v.alias(k) for k, v in sums.items())), ["i", "j"])

    def r(n: Column, sx, sy, sxx, syy, sxy) -> Column:
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        return F.when((vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx * vy)).otherwise(0.0)

    c = [F.col(k) for k in sums]
    x, y = F.col("x"), F.col("y")
    less = [c[0] - 1, c[1] - x, c[2] - y, c[3] - x * x, c[4] - y * y, c[5] - x * y]
    return p.select("i", "j", "sample", (c[0] * (r(*c) - r(*less)) + r(*less)).alias("score"))


def targeting(networks: DataFrame, key: str = "gene") -> DataFrame:
    """Per-sample degree sums of (tf, gene, sample, score)."""
    return networks.groupBy("sample", key).agg(F.sum("score").alias("score"))


def top_edges(net: DataFrame, n: int, value: str = "score", loops: bool = True) -> DataFrame:
    """The n strongest edges; ties by ends. Without ``loops``, edges of a tf to itself are left out."""
    net = net if loops else net.where(F.col("tf").cast("string") != F.col("gene").cast("string"))
    return net.orderBy(F.desc(value), "tf", "gene").limit(n)


def top_by_size(net: DataFrame, k: int, value: str = "score") -> DataFrame:
    """Edges at least as large in size as the k-th, ties kept."""
    cut = net.select(F.abs(F.col(value)).alias("s")).orderBy(F.desc("s")).limit(k).agg(F.min("s").alias("cut"))
    return net.crossJoin(F.broadcast(cut)).where(F.abs(F.col(value)) >= F.col("cut")).drop("cut")  # one row


def targeted_genes(net: DataFrame, tfs: list) -> DataFrame:
    return net.where(F.col("tf").isin(list(tfs))).select("gene").distinct()


def subnetwork(net: DataFrame, tfs: list) -> DataFrame:
    return net.where(F.col("tf").isin(list(tfs)))


def panda_edges(net: DataFrame, threshold: float | None = None, transform: bool = False) -> DataFrame:
    """Unweighted edges of (tf, gene, motif, score) for community search, strong ones only. The
    default threshold is the mean of the medians of ln(e^s + 1) over prior and other edges;
    ``transform`` compares transformed scores instead of raw ones. The larger side is red."""
    soft = F.log1p(F.exp("score"))
    if threshold is None:
        m = net.groupBy((F.col("motif") > 0).alias("prior")).agg(F.median(soft).alias("m")).agg(F.avg("m")).first()[0]
        threshold = m if m is not None else 0.0
    kept = net.where((soft if transform else F.col("score")) >= threshold)
    n_tf, n_gene = kept.agg(F.count_distinct("tf"), F.count_distinct("gene")).first()
    red, blue = ("gene", "tf") if n_gene >= n_tf else ("tf", "gene")
    return kept.select(F.col(red).cast("string").alias("red"), F.col(blue).cast("string").alias("blue"), F.lit(1.0).alias("weight"))
