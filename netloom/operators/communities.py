"""Bipartite communities: modularity, BRIM, and differential modularity of two networks.

Edges are (red, blue, weight); memberships (node, side, com) with side ``red`` or ``blue``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.stats import global_rank
from netloom.functions.tails import hypergeometric_upper, ks_greater, rank_sum_greater


def checkpoint_ready(df: DataFrame) -> DataFrame:
    """Cut the lineage on the shared folder (a temporary one only where none is configured)."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp())
    return df.checkpoint()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): least label reachable, with pointer jumping between rounds. Sides are
    told apart by prefixes r: and b:."""
    e = edges.select(F.concat(F.lit("r:"), F.col("red").cast("string")).alias("a"), F.concat(F.lit("b:"), F.col("blue").cast("string")).alias("b")).distinct()
    e = checkpoint_ready(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    label = checkpoint_ready(label)
    for _ in range(rounds):
        near = e.join(label, e["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("component", "m").alias("component"))
        up = step.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        new = checkpoint_ready(step.join(up, F.col("component") == F.col("__n"), "left").select("node", F.least("component", F.coalesce("__c", "component")).alias("component")))
        changed = not new.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").isEmpty()
        label = new
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def condor_object(edges: DataFrame, giant: bool = True) -> DataFrame:
    """Checked edges without zero weights, of the largest component (the least label on a tie)."""
    if not edges.where("red IS NULL OR blue IS NULL OR weight IS NULL OR red = '' OR blue = ''").isEmpty():
        raise ValueError("edges with a missing end or weight are not allowed")
    if not edges.select("red").intersect(edges.select("blue")).isEmpty():
        raise ValueError("a node can't be on both sides")
    e = edges.where("weight <> 0")
    if not giant:
        return e
    c = components(e)
    best = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    keep = c.join(F.broadcast(best), "component", "left_semi").where("node LIKE 'r:%'").select(F.substring("node", 3, 1 << 30).alias("red"))
    return e.join(keep, e["red"].cast("string") == keep["red"], "left_semi")


def modularity_matrix(edges: DataFrame) -> DataFrame:
    """(red, blue, b) for all pairs: (A - k d / m) / m."""
    k = edges.groupBy("red").agg(F.sum("weight").alias("k"))
    d = edges.groupBy("blue").agg(F.sum("weight").alias("d"))
    m = edges.agg(F.sum("weight").alias("m"))
    grid = k.crossJoin(d).crossJoin(F.broadcast(m)).join(edges, ["red", "blue"], "left")  # the result is dense
    return grid.select("red", "blue", ((F.coalesce("weight", F.lit(0.0)) - F.col("k") * F.col("d") / F.col("m")) / F.col("m")).alias("b"))


def community_q(edges: DataFrame, red: DataFrame, blue: DataFrame) -> DataFrame:
    """(com, q): modularity of each community, from sums: within / m - K D / m^2. Never dense."""
    e = edges.join(red.select(F.col("node").alias("red"), F.col("com").alias("rc")), "red").join(blue.select(F.col("node").alias("blue"), F.col("com").alias("bc")), "blue")
    m = edges.agg(F.sum("weight").alias("m"))
    within = e.groupBy(F.col("rc").alias("com")).agg(F.sum(F.when(F.col("rc") == F.col("bc"), F.col("weight")).otherwise(0.0)).alias("w"), F.sum("weight").alias("kk"))
    d = e.groupBy(F.col("bc").alias("com")).agg(F.sum("weight").alias("dd"))
    out = within.join(d, "com", "full").fillna(0.0).crossJoin(F.broadcast(m))
    return out.select("com", (F.col("w") / F.col("m") - F.col("kk") * F.col("dd") / (F.col("m") * F.col("m"))).alias("q"))


def q_scores(edges: DataFrame, red: DataFrame, blue: DataFrame) -> DataFrame:
    """(node, side, com, q): a node's share of its community's modularity; each side adds to 1/2."""
    q = community_q(edges, red, blue).withColumnRenamed("q", "cq")
    m = edges.agg(F.sum("weight").alias("m"))
    rc = red.select(F.col("node").alias("red"), F.col("com").alias("rc"))
    bc = blue.select(F.col("node").alias("blue"), F.col("com").alias("bc"))
    e = edges.join(rc, "red").join(bc, "blue")
    out = None
    for side, own, other in (("red", "rc", "bc"), ("blue", "bc", "rc")):
        total = e.groupBy(F.col(other).alias("com")).agg(F.sum("weight").alias("other_total"))
        node = e.groupBy(F.col(side).alias("node"), F.col(own).alias("com")).agg(
            F.sum(F.when(F.col("rc") == F.col("bc"), F.col("weight")).otherwise(0.0)).alias("w"), F.sum("weight").alias("k")
        )
        s = node.join(total, "com", "left").join(q, "com", "left").crossJoin(F.broadcast(m))
        inner = F.col("w") - F.col("k") * F.coalesce("other_total", F.lit(0.0)) / F.col("m")
        s = s.select("node", F.lit(side).alias("side"), "com", F.try_divide(inner, 2 * F.col("m") * F.col("cq")).alias("q"))
        out = s if out is None else out.unionByName(s)
    return out


def best_community(
    edges: DataFrame, side: str, other: str, degrees: DataFrame, opposite: DataFrame, opposite_degrees: DataFrame, m: float
) -> tuple[DataFrame, int]:
    """(node, com, g): the community of largest gain for each node of a side, and the largest label.

    A node's gain from a community is its weight there minus what degrees lead one to expect. From
    communities that it has no edge to it is negative, and least so for the one of the smallest total:
    only this one is looked at beside those a node has edges to. Nothing dense is made.
    """
    total = opposite.join(opposite_degrees, "node").groupBy("com").agg(F.sum("k").alias("t"))
    has = edges.join(opposite, edges[other] == opposite["node"]).groupBy(F.col(side).alias("node"), "com").agg(F.sum("weight").alias("w"))
    least = total.orderBy("t", "com").limit(1).select("com")  # one row
    empty = degrees.select("node").crossJoin(F.broadcast(least)).withColumn("w", F.lit(0.0))
    w = has.unionByName(empty).groupBy("node", "com").agg(F.sum("w").alias("w"))
    gain = F.col("w") - F.col("k") * F.col("t") / F.lit(m)
    gain = F.when(F.abs(gain) <= 2.2e-16 * max(m, 1.0), 0.0).otherwise(gain)
    rows = w.join(degrees, "node").join(total, "com").select("node", "com", gain.alias("g"))
    top = rows.groupBy("node").agg(F.min(F.struct((-F.col("g")).alias("g"), "com")).alias("x"))
    last = total.agg(F.max("com")).first()[0] or 0
    return top.select("node", F.col("x.com").cast("bigint").alias("com"), (-F.col("x.g")).alias("g")), last


def brim(edges: DataFrame, blue: DataFrame, least: float = 1e-4, rounds: int = 100) -> tuple[DataFrame, DataFrame, list[float]]:
    """Alternate best assignments of reds and blues, from a membership (node, com) of the blues,
    until modularity grows by no more than min(least, 1/m). A node goes to the community of
    largest gain (the least label on a tie, gains within rounding of 0 being 0); where all are
    negative it begins a community of its own.
    Returns red, blue and the modularities."""
    m = edges.agg(F.sum("weight")).first()[0]
    k = checkpoint_ready(edges.groupBy(F.col("red").alias("node")).agg(F.sum("weight").alias("k")))
    d = checkpoint_ready(edges.groupBy(F.col("blue").alias("node")).agg(F.sum("weight").alias("k")))

    def best(side: str, other: str, degrees: DataFrame, opposite: DataFrame, opposite_degrees: DataFrame) -> DataFrame:
        top, last = best_community(edges, side, other, degrees, opposite, opposite_degrees, m)
        lone = top.where("g < 0").select("node", (F.lit(last + 1) + F.monotonically_increasing_id()).alias("com"))
        return checkpoint_ready(top.where("g >= 0").select("node", "com").unionByName(lone))

    blue = checkpoint_ready(blue.select("node", F.col("com").cast("bigint").alias("com")))
    history: list[float] = []
    while len(history) < rounds:
        red = best("red", "blue", k, blue, d)
        blue = best("blue", "red", d, red, k)
        history.append(community_q(edges, red, blue).agg(F.sum("q")).first()[0])
        if len(history) > 1 and history[-1] - history[-2] <= min(least, 1 / m):
            return red, blue, history
    raise RuntimeError(f"communities did not settle in {rounds} rounds")


def projection(edges: DataFrame) -> DataFrame:
    """(i, j, w), i < j: blues that share reds, by the sum of the products of their weights."""
    a, b = edges.alias("a"), edges.alias("b")
    p = a.join(b, (F.col("a.red") == F.col("b.red")) & (F.col("a.blue") < F.col("b.blue")))
    return p.groupBy(F.col("a.blue").alias("i"), F.col("b.blue").alias("j")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("w"))


def seed_communities(edges: DataFrame, method: str = "LCS", project: bool = True, limit: int = 4_000_000) -> DataFrame:
    """(node, com) of the blues: Louvain (LCS), leading eigenvectors (LEC) or greedy merging (FG) of the
    projection of the network on them, or of the whole network taken as one-sided."""
    if method not in SEEDS:
        raise ValueError(f"method is one of {', '.join(SEEDS)}")
    kind = edges.select("blue").dtypes[0][1]
    if project and method == "LCS":
        from netloom.operators.tiles import sheet

        blues, reds, _, (w,) = sheet(edges, "weight", row="blue", col="red")  # the projection's cells off its diagonal are w w'
        deg = w @ w.sum(0) - (w * w).sum(1)
        com = factored_louvain(np.column_stack((w, deg / np.sqrt(max(deg.sum(), 1e-12)))), np.r_[np.ones(len(reds)), -1.0])
        return edges.sparkSession.createDataFrame(pd.DataFrame({"node": blues, "com": com.astype("int64")}), f"node {kind}, com bigint")
    pairs = projection(edges) if project else edges.select(F.concat(F.lit("r:"), F.col("red").cast("string")).alias("i"), F.concat(F.lit("b:"), F.col("blue").cast("string")).alias("j"), F.col("weight").alias("w"))
    pairs = checkpoint_ready(pairs.groupBy("i", "j").agg(F.sum("w").alias("w")))
    blues = [r[0] for r in edges.select("blue").distinct().orderBy("blue").limit(limit + 1).collect()]
    nodes = blues if project else sorted({x for r in pairs.select("i", "j").limit(limit + 1).collect() for x in r})
    if len(nodes) ** 2 > limit or pairs.count() > limit:
        raise ValueError("the network is too large for the sequential seed; give a seed of your own")
    at = {x: i for i, x in enumerate(nodes)}
    mat = np.zeros((len(nodes), len(nodes)))
    for i, j, w in pairs.collect():
        mat[at[i], at[j]] = mat[at[j], at[i]] = w
    deg, total = mat.sum(1), max(mat.sum(), 1e-12)
    com = SEEDS[method](mat - np.outer(deg, deg) / total)
    return edges.sparkSession.createDataFrame([(x, int(com[at[x if project else f"b:{x}"]])) for x in blues], f"node {kind}, com bigint")


def condor_cluster(edges: DataFrame, seed: DataFrame | None = None, method: str = "LCS", project: bool = True):
    """Bipartite communities from a seed of the blues, or from ``seed_communities``. The assignments
    work on sums per node and community throughout, so there is no variant for low memory."""
    edges = checkpoint_ready(edges)  # read in every round
    return brim(edges, seed if seed is not None else seed_communities(edges, method, project))


def leading_eigenvectors(b: np.ndarray) -> np.ndarray:
    """Labels by splitting groups in two by the sign of the leading eigenvector of their modularity
    matrix (generalised: rows add to zero within the group), as long as modularity grows."""
    label = np.zeros(len(b), int)
    todo, last = [np.arange(len(b))], 0
    while todo:
        g = todo.pop()
        sub = b[np.ix_(g, g)]
        sub = sub - np.diag(sub.sum(1))
        val, vec = np.linalg.eigh(sub)
        side = vec[:, -1] >= 0
        sign = np.where(side, 1.0, -1.0)
        if val[-1] <= 1e-9 or side.all() or not side.any() or sign @ sub @ sign <= 1e-9:
            continue
        last += 1
        label[g[~side]] = last
        todo += [g[side], g[~side]]
    return label


def greedy_merging(b: np.ndarray) -> np.ndarray:
    """Labels by merging the pair of groups of largest gain until none gains."""
    mat = b.astype(float).copy()
    np.fill_diagonal(mat, -np.inf)
    label = np.arange(len(b))
    while len(b):
        i, j = sorted(divmod(int(np.argmax(mat)), len(mat)))
        if not mat[i, j] > 1e-12:
            break
        mat[i] += mat[j]
        mat[:, i] = mat[i]
        mat[i, i] = -np.inf
        mat[j], mat[:, j] = -np.inf, -np.inf
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1] if len(b) else label


def _merged(com: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels numbered by first appearance, and how many there are."""
    _, first, tidy = np.unique(com, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[tidy], len(first)


def _local_moves(n: int, gains, moved_to, passes: int) -> np.ndarray:
    """Ordered moves of nodes to the community of largest gain (lowest label on ties) until none moves.
    ``gains(i, com)`` has a node's gain from each label, itself left out."""
    com = np.arange(n)
    for _ in range(passes):
        moved = False
        for i in range(n):
            gain = gains(i, com)
            top = int(np.argmax(gain))
            if gain[top] - gain[com[i]] > 1e-12:
                moved_to(i, com[i], top)
                com[i] = top
                moved = True
        if not moved:
            break
    return com


def louvain(b: np.ndarray, passes: int = 50) -> np.ndarray:
    """Generalised Louvain on a symmetric modularity matrix: ordered local moves to the community
    of largest gain (lowest label on ties), then aggregation, until nothing changes. Labels are
    numbered by first appearance."""
    i, j = np.nonzero(b)
    return sparse_louvain(len(b), i, j, b[i, j], passes)


def sparse_louvain(n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray, passes: int = 50) -> np.ndarray:
    """``louvain`` on the cells (i, j, v) of a symmetric matrix, both ways; absent ones are 0."""
    whole = np.arange(n)
    while n:
        off = i != j  # a node's own cell is in none of its gains
        order = np.lexsort((j[off], i[off]))
        cols, w = j[off][order], v[off][order]
        at = np.searchsorted(i[off][order], np.arange(n + 1))
        com = _local_moves(n, lambda k, com: np.bincount(com[cols[at[k] : at[k + 1]]], w[at[k] : at[k + 1]], n), lambda *_: None, passes)  # noqa: B023
        com, m = _merged(com)
        whole = com[whole]
        if m == n:
            break
        key, place = np.unique(com[i] * m + com[j], return_inverse=True)
        i, j, v, n = key // m, key % m, np.bincount(place, v, len(key)).astype(float), m
    return whole


def factored_louvain(x: np.ndarray, sign: np.ndarray, passes: int = 50) -> np.ndarray:
    """``louvain`` on a matrix whose cells off the diagonal are x sign x', of nodes x factors: a community's
    sum of factors gives the gain of any node, so that the matrix itself isn't made."""
    whole = np.arange(len(x))
    while len(x):
        total, count = x.copy(), np.ones(len(x), int)

        def gains(i: int, com: np.ndarray) -> np.ndarray:
            own = x[i] * sign  # noqa: B023
            g = total @ own  # noqa: B023
            g[com[i]] = g[com[i]] - own @ x[i] if count[com[i]] > 1 else 0.0  # noqa: B023
            return g

        def moved_to(i: int, now: int, top: int) -> None:
            count[now] -= 1  # noqa: B023
            count[top] += 1  # noqa: B023
            total[now] = total[now] - x[i] if count[now] else 0.0  # noqa: B023
            total[top] += x[i]  # noqa: B023

        com, m = _merged(_local_moves(len(x), gains, moved_to, passes))
        whole = com[whole]
        if m == len(x):
            break
        merged = np.zeros((m, x.shape[1]))
        np.add.at(merged, com, x)
        x = merged
    return whole


#: Ways to seed bipartite communities, on a modularity matrix.
SEEDS = {"LCS": louvain, "LEC": leading_eigenvectors, "FG": greedy_merging}


def core_enrichment(test: list, q: pd.DataFrame, permutations: int = 0, seed: int = 0) -> dict[str, float]:
    """One-sided KS and rank-sum tests that the test nodes have larger scores; with permutations
    also (1 + exceedances) / permutations for both."""
    hit = q["node"].isin(test).to_numpy()
    x = q["q"].to_numpy()
    d, ks = ks_greater(x[hit], x[~hit])
    w, p = rank_sum_greater(x[hit], x[~hit])
    out = {"ks_d": d, "ks_p": ks, "w": w, "w_p": p}
    if permutations:
        r = np.random.default_rng(seed)
        more = np.zeros(2)
        for _ in range(permutations):
            h = r.permutation(hit)
            more += [ks_greater(x[h], x[~h])[0] >= d, rank_sum_greater(x[h], x[~h])[0] >= w]
        out |= {"ks_perm": float((1 + more[0]) / permutations), "w_perm": float((1 + more[1]) / permutations)}
    return out


# --- differential modularity ------------------------------------------------


def dwbm(net: DataFrame, tf_com: DataFrame, gene_com: DataFrame) -> DataFrame:
    """(tf, gene, d) for all pairs of a network (tf, gene, a, b): b minus what the communities of
    the control a lead one to expect. With rho = sum a / sum b, expected = d k / mbar from sums of
    rho b over (tf, the gene's community), (gene, the tf's community) and both communities."""
    t = tf_com.select(F.col("node").alias("tf"), F.col("com").alias("tc"))
    g = gene_com.select(F.col("node").alias("gene"), F.col("com").alias("gc"))
    tot = net.agg(F.sum("a").alias("ma"), F.sum("b").alias("mb"))
    e = net.select("tf", "gene", "b").join(t, "tf").join(g, "gene")
    rows = e.groupBy("tf", "gc").agg(F.sum("b").alias("d"))
    cols = e.groupBy("gene", "tc").agg(F.sum("b").alias("k"))
    both = e.groupBy("tc", "gc").agg(F.sum("b").alias("s"))
    zero = F.lit(0.0)
    grid = t.join(net.select("tf").distinct(), "tf", "left_semi").crossJoin(g.join(net.select("gene").distinct(), "gene", "left_semi"))
    x = grid.join(net.select("tf", "gene", "b"), ["tf", "gene"], "left").join(rows, ["tf", "gc"], "left").join(cols, ["gene", "tc"], "left").join(both, ["tc", "gc"], "left").crossJoin(F.broadcast(tot))
    rho = F.col("ma") / F.col("mb")
    expected = rho * F.coalesce("d", zero) * rho * F.coalesce("k", zero) / (rho * F.coalesce("s", zero) + 0.01)
    return x.select("tf", "gene", ((F.coalesce("b", zero) - expected) / F.col("mb")).alias("d"))


def module_scores(d: DataFrame, tf_mod: DataFrame, gene_mod: DataFrame) -> DataFrame:
    """(node, side, module, score): a node's sum within its module over the module's sum."""
    e = d.join(tf_mod.select(F.col("node").alias("tf"), F.col("com").alias("tm")), "tf").join(gene_mod.select(F.col("node").alias("gene"), F.col("com").alias("gm")), "gene").where("tm = gm")
    total = e.groupBy(F.col("tm").alias("module")).agg(F.sum("d").alias("t"))
    t = e.groupBy(F.col("tf").cast("string").alias("node"), F.col("tm").alias("module")).agg(F.sum("d").alias("s")).withColumn("side", F.lit("tf"))
    g = e.groupBy(F.col("gene").cast("string").alias("node"), F.col("gm").alias("module")).agg(F.sum("d").alias("s")).withColumn("side", F.lit("gene"))
    return t.unionByName(g).join(total, "module").select("node", "side", "module", F.coalesce(F.try_divide("s", "t"), F.lit(0.0)).alias("score"))


def top_genes(scores: DataFrame, lengths: list[int]) -> DataFrame:
    """(module, n, node, score): the best n genes of each module for each n."""
    r = F.row_number().over(W.partitionBy("module").orderBy(F.desc("score"), "node"))
    ranked = scores.where("side = 'gene'").withColumn("r", r).where(F.col("r") <= max(lengths))
    return ranked.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where("r <= n").select("module", "n", "node", "score")


def rotation_rank(one: DataFrame, two: DataFrame) -> DataFrame:
    """(node, deviation, rank): how far a node's community moves between two memberships: 1 minus
    the share of its first community that goes to its second one; largest first."""
    x = one.select("node", F.col("com").alias("c1")).join(two.select("node", F.col("com").alias("c2")), "node")
    n = x.groupBy("c1").agg(F.count(F.lit(1)).alias("n"))
    s = x.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m"))
    d = x.join(s, ["c1", "c2"]).join(n, "c1").select("node", (1 - F.col("m") / F.col("n")).alias("deviation"))
    return global_rank(d, "deviation", "rank", descending=True, ties="min").withColumn("rank", F.col("rank").cast("int"))


def control_communities(net: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(node, com) of the tfs and of the genes of (tf, gene, a, b) from the positive edges of a. Nodes
    without such an edge get a community by a seeded hash."""
    control = net.where("a > 0").select(F.col("gene").alias("red"), F.col("tf").alias("blue"), F.col("a").alias("weight"))
    red, blue, _ = condor_cluster(control)
    coms = checkpoint_ready(red.select("com").union(blue.select("com")).distinct())
    every = F.lit([r[0] for r in coms.orderBy("com").collect()] or [0])  # a number for each community

    def completed(side: str, known: DataFrame) -> DataFrame:
        any_com = F.element_at(every, (F.pmod(F.xxhash64("node", F.lit(seed)), F.size(every)) + 1).cast("int"))
        x = net.select(F.col(side).alias("node")).distinct().join(known, "node", "left")
        return checkpoint_ready(x.select("node", F.coalesce("com", any_com.cast("bigint")).alias("com")))

    return completed("tf", blue), completed("gene", red)


def bipartite_louvain(d: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(node, com) of tfs and of genes by generalised Louvain over (tf, gene, d). The search is sequential: cells
    are checked against ``limit`` before they come to the driver; nothing of the size nodes x nodes is made."""
    from netloom.operators.tiles import sheet

    if d.count() > limit:
        raise ValueError("too many tfs and genes for the sequential module search")
    tfs, genes, _, (w,) = sheet(d.withColumns({"tf": F.col("tf").cast("string"), "gene": F.col("gene").cast("string")}), "d")
    i, j = np.nonzero(w)
    v, j = w[i, j], j + len(tfs)
    com = sparse_louvain(len(tfs) + len(genes), np.r_[i, j], np.r_[j, i], np.r_[v, v])
    make = lambda names, c: d.sparkSession.createDataFrame(pd.DataFrame({"node": names, "com": c.astype("int64")}), "node string, com bigint")
    return make(tfs, com[: len(tfs)]), make(genes, com[len(tfs) :])


def alpaca(net: DataFrame, limit: int = 50_000_000) -> DataFrame:
    """(node, side, module, score) of a network (tf, gene, a, b): control communities by BRIM,
    differential modularity, generalised Louvain, scores. The sequential last step holds tfs x genes
    cells, which are checked against ``limit`` first."""
    named = checkpoint_ready(net.select(F.col("tf").cast("string").alias("tf"), F.col("gene").cast("string").alias("gene"), "a", "b"))
    tf_com, gene_com = control_communities(named)
    d = checkpoint_ready(dwbm(named, tf_com, gene_com))
    return module_scores(d, *bipartite_louvain(d, limit))


def test_node_rank(ordered: list, positives: set) -> dict[str, float]:
    """Rank-sum, KS and Fisher (top tenth) tests that positives come early in an order."""
    hit = np.array([x in positives for x in ordered])
    score = -np.arange(len(ordered), dtype=float)
    top = np.arange(len(ordered)) < max(1, len(ordered) // 10)
    a, b, c, d = (int((hit & top).sum()), int((~hit & top).sum()), int((hit & ~top).sum()), int((~hit & ~top).sum()))
    return {
        "rank_sum_p": rank_sum_greater(score[hit], score[~hit])[1], "ks_p": ks_greater(score[hit], score[~hit])[1],
        "fisher_p": hypergeometric_upper(a, a + c, b + d, a + b), "odds": a * d / (b * c) if b * c else float("inf"),
    }


def gene_set_overlap(modules: DataFrame, sets: DataFrame, background: int) -> DataFrame:
    """(module, set, overlap, p): hypergeometric enrichment of (module, gene) in (set, gene)."""
    n = modules.groupBy("module").agg(F.count_distinct("gene").alias("n"))
    k = sets.groupBy("set").agg(F.count_distinct("gene").alias("k"))
    o = modules.distinct().join(sets.distinct(), "gene").groupBy("module", "set").agg(F.count(F.lit(1)).alias("overlap")).join(n, "module").join(k, "set")

    @F.pandas_udf("double")
    def tail(o: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric_upper(int(a), int(c), background - int(c), int(b)) for a, b, c in zip(o, n, k, strict=True)])

    return o.select("module", "set", "overlap", tail("overlap", "n", "k").alias("p"))
