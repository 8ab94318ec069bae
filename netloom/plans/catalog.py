"""Registered queries over the relational tables, and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import stats
from netloom.functions.stats import tidy
from netloom.operators import communities as C
from netloom.operators import inference as I
from netloom.operators import networks as N
from netloom.operators import preprocessing as P
from netloom.operators import subnetworks as S
from netloom.sources import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_LINES = """lines AS (
  SELECT l_suppkey AS tf, p_brand AS gene, l_partkey AS part, p_type AS kind, l_quantity AS q, l_returnflag AS flag,
         year(l_shipdate) AS year, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS sample
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_NET = """net AS (
  SELECT tf, gene, sum(CASE WHEN year % 2 = 0 THEN q ELSE 0 END) AS a, sum(CASE WHEN year % 2 = 1 THEN q ELSE 0 END) AS b,
         max(CASE WHEN flag = 'R' AND q >= 45 THEN 1.0 ELSE 0.0 END) AS motif
  FROM lines GROUP BY tf, gene)"""
_EXPR = """e0 AS (SELECT gene, sample, sum(q) AS value FROM lines GROUP BY gene, sample),
expr AS (SELECT g.gene, s.sample, coalesce(e0.value, 0) AS value
  FROM (SELECT DISTINCT gene FROM e0) g CROSS JOIN (SELECT DISTINCT sample FROM e0) s LEFT JOIN e0 ON e0.gene = g.gene AND e0.sample = s.sample)"""
_PPI = """ppi AS (
  SELECT a.s_suppkey AS i, b.s_suppkey AS j, 1.0 AS weight FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey)"""
_SPARSE = "sparse AS (SELECT tf, part AS gene, sum(q) AS weight FROM lines GROUP BY tf, part)"
_COM = "tfc AS (SELECT DISTINCT tf, tf % 4 AS com FROM lines), gec AS (SELECT DISTINCT gene, CAST(substr(gene, 7, 1) AS BIGINT) % 4 AS com FROM lines)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def query(name: str, sql: str | None = None, *parts: str):
    """Register a query, with its SQL after the named common tables."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {', '.join(parts)}" if parts else "") + (sql if sql.startswith(",") else " " + sql)
        return f

    return add


def _net(spark, sf) -> DataFrame:
    return X.dense_network(spark, sf)


def _prior(spark, sf) -> DataFrame:
    return _net(spark, sf).select("tf", "gene", F.col("motif").alias("weight"))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def _members(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Fixed memberships of suppliers and brands, for queries that take one."""
    li = X.lines(spark, sf)
    t = li.select(F.col("tf").alias("node"), (F.col("tf") % 4).alias("com")).distinct()
    g = li.select(F.col("gene").alias("node"), (F.substring("gene", 7, 1).cast("bigint") % 4).alias("com")).distinct()
    return t, g


def _bipartite(spark, sf) -> DataFrame:
    return _net(spark, sf).where("a > 0").select(F.col("tf").alias("red"), F.col("gene").alias("blue"), F.col("a").alias("weight"))


def _groups(spark, sf) -> DataFrame:
    """Months by quarter."""
    return X.expression(spark, sf).select("sample").distinct().select("sample", (F.floor((F.col("sample") - 1) % 12 / 3)).cast("bigint").alias("grp"))


_GROUPS = "grp AS (SELECT sample, CAST(floor((sample - 1) % 12 / 3.0) AS BIGINT) AS grp FROM (SELECT DISTINCT sample FROM expr))"


@query("in_degree", f"SELECT gene, {r6('sum(a)')} AS degree FROM net GROUP BY gene", _LINES, _NET)
def in_degree(spark: SparkSession, sf: str):
    return _rounded(N.in_degree(_net(spark, sf), "a"), "degree")


@query("out_degree", f"SELECT tf, {r6('sum(a)')} AS degree FROM net GROUP BY tf", _LINES, _NET)
def out_degree(spark, sf):
    return _rounded(N.out_degree(_net(spark, sf), "a"), "degree")


@query("degree_diff", f"SELECT gene, {r6('sum(a) - sum(b)')} AS difference FROM net GROUP BY gene", _LINES, _NET)
def degree_diff(spark, sf):
    return _rounded(N.degree_difference(_net(spark, sf), "a", "b"), "difference")


@query(
    "diff_edges",
    """, f AS (SELECT *, cume_dist() OVER (ORDER BY a) fa, cume_dist() OVER (ORDER BY b) fb, cume_dist() OVER (ORDER BY a - b) fd, cume_dist() OVER (ORDER BY b - a) fe FROM net)
    SELECT tf, gene, a AS score, true AS cond FROM f WHERE fa * fd > 0.8 UNION ALL SELECT tf, gene, b, false FROM f WHERE fb * fe > 0.8""",
    _LINES, _NET,
)
def diff_edges(spark, sf):
    return N.diff_edges(_net(spark, sf), 0.8)


@query("merge_networks", "SELECT x.tf, x.gene, x.a, y.b FROM net x JOIN net y USING (tf, gene) WHERE x.a > 100 AND y.b > 100", _LINES, _NET)
def merge_networks(spark, sf):
    n = _net(spark, sf)
    return N.merge_networks(n.where("a > 100").select("tf", "gene", F.col("a").alias("score")), n.where("b > 100").select("tf", "gene", F.col("b").alias("score")))


@query("dup_edge_sum", f"SELECT tf, part AS gene, {r6('sum(q)')} AS weight FROM lines GROUP BY tf, part", _LINES)
def dup_edge_sum(spark, sf):
    return _rounded(N.sum_duplicates(X.lines(spark, sf).select("tf", F.col("part").alias("gene"), F.col("q").alias("weight"))), "weight")


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("el2adj", "SELECT tf, " + ", ".join(f"coalesce(sum(CASE WHEN gene = '{b}' THEN a END), 0) AS \"{b}\"" for b in _BRANDS) + " FROM net GROUP BY tf", _LINES, _NET)
def el2adj(spark, sf):
    return N.el2adj(_net(spark, sf).select("tf", "gene", F.col("a").alias("weight")), _BRANDS)


@query("adj2el", "SELECT t.tf, g.gene, coalesce(n.a, 0) AS weight FROM (SELECT DISTINCT tf FROM net) t CROSS JOIN (SELECT unnest([" + ", ".join(f"'{b}'" for b in _BRANDS) + "]) AS gene) g LEFT JOIN net n ON n.tf = t.tf AND n.gene = g.gene", _LINES, _NET)
def adj2el(spark, sf):
    return N.adj2el(el2adj(spark, sf))


@query("regulon", "SELECT tf, count(*) AS n, sum(a) AS total, CAST(count(*) AS DOUBLE) AS likelihood FROM net WHERE a > 0 GROUP BY tf", _LINES, _NET)
def regulon(spark, sf):
    r = N.el2regulon(_net(spark, sf).where("a > 0").select("tf", "gene", F.col("a").alias("weight")))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return r.select("tf", F.size("tfmode").cast("bigint").alias("n"), add(F.map_values("tfmode")).alias("total"), add("likelihood").alias("likelihood"))


@query("edge_tags", "SELECT tf || '_A' AS tagged_tf, gene || '_B' AS tagged_gene, CAST(tf AS VARCHAR) AS tf, gene FROM net", _LINES, _NET)
def edge_tags(spark, sf):
    t = N.add_tags(_net(spark, sf).select(F.col("tf").cast("string").alias("tf"), "gene"))
    return N.remove_tags(t.withColumns({"tagged_tf": F.col("tf"), "tagged_gene": F.col("gene")})).select("tagged_tf", "tagged_gene", "tf", "gene")


def _partial(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A prior and an expression with different genes."""
    return _prior(spark, sf).where("gene < 'Brand#44'"), X.expression(spark, sf).where("gene > 'Brand#21'")


@query("align_union", "SELECT g.gene, s.sample, coalesce(x.value, 0) AS value FROM (SELECT DISTINCT gene FROM net WHERE gene < 'Brand#44' UNION SELECT DISTINCT gene FROM expr WHERE gene > 'Brand#21') g CROSS JOIN (SELECT DISTINCT sample FROM expr) s LEFT JOIN (SELECT * FROM expr WHERE gene > 'Brand#21') x ON x.gene = g.gene AND x.sample = s.sample", _LINES, _NET, _EXPR)
def align_union(spark, sf):
    m, e = _partial(spark, sf)
    return N.align(m, e, X.ppi(spark, sf), "union")[1]


@query("align_intersection", "SELECT tf, gene, motif AS weight FROM net WHERE gene < 'Brand#44' AND gene > 'Brand#21'", _LINES, _NET)
def align_intersection(spark, sf):
    m, e = _partial(spark, sf)
    return N.align(m, e, X.ppi(spark, sf), "intersection")[0].select("tf", "gene", "weight")


@query("align_legacy", "SELECT gene, sample, value FROM expr WHERE gene > 'Brand#21'", _LINES, _EXPR)
def align_legacy(spark, sf):
    m, e = _partial(spark, sf)
    return N.align(m, e, X.ppi(spark, sf), "legacy")[1].select("gene", "sample", "value")


_CORR = "CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN 0 ELSE corr({x}, {y}) END"


@query("gene_corr", f"SELECT a.gene AS i, b.gene AS j, {r6('CASE WHEN a.gene = b.gene THEN 1 ELSE ' + _CORR.format(x='a.value', y='b.value') + ' END')} AS r FROM expr a JOIN expr b ON a.sample = b.sample AND a.gene <= b.gene GROUP BY a.gene, b.gene", _LINES, _EXPR)
def gene_corr(spark, sf):
    return _rounded(N.gene_correlation(X.expression(spark, sf)), "r")


@query("gene_corr_present", f"SELECT a.gene AS i, b.gene AS j, {r6('(CASE WHEN a.gene = b.gene THEN 1 ELSE ' + _CORR.format(x='a.value', y='b.value') + ' END) * count(*) FILTER (WHERE a.value > 0 AND b.value > 0) / count(*)')} AS r FROM expr a JOIN expr b ON a.sample = b.sample AND a.gene <= b.gene GROUP BY a.gene, b.gene", _LINES, _EXPR)
def gene_corr_present(spark, sf):
    return _rounded(N.gene_correlation(X.expression(spark, sf), True), "r")


_RANKED = "rk AS (SELECT gene, sample, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS value FROM expr)"


@query("spearman", f"SELECT a.gene AS i, b.gene AS j, {r6('CASE WHEN a.gene = b.gene THEN 1 ELSE ' + _CORR.format(x='a.value', y='b.value') + ' END')} AS r FROM rk a JOIN rk b ON a.sample = b.sample AND a.gene <= b.gene GROUP BY a.gene, b.gene", _LINES, _EXPR, _RANKED)
def spearman(spark, sf):
    return _rounded(N.spearman(X.expression(spark, sf)), "r")


@query(
    "kendall",
    f"""SELECT i, j, {r6('CASE WHEN sum(d * d) = 0 OR sum(e * e) = 0 THEN 0 ELSE sum(d * e) / sqrt(sum(d * d) * sum(e * e)) END')} AS r FROM (
      SELECT p.gene AS i, x.gene AS j, sign(p.value - q.value) AS d, sign(x.value - y.value) AS e
      FROM expr p JOIN expr q ON p.gene = q.gene AND p.sample < q.sample JOIN expr x ON x.sample = p.sample AND x.gene > p.gene JOIN expr y ON y.gene = x.gene AND y.sample = q.sample) GROUP BY i, j""",
    _LINES, _EXPR,
)
def kendall(spark, sf):
    return _rounded(N.kendall(X.expression(spark, sf)), "r")


@query(
    "normalize_network",
    f""", z AS (SELECT tf, gene, (a - avg(a) OVER t) / nullif(stddev_pop(a) OVER t, 0) AS r, (a - avg(a) OVER g) / nullif(stddev_pop(a) OVER g, 0) AS c, (a - avg(a) OVER ()) / nullif(stddev_pop(a) OVER (), 0) AS w
    FROM net WINDOW t AS (PARTITION BY tf), g AS (PARTITION BY gene)) SELECT tf, gene, {r6('(coalesce(r, w) + coalesce(c, w)) / sqrt(2)')} AS score FROM z""",
    _LINES, _NET,
)
def normalize_network(spark, sf):
    return _rounded(N.normalize_network(_net(spark, sf).select("tf", "gene", F.col("a").alias("score"))), "score")


_TAN = "round(coalesce(s / nullif(sqrt(abs(nx + ny - abs(s))), 0), 0), 6) + 0.0"


@query(
    "tanimoto_ppi_motif",
    f""", s AS (SELECT ppi.i, net.gene AS j, sum(ppi.weight * motif) AS s FROM ppi JOIN net ON net.tf = ppi.j GROUP BY 1, 2),
    nx AS (SELECT i, sum(weight * weight) AS nx FROM ppi GROUP BY i), ny AS (SELECT gene AS j, sum(motif * motif) AS ny FROM net GROUP BY gene)
    SELECT i, j, {_TAN} AS v FROM s JOIN nx USING (i) JOIN ny USING (j)""",
    _LINES, _NET, _PPI,
)
def tanimoto_ppi_motif(spark, sf):
    p = X.ppi(spark, sf).select("i", F.col("j").alias("k"), F.col("weight").alias("v"))
    return _rounded(N.tanimoto(p, _net(spark, sf).select(F.col("tf").alias("k"), F.col("gene").alias("j"), F.col("motif").alias("v"))), "v")


@query(
    "tanimoto_motif_coexp",
    f""", s AS (SELECT net.tf AS i, co.j, sum(motif * co.r) AS s FROM net JOIN co ON co.i = net.gene GROUP BY 1, 2),
    nx AS (SELECT tf AS i, sum(motif * motif) AS nx FROM net GROUP BY tf), ny AS (SELECT j, sum(r * r) AS ny FROM co GROUP BY j)
    SELECT i, j, {_TAN} AS v FROM s JOIN nx USING (i) JOIN ny USING (j)""",
    _LINES, _NET, _EXPR, "co AS (SELECT a.gene AS i, b.gene AS j, CASE WHEN a.gene = b.gene THEN 1 ELSE " + _CORR.format(x="a.value", y="b.value") + " END AS r FROM expr a JOIN expr b USING (sample) GROUP BY a.gene, b.gene)",
)
def tanimoto_motif_coexp(spark, sf):
    c = N.gene_correlation(X.expression(spark, sf))
    c = c.unionByName(c.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    w = _net(spark, sf).select(F.col("tf").alias("i"), F.col("gene").alias("k"), F.col("motif").alias("v"))
    return _rounded(N.tanimoto(w, c.select(F.col("i").alias("k"), "j", F.col("r").alias("v"))), "v")


@query("update_diagonal", f"SELECT i, j, CASE WHEN i = j THEN {r6('coalesce(stddev_pop(CASE WHEN i <> j THEN r END) OVER (PARTITION BY i), 0) * 25 * exp(0.4)')} ELSE {r6('r')} END AS v FROM co", _LINES, _EXPR, "co AS (SELECT a.gene AS i, b.gene AS j, CASE WHEN a.gene = b.gene THEN 1 ELSE " + _CORR.format(x="a.value", y="b.value") + " END AS r FROM expr a JOIN expr b USING (sample) GROUP BY a.gene, b.gene)")
def update_diagonal(spark, sf):
    c = N.gene_correlation(X.expression(spark, sf))
    c = c.unionByName(c.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    return _rounded(N.update_diagonal(c.select("i", "j", F.col("r").alias("v")), 25, 0.1, 2), "v")


@query("degree_adjust", f"SELECT tf, gene, {r6('a * sqrt(avg(a) OVER (PARTITION BY tf) ** 2 + avg(a) OVER (PARTITION BY gene) ** 2)')} AS score FROM net", _LINES, _NET)
def degree_adjust(spark, sf):
    return _rounded(N.degree_adjust(_net(spark, sf).select("tf", "gene", F.col("a").alias("score"))), "score")


@query(
    "lioness_pearson",
    f""", p AS (SELECT a.gene AS i, b.gene AS j, a.sample, a.value AS x, b.value AS y FROM expr a JOIN expr b ON a.sample = b.sample AND a.gene < b.gene),
    s AS (SELECT i, j, count(*) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy FROM p GROUP BY i, j),
    l AS (SELECT i, j, sample, n, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r,
      ((n - 1) * (sxy - x * y) - (sx - x) * (sy - y)) / sqrt(((n - 1) * (sxx - x * x) - (sx - x) ** 2) * ((n - 1) * (syy - y * y) - (sy - y) ** 2)) AS q FROM p JOIN s USING (i, j))
    SELECT i, j, sample, round(n * r - (n - 1) * q, 5) + 0.0 AS score FROM l""",
    _LINES, _EXPR,
)
def lioness_pearson(spark, sf):
    return N.lioness_pearson(X.expression(spark, sf)).withColumn("score", tidy(F.col("score"), 5))


@query("lioness_targeting", f"SELECT sample, gene, {r6('sum(q)')} AS score FROM lines GROUP BY sample, gene", _LINES)
def lioness_targeting(spark, sf):
    li = X.lines(spark, sf).groupBy("tf", "gene", "sample").agg(F.sum("q").alias("score"))
    return _rounded(N.targeting(li), "score")


@query("top_edges", "SELECT tf, gene, a, b, motif FROM net ORDER BY a DESC, tf, gene LIMIT 50", _LINES, _NET)
def top_edges(spark, sf):
    return N.top_edges(_net(spark, sf), 50, "a")


@query("top_by_size", "SELECT tf, gene, a - b AS d FROM net WHERE abs(a - b) >= (SELECT min(s) FROM (SELECT abs(a - b) AS s FROM net ORDER BY s DESC LIMIT 40))", _LINES, _NET)
def top_by_size(spark, sf):
    return N.top_by_size(_net(spark, sf).select("tf", "gene", (F.col("a") - F.col("b")).alias("d")), 40, "d")


@query("targeted_genes", "SELECT DISTINCT gene FROM sparse WHERE tf IN (1, 2, 3)", _LINES, _SPARSE)
def targeted_genes(spark, sf):
    return N.targeted_genes(X.sparse_network(spark, sf), [1, 2, 3])


@query("subnetwork_by_tf", f"SELECT tf, gene, {r6('weight')} AS weight FROM sparse WHERE tf IN (4, 5)", _LINES, _SPARSE)
def subnetwork_by_tf(spark, sf):
    return _rounded(N.subnetwork(X.sparse_network(spark, sf), [4, 5]), "weight")


@query(
    "condor_threshold_edges",
    """, t AS (SELECT tf, gene, motif, a / 100 AS score FROM net), m AS (SELECT median(ln(exp(score) + 1)) AS m FROM t GROUP BY motif > 0)
    SELECT CAST(CASE WHEN (SELECT count(DISTINCT gene) >= count(DISTINCT tf) FROM k) THEN gene ELSE CAST(tf AS VARCHAR) END AS VARCHAR) AS red,
      CAST(CASE WHEN (SELECT count(DISTINCT gene) >= count(DISTINCT tf) FROM k) THEN CAST(tf AS VARCHAR) ELSE gene END AS VARCHAR) AS blue, 1.0 AS weight
    FROM (SELECT * FROM t WHERE score >= (SELECT avg(m) FROM m)) k""".replace("FROM k)", "FROM (SELECT * FROM t WHERE score >= (SELECT avg(m) FROM m)))").replace(" 1.0 AS weight", " CAST(1 AS DOUBLE) AS weight"),
    _LINES, _NET,
)
def condor_threshold_edges(spark, sf):
    return N.panda_edges(_net(spark, sf).select("tf", "gene", "motif", (F.col("a") / 100).alias("score")))


@query("modularity_matrix", f", e AS (SELECT tf, gene, a AS w FROM net WHERE a > 0), k AS (SELECT tf, sum(w) k FROM e GROUP BY tf), d AS (SELECT gene, sum(w) d FROM e GROUP BY gene) SELECT k.tf AS red, d.gene AS blue, round((coalesce(e.w, 0) - k * d / (SELECT sum(w) FROM e)) / (SELECT sum(w) FROM e), 9) + 0.0 AS b FROM k CROSS JOIN d LEFT JOIN e ON e.tf = k.tf AND e.gene = d.gene", _LINES, _NET)
def modularity_matrix(spark, sf):
    return C.modularity_matrix(_bipartite(spark, sf)).withColumn("b", tidy(F.col("b"), 9))


_Q = """e AS (SELECT net.tf, net.gene, a AS w, tfc.com AS rc, gec.com AS bc FROM net JOIN tfc USING (tf) JOIN gec USING (gene) WHERE a > 0),
m AS (SELECT sum(w) AS m FROM e),
cq AS (SELECT c.com, (SELECT coalesce(sum(w), 0) FROM e WHERE rc = c.com AND bc = c.com) / m - (SELECT coalesce(sum(w), 0) FROM e WHERE rc = c.com) * (SELECT coalesce(sum(w), 0) FROM e WHERE bc = c.com) / (m * m) AS q
  FROM (SELECT DISTINCT rc AS com FROM e UNION SELECT DISTINCT bc FROM e) c, m)"""


@query("bipartite_q", "SELECT com, round(q, 9) + 0.0 AS q FROM cq", _LINES, _NET, _COM, _Q)
def bipartite_q(spark, sf):
    t, g = _members(spark, sf)
    return C.community_q(_bipartite(spark, sf), t, g).withColumn("q", tidy(F.col("q"), 9))


@query(
    "q_scores",
    """, x AS (
      SELECT CAST(tf AS VARCHAR) AS node, 'red' AS side, rc AS com, sum(CASE WHEN rc = bc THEN w ELSE 0 END) AS w, sum(w) AS k FROM e GROUP BY tf, rc
      UNION ALL SELECT gene, 'blue', bc, sum(CASE WHEN rc = bc THEN w ELSE 0 END), sum(w) FROM e GROUP BY gene, bc)
    SELECT node, side, com, round((w - k * (SELECT coalesce(sum(e.w), 0) FROM e WHERE CASE WHEN side = 'red' THEN bc ELSE rc END = com) / m) / (2 * m * q), 5) + 0.0 AS q FROM x JOIN cq USING (com), m""",
    _LINES, _NET, _COM, _Q,
)
def q_scores(spark, sf):
    t, g = _members(spark, sf)
    e = _bipartite(spark, sf).withColumn("red", F.col("red").cast("string"))
    q = C.q_scores(e, t.withColumn("node", F.col("node").cast("string")), g)
    return q.withColumn("q", tidy(F.col("q"), 5))


_D = """e2 AS (SELECT net.tf, net.gene, a, b, tfc.com AS tc, gec.com AS gc FROM net JOIN tfc USING (tf) JOIN gec USING (gene)),
rho AS (SELECT sum(a) / sum(b) AS r, sum(b) AS mb FROM e2),
dw AS (SELECT t.tf, g.gene, t.com AS tc, g.com AS gc,
    (coalesce(n.b, 0) - r * coalesce((SELECT sum(b) FROM e2 WHERE e2.tf = t.tf AND e2.gc = g.com), 0) * r * coalesce((SELECT sum(b) FROM e2 WHERE e2.gene = g.gene AND e2.tc = t.com), 0)
      / (r * coalesce((SELECT sum(b) FROM e2 WHERE e2.tc = t.com AND e2.gc = g.com), 0) + 0.01)) / mb AS d
  FROM tfc t CROSS JOIN gec g CROSS JOIN rho LEFT JOIN net n ON n.tf = t.tf AND n.gene = g.gene)"""


@query("dwbm", "SELECT tf, gene, round(d, 10) + 0.0 AS d FROM dw", _LINES, _NET, _COM, _D)
def dwbm(spark, sf):
    t, g = _members(spark, sf)
    return C.dwbm(_net(spark, sf), t, g).withColumn("d", tidy(F.col("d"), 10))


@query(
    "module_scores",
    """, s AS (SELECT * FROM dw WHERE tc = gc), t AS (SELECT tc AS module, sum(abs(d)) AS t FROM s GROUP BY tc)
    SELECT CAST(tf AS VARCHAR) AS node, 'tf' AS side, tc AS module, round(sum(abs(d)) / any_value(t), 6) + 0.0 AS score FROM s JOIN t ON module = tc GROUP BY tf, tc
    UNION ALL SELECT gene, 'gene', gc, round(sum(abs(d)) / any_value(t), 6) + 0.0 FROM s JOIN t ON module = gc GROUP BY gene, gc""",
    _LINES, _NET, _COM, _D,
)
def module_scores(spark, sf):
    t, g = _members(spark, sf)
    d = C.dwbm(_net(spark, sf), t, g).withColumn("d", F.abs("d"))
    return _rounded(C.module_scores(d, t, g), "score")


@query("rotation_rank", """, x AS (SELECT gene AS node, CAST(substr(gene, 7) AS BIGINT) % 4 AS c1, CAST(substr(gene, 7) AS BIGINT) % 3 AS c2 FROM (SELECT DISTINCT gene FROM lines)),
    d AS (SELECT node, round(1 - CAST(count(*) OVER (PARTITION BY c1, c2) AS DOUBLE) / count(*) OVER (PARTITION BY c1), 9) AS deviation FROM x) SELECT node, deviation, CAST(rank() OVER (ORDER BY deviation DESC) AS INTEGER) AS rank FROM d""", _LINES)
def rotation_rank(spark, sf):
    g = X.lines(spark, sf).select("gene").distinct()
    part = lambda m: g.select(F.col("gene").alias("node"), (F.substring("gene", 7, 9).cast("bigint") % m).alias("com"))
    return C.rotation_rank(part(4), part(3)).withColumn("deviation", F.round("deviation", 9))


@query("top_genes_per_module", """, s AS (SELECT gene, CAST(substr(gene, 7, 1) AS BIGINT) % 4 AS module, sum(a) AS score FROM net GROUP BY gene),
    r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, gene) AS k FROM s) SELECT module, CAST(n AS INTEGER) AS n, gene AS node, score FROM r, unnest([2, 4]) AS u(n) WHERE k <= n""", _LINES, _NET)
def top_genes_per_module(spark, sf):
    s = _net(spark, sf).groupBy("gene").agg(F.sum("a").alias("score"))
    s = s.select(F.col("gene").alias("node"), F.lit("gene").alias("side"), (F.substring("gene", 7, 1).cast("bigint") % 4).alias("module"), "score")
    return C.top_genes(s, [2, 4])


_CE = "ce AS (SELECT DISTINCT 'r:' || tf AS a, 'b:' || part AS b FROM lines WHERE q >= 50)"


@query(
    "components",
    """, both_ways AS (SELECT a, b FROM ce UNION SELECT b, a FROM ce), nodes AS (SELECT DISTINCT a FROM both_ways), cc(node, c) USING KEY (node) AS (
      SELECT a, a FROM nodes
      UNION SELECT e.b, min(x.c) FROM cc x JOIN both_ways e ON e.a = x.node JOIN recurring.cc r ON r.node = e.b WHERE x.c < r.c GROUP BY e.b)
    SELECT node, c AS component FROM cc""",
    _LINES, _CE,
)
def components(spark, sf):
    """Components of the edges by which a supplier has shipped a whole lot of a part."""
    e = X.lines(spark, sf).where("q >= 50").select(F.col("tf").alias("red"), F.col("part").alias("blue")).distinct()
    return C.components(e)


ORACLE_SQL["components"] = ORACLE_SQL["components"].replace("WITH ", "WITH RECURSIVE ", 1)


def _significant(spark, sf) -> DataFrame:
    """Edges with an empirical p against those of odd years."""
    n = _net(spark, sf)
    return S.empirical_p(n.select("tf", "gene", F.col("a").alias("score")), n.select(F.col("b").alias("score")))


_PV = "pv AS (SELECT tf, gene, a AS score, CAST((SELECT count(*) FROM net y WHERE y.b > x.a) AS DOUBLE) / (SELECT count(*) FROM net) AS p FROM net x)"


@query("empirical_p", f"SELECT tf, gene, score, {r6('p')} AS p FROM pv", _LINES, _NET, _PV)
def empirical_p(spark, sf):
    return _rounded(_significant(spark, sf), "p")


@query("bh_fdr", f", r AS (SELECT tf, gene, p, p * count(*) OVER () / rank_hi AS v FROM (SELECT *, count(*) OVER (ORDER BY p) AS rank_hi FROM pv)) SELECT tf, gene, {r6('least(1, min(v) OVER (ORDER BY p DESC))')} AS q FROM r", _LINES, _NET, _PV)
def bh_fdr(spark, sf):
    return _rounded(stats.benjamini_hochberg(_significant(spark, sf), "p", "q").select("tf", "gene", "q"), "q")


_SIG = "sig AS (SELECT tf, gene, p FROM pv WHERE p < 0.4), seeds AS (SELECT DISTINCT gene AS seed FROM net WHERE gene IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14'))"
_H1 = "h1 AS (SELECT seed, sig.tf, sig.gene FROM seeds JOIN sig ON sig.gene = seed)"
_H2 = "h2 AS (SELECT DISTINCT f.seed, s.tf, s.gene FROM (SELECT DISTINCT seed, tf FROM h1) f JOIN sig s USING (tf) WHERE s.gene <> f.seed)"


def _hops(spark, sf, n: int) -> DataFrame:
    seeds = spark.createDataFrame([(f"Brand#1{i}",) for i in range(1, 5)], "node string")
    return S.all_hops(_significant(spark, sf).where("p < 0.4"), seeds, n)


@query("bfs_hop1", "SELECT seed, CAST(1 AS INTEGER) AS hop, tf, gene FROM h1", _LINES, _NET, _PV, _SIG, _H1)
def bfs_hop1(spark, sf):
    return _hops(spark, sf, 1)


@query("bfs_hop2", "SELECT seed, CAST(1 AS INTEGER) AS hop, tf, gene FROM h1 UNION ALL SELECT seed, CAST(2 AS INTEGER), tf, gene FROM h2", _LINES, _NET, _PV, _SIG, _H1, _H2)
def bfs_hop2(spark, sf):
    return _hops(spark, sf, 2)


@query(
    "connect_pairs",
    """, c1 AS (SELECT DISTINCT h.tf, h.gene FROM h1 h JOIN h1 o ON o.tf = h.tf AND o.seed <> h.seed)
    SELECT tf, gene FROM c1""",
    _LINES, _NET, _PV, _SIG, _H1,
)
def connect_pairs(spark, sf):
    return S.connections(_hops(spark, sf, 1))


@query("cpm_filter", ", t AS (SELECT sample, sum(value) AS t FROM expr GROUP BY sample), g AS (SELECT gene FROM expr JOIN t USING (sample) GROUP BY gene HAVING count(*) FILTER (WHERE value * 1e6 / t > 40000) >= 40) SELECT gene, sample, value FROM expr JOIN g USING (gene)", _LINES, _EXPR)
def cpm_filter(spark, sf):
    return P.filter_low_genes(X.expression(spark, sf), 40000.0, 40)


@query("missing_gene_filter", "SELECT gene, sample, value FROM expr WHERE gene IN (SELECT gene FROM expr GROUP BY gene HAVING sum(value) > 5000)", _LINES, _EXPR)
def missing_gene_filter(spark, sf):
    return P.filter_missing_genes(X.expression(spark, sf), 5000.0)


@query("coverage_filter", "SELECT gene, sample, value FROM expr WHERE gene IN (SELECT gene FROM expr GROUP BY gene HAVING count(*) FILTER (WHERE value <> 0) > 20)", _LINES, _EXPR)
def coverage_filter(spark, sf):
    return P.filter_covered(X.expression(spark, sf), 20)


@query("gene_label_anti", "SELECT gene, sample, value FROM expr WHERE gene NOT LIKE 'Brand#1%'", _LINES, _EXPR)
def gene_label_anti(spark, sf):
    e = X.expression(spark, sf)
    return P.filter_by_label(e, e.where("gene LIKE 'Brand#1%'").select("gene"), "gene").select("gene", "sample", "value")


@query("log_matrix", f"SELECT gene, sample, {r6('log2(value + 1)')} AS value FROM expr", _LINES, _EXPR)
def log_matrix(spark, sf):
    return _rounded(P.extract_matrix(X.expression(spark, sf)), "value")


@query("top_variable_genes", f"SELECT gene, {r6('stddev_samp(value)')} AS sd FROM expr GROUP BY gene HAVING sum(value) > 0 ORDER BY stddev_samp(value) DESC, gene LIMIT 10", _LINES, _EXPR)
def top_variable_genes(spark, sf):
    return _rounded(P.top_variable(X.expression(spark, sf), 10), "sd")


@query("cmds_distance", f"SELECT a.sample AS i, b.sample AS j, {r6('sqrt(sum((a.value - b.value) ** 2))')} AS d FROM expr a JOIN expr b ON a.gene = b.gene AND a.sample < b.sample GROUP BY 1, 2", _LINES, _EXPR)
def cmds_distance(spark, sf):
    return _rounded(P.sample_distance(X.expression(spark, sf)), "d")


_PLACE = "pl AS (SELECT expr.*, grp, row_number() OVER (PARTITION BY sample ORDER BY value, gene) AS place FROM expr JOIN grp USING (sample))"


@query("quantile_normalize", f", ref AS (SELECT grp, place, avg(value) AS r FROM pl GROUP BY 1, 2) SELECT gene, sample, {r6('avg(r) OVER (PARTITION BY sample, value)')} AS value FROM pl JOIN ref USING (grp, place)", _LINES, _EXPR, _GROUPS, _PLACE)
def quantile_normalize(spark, sf):
    return _rounded(P.quantile_normalize(X.expression(spark, sf), _groups(spark, sf)), "value")


@query(
    "qstats_weights",
    f""", m AS (SELECT place, avg(value) AS qref, var_pop(value) * count(*) AS sst FROM pl GROUP BY place), g AS (SELECT place, grp, avg(value) AS h, count(*) AS n FROM pl GROUP BY 1, 2),
    b AS (SELECT place, sum(n * (h - qref) ** 2) AS ssb FROM g JOIN m USING (place) GROUP BY place)
    SELECT CAST(place AS INTEGER) AS place, {r6('qref')} AS qref, round(sst, 3) AS sst, round(ssb, 3) AS ssb, {r6('CASE WHEN sst < 1e-6 THEN 1 ELSE 1 - ssb / sst END')} AS w FROM m JOIN b USING (place)""",
    _LINES, _EXPR, _GROUPS, _PLACE,
)
def qstats_weights(spark, sf):
    q = P.qstats(X.expression(spark, sf), _groups(spark, sf))
    return _rounded(q, "qref", "w").withColumns({"sst": F.round("sst", 3), "ssb": F.round("ssb", 3)})


_MUT = """mut AS (SELECT o_custkey AS sample, l_partkey AS gene, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
rt0 AS (SELECT sample, gene, n / p_size AS r FROM mut JOIN part ON p_partkey = gene), rt AS (SELECT sample, gene, r / sum(r) OVER (PARTITION BY sample) AS x FROM rt0)"""
_PATH = """sets AS (SELECT DISTINCT p_type AS set, p_partkey AS gene FROM part), sz AS (SELECT set, count(*) AS size FROM sets GROUP BY set), mf AS (SELECT gene, count(*) AS f FROM sets GROUP BY gene),
sc AS (SELECT sample, set, sum(x / f) / any_value(size) AS score FROM rt JOIN mf USING (gene) JOIN sets USING (gene) JOIN sz USING (set) GROUP BY 1, 2 HAVING sum(x) > 0)"""


def _rates(spark, sf) -> DataFrame:
    li, o = X.table(spark, sf, "lineitem"), X.table(spark, sf, "orders")
    m = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("sample"), F.col("l_partkey").alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    return P.gene_rate(m, X.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("length")))


def _pathways(spark, sf) -> DataFrame:
    return P.pathway_scores(_rates(spark, sf), X.table(spark, sf, "part").select(F.col("p_type").alias("set"), F.col("p_partkey").alias("gene")))


@query("sambar_gene_rate", f"SELECT sample, gene, {r6('x')} AS x FROM rt", _MUT)
def sambar_gene_rate(spark, sf):
    return _rounded(_rates(spark, sf), "x")


@query("sambar_pathway", "SELECT sample, set, round(score, 9) + 0.0 AS score FROM sc", _MUT, _PATH)
def sambar_pathway(spark, sf):
    return _pathways(spark, sf).withColumn("score", tidy(F.col("score"), 9))


@query(
    "binomial_distance",
    f""", p AS (SELECT a.sample AS i, b.sample AS j, t.set, coalesce(x.score, 0) AS x, coalesce(y.score, 0) AS y
      FROM (SELECT DISTINCT sample FROM sc) a JOIN (SELECT DISTINCT sample FROM sc) b ON a.sample < b.sample CROSS JOIN (SELECT DISTINCT set FROM sc) t
      LEFT JOIN sc x ON x.sample = a.sample AND x.set = t.set LEFT JOIN sc y ON y.sample = b.sample AND y.set = t.set)
    SELECT i, j, {r6('sum(CASE WHEN x + y > 0 THEN ((CASE WHEN x > 0 THEN x * ln(x / (x + y)) ELSE 0 END) + (CASE WHEN y > 0 THEN y * ln(y / (x + y)) ELSE 0 END)) / (x + y) + ln(2) ELSE 0 END)')} AS d FROM p GROUP BY i, j""",
    _MUT, _PATH,
)
def binomial_distance(spark, sf):
    return _rounded(P.binomial_distance(_pathways(spark, sf)), "d")


_LV = """lv AS (SELECT i, j, count(*) AS n, avg(w) AS m, var_pop(w) AS v FROM (SELECT a.gene AS i, b.gene AS j, a.z * b.z AS w
  FROM z a JOIN z b ON a.sample = b.sample AND a.gene <= b.gene) GROUP BY i, j)"""
_Z = "z AS (SELECT gene, sample, (value - avg(value) OVER (PARTITION BY gene)) / 1000 AS z FROM expr)"


@query("vars_esqs", f"SELECT i, j, {r6('n * n * v / (n - 1) ** 3')} AS var, {r6('m * m * n * n / (n - 1) ** 2')} AS esq FROM lv", _LINES, _EXPR, _Z, _LV)
def vars_esqs(spark, sf):
    return _rounded(I.layer_variances(X.expression(spark, sf).withColumn("value", F.col("value") / 1000)), "var", "esq")


@query(
    "dragon_risk_grid",
    f"""SELECT g1, g2, {r6('5 + (1 - g1 * g1) * -3 + (1 - g2 * g2) * -2 + (1 - g1 * g1) ** 2 * 4 + (1 - g2 * g2) ** 2 * 3 + (1 - g1 * g1) * (1 - g2 * g2) * 2 + g1 * g2 * -1')} AS risk
    FROM (SELECT i / 100.0 AS g1 FROM range(101) t(i)) CROSS JOIN (SELECT i / 100.0 AS g2 FROM range(101) t(i))""",
)
def dragon_risk_grid(spark, sf):
    from netloom.operators.kernels import dragon_risk

    axis = lambda n: spark.range(101).select((F.col("id") / 100.0).alias(n))
    g = axis("g1").crossJoin(F.broadcast(axis("g2")))  # 101 rows
    return g.withColumn("risk", tidy(dragon_risk((F.col("g1"), F.col("g2")), (5.0, -3.0, -2.0, 4.0, 3.0, 2.0, -1.0))))


_TM = "tm AS (SELECT CAST(year - 1995 AS INTEGER) AS perm, flag AS tf_from, gene AS tf_to, sum(q) / 1000 AS v FROM lines GROUP BY ALL)"
_SS = "ss AS (SELECT perm, tf_to AS tf, sum(v * v) AS s FROM tm GROUP BY 1, 2)"


def _transitions(spark, sf) -> DataFrame:
    return X.lines(spark, sf).groupBy((F.col("year") - 1995).cast("int").alias("perm"), F.col("flag").alias("tf_from"), F.col("gene").alias("tf_to")).agg((F.sum("q") / 1000).alias("v"))


@query("tm_zscore", f"SELECT o.tf, {r6('o.s')} AS ssodm, {r6('(o.s - avg(n.s)) / nullif(stddev_samp(n.s), 0)')} AS t FROM ss o JOIN ss n ON n.tf = o.tf AND n.perm > 0 WHERE o.perm = 0 GROUP BY o.tf, o.s", _LINES, _TM, _SS)
def tm_zscore(spark, sf):
    return _rounded(I.transition_stats(_transitions(spark, sf)).select("tf", "ssodm", "t"), "ssodm", "t")


@query("tm_nonparametric", f"SELECT o.tf, {r6('o.s')} AS ssodm, {r6('avg(CASE WHEN n.s <= o.s THEN 1.0 ELSE 0 END)')} AS t, {r6('1 - avg(CASE WHEN n.s <= o.s THEN 1.0 ELSE 0 END)')} AS p FROM ss o JOIN ss n ON n.tf = o.tf AND n.perm > 0 WHERE o.perm = 0 GROUP BY o.tf, o.s", _LINES, _TM, _SS)
def tm_nonparametric(spark, sf):
    return _rounded(I.transition_stats(_transitions(spark, sf), "non-parametric"), "ssodm", "t", "p")


@query(
    "anova_f",
    f""", g AS (SELECT gene, grp, avg(value) AS m, count(*) AS n, var_pop(value) * count(*) AS w FROM expr JOIN grp USING (sample) GROUP BY 1, 2),
    t AS (SELECT gene, sum(n * m) / sum(n) AS mm, sum(n) AS n, count(*) AS k, sum(w) AS w FROM g GROUP BY gene)
    SELECT gene, {r6('sum(g.n * (g.m - mm) ** 2) / (any_value(k) - 1) / (any_value(t.w) / (any_value(t.n) - any_value(k)))')} AS f FROM g JOIN t USING (gene) GROUP BY gene""",
    _LINES, _EXPR, _GROUPS,
)
def anova_f(spark, sf):
    return _rounded(P.anova(X.expression(spark, sf), _groups(spark, sf)).select("gene", "f"), "f")


@query(
    "numeric_association",
    f""", ph AS (SELECT sample, CAST(count(*) AS DOUBLE) AS y FROM lines GROUP BY sample) SELECT gene, {r6(_CORR.format(x='value', y='y'))} AS r FROM expr JOIN ph USING (sample) GROUP BY gene""",
    _LINES, _EXPR,
)
def numeric_association(spark, sf):
    ph = X.lines(spark, sf).groupBy("sample").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return _rounded(P.numeric_association(X.expression(spark, sf), ph), "r")


@query(
    "gsea_running_sum",
    f""", st AS (SELECT gene, sum(a) - sum(b) AS stat FROM net GROUP BY gene), rk AS (SELECT gene, stat, row_number() OVER (ORDER BY stat DESC, gene) AS place FROM st),
    sets AS (SELECT DISTINCT substr(gene, 1, 7) AS set FROM st), x AS (SELECT set, place, CASE WHEN substr(gene, 1, 7) = set THEN abs(stat) ELSE 0 END AS h, CASE WHEN substr(gene, 1, 7) = set THEN 0 ELSE 1 END AS m FROM rk CROSS JOIN sets),
    run AS (SELECT set, sum(h) OVER w / sum(h) OVER (PARTITION BY set) - CAST(sum(m) OVER w AS DOUBLE) / sum(m) OVER (PARTITION BY set) AS d FROM x WINDOW w AS (PARTITION BY set ORDER BY place ROWS UNBOUNDED PRECEDING))
    SELECT set, {r6('CASE WHEN max(d) >= -least(min(d), 0) THEN max(d) ELSE min(d) END')} AS es FROM run GROUP BY set""",
    _LINES, _NET,
)
def gsea_running_sum(spark, sf):
    st = N.degree_difference(_net(spark, sf), "a", "b").select("gene", F.col("difference").alias("stat"))
    return _rounded(P.running_sum(st, st.select(F.substring("gene", 1, 7).alias("set"), "gene")), "es")


@query(
    "egret_prior",
    f""", qb AS (SELECT DISTINCT l_partkey AS snp, l_suppkey AS tf, p_brand AS gene, l_discount - 0.05 AS effect FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48),
    q1 AS (SELECT snp, tf, gene, effect FROM (SELECT *, row_number() OVER (PARTITION BY snp, tf, gene ORDER BY abs(effect) DESC, effect) k FROM qb) WHERE k = 1),
    q2 AS (SELECT snp, tf, effect FROM (SELECT *, row_number() OVER (PARTITION BY snp, tf ORDER BY gene) k FROM q1) WHERE k = 1),
    ml AS (SELECT DISTINCT l_suppkey AS tf, p_brand AS gene, l_partkey AS snp, l_tax AS beta FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45),
    md AS (SELECT ml.tf, ml.gene, sum(abs(beta) * coalesce(p_size % 3, 0) * coalesce(effect, 0)) AS modifier FROM ml LEFT JOIN part ON p_partkey = snp AND p_size % 3 > 0 LEFT JOIN q2 ON q2.snp = ml.snp AND q2.tf = ml.tf GROUP BY 1, 2)
    SELECT net.tf, net.gene, motif AS weight, {r6('coalesce(modifier, 0)')} AS modifier, {r6('motif - coalesce(modifier, 0)')} AS prior FROM net LEFT JOIN md ON md.tf = net.tf AND md.gene = net.gene""",
    _LINES, _NET,
)
def egret_prior(spark, sf):
    li, pt = X.table(spark, sf, "lineitem"), X.table(spark, sf, "part")
    j = li.join(pt, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("snp"), F.col("l_suppkey").alias("tf"), F.col("p_brand").alias("gene"), "l_quantity", "l_discount", "l_tax")
    q = j.where("l_quantity > 48").select("snp", "tf", "gene", (F.col("l_discount") - 0.05).alias("effect"))
    e = j.where("l_quantity > 45").select("tf", "gene", "snp", F.col("l_tax").alias("beta"))
    g = pt.where("p_size % 3 > 0").select(F.col("p_partkey").alias("snp"), (F.col("p_size") % 3).alias("alt"))
    return _rounded(I.egret_prior(_prior(spark, sf), e, q, g), "modifier", "prior")


@query("maxabs_agg", "SELECT tf, gene, v FROM (SELECT tf, gene, q - 25 AS v, row_number() OVER (PARTITION BY tf, gene ORDER BY abs(q - 25) DESC, q) AS k FROM lines) WHERE k = 1", _LINES)
def maxabs_agg(spark, sf):
    return I.max_abs(X.lines(spark, sf).select("tf", "gene", (F.col("q") - 25).alias("v")), ["tf", "gene"], "v")


@query("ecdf_pairs", f"SELECT tf, gene, {r6('cume_dist() OVER (ORDER BY a)')} AS f FROM net", _LINES, _NET)
def ecdf_pairs(spark, sf):
    return _rounded(stats.ecdf(_net(spark, sf), "a", "f").select("tf", "gene", "f"), "f")


@query("global_mean_rank", "SELECT tf, gene, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM net", _LINES, _NET)
def global_mean_rank(spark, sf):
    return stats.global_rank(_net(spark, sf), "a", "r").select("tf", "gene", "r")


@query("motif_filter_semi", "SELECT tf, gene, motif AS weight FROM net WHERE gene IN (SELECT gene FROM expr GROUP BY gene HAVING count(*) FILTER (WHERE value <> 0) > 20) AND tf IN (SELECT i FROM ppi)", _LINES, _NET, _EXPR, _PPI)
def motif_filter_semi(spark, sf):
    ok = P.filter_covered(X.expression(spark, sf), 20).select("gene").distinct()
    return _prior(spark, sf).join(ok, "gene", "left_semi").join(X.ppi(spark, sf).select(F.col("i").alias("tf")).distinct(), "tf", "left_semi").select("tf", "gene", "weight")


@query("set_overlap_counts", "SELECT kind AS set, CAST(substr(gene, 7, 1) AS BIGINT) % 4 AS module, count(DISTINCT gene) AS overlap FROM lines GROUP BY 1, 2", _LINES)
def set_overlap_counts(spark, sf):
    t = X.lines(spark, sf).select(F.col("kind").alias("set"), "gene").distinct()
    m = t.select((F.substring("gene", 7, 1).cast("bigint") % 4).alias("module"), "gene").distinct()
    return C.gene_set_overlap(m, t, 25).select("set", "module", "overlap")


@query("multi_networks", "SELECT tf, gene, count(DISTINCT year) AS n FROM lines WHERE year BETWEEN 1995 AND 1997 GROUP BY tf, gene HAVING count(DISTINCT year) = 3", _LINES)
def multi_networks(spark, sf):
    li = X.lines(spark, sf)
    nets = [li.where(F.col("year") == y).groupBy("tf", "gene").agg(F.sum("q").alias("score")) for y in (1995, 1996, 1997)]
    return S.combine(nets).select("tf", "gene", F.size("scores").cast("bigint").alias("n"))


# --- beyond SQL: checked by invariants and small cases in the tests -------------------


@query("panda")
def panda(spark, sf):
    return _rounded(I.panda(X.expression(spark, sf), _prior(spark, sf), X.ppi(spark, sf)), "score")


@query("puma")
def puma(spark, sf):
    return _rounded(I.puma(X.expression(spark, sf), _prior(spark, sf), X.ppi(spark, sf), mirs=[1, 2]), "score")


@query("spider")
def spider(spark, sf):
    n = _net(spark, sf)
    return _rounded(I.spider(X.expression(spark, sf), _prior(spark, sf), n.select("tf", "gene", (F.col("a") > 0).cast("double").alias("weight")), X.ppi(spark, sf)), "score")


@query("otter")
def otter(spark, sf):
    return I.otter(X.expression(spark, sf), _prior(spark, sf), X.ppi(spark, sf)).withColumn("score", tidy(F.col("score"), 9))


@query("dragon")
def dragon(spark, sf):
    two = X.lines(spark, sf).groupBy(F.col("kind").alias("gene"), "sample").agg(F.sum("q").alias("value"))
    return _rounded(I.dragon(X.expression(spark, sf), two), "r")


@query("monster_ols")
def monster_ols(spark, sf):
    n = _net(spark, sf)
    return _rounded(I.monster(n.select("tf", "gene", F.col("a").alias("score")), n.select("tf", "gene", F.col("b").alias("score"))), "v")


@query("condor_brim")
def condor_brim(spark, sf):
    n = _net(spark, sf).where("a > 0")
    e = n.select(F.col("tf").cast("string").alias("red"), F.col("gene").alias("blue"), F.col("a").alias("weight"))
    red, blue, _ = C.condor_cluster(e)
    return red.withColumn("side", F.lit("red")).unionByName(blue.withColumn("side", F.lit("blue")))


@query("perturbed_networks")
def perturbed_networks(spark, sf):
    return I.perturbed(_net(spark, sf).select("tf", "gene", F.col("a").alias("weight")), 4)
