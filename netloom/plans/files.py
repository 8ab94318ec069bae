"""Registered queries that go through files on the shared folder: readers, sinks, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import inference as I
from netloom.operators import networks as N
from netloom.operators import subnetworks as S
from netloom.operators.communities import checkpoint_ready
from netloom.plans.catalog import _COM, _LINES, _NET, _PPI, _PV, _TM, _members, _net, _rounded, _transitions, query, r6
from netloom.sources import fixtures as X
from netloom.sources import readers as R
from netloom.sources import sinks


def scratch(spark, name: str) -> str:
    """A new path on the folder that driver and executors share."""
    checkpoint_ready(spark.range(1))  # makes one where none is configured
    return f"{spark.sparkContext.getCheckpointDir()}/files/{uuid.uuid4().hex}/{name}"


def _written(df: DataFrame, name: str, sep: str = "\t") -> str:
    path = scratch(df.sparkSession, name)
    df.write.options(sep=sep).csv(path)
    return path


def _lines_of(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


@query("read_motif", "SELECT CAST(tf AS VARCHAR) AS tf, gene, CAST(a AS DOUBLE) AS weight FROM net", _LINES, _NET)
def read_motif(spark, sf):
    return R.read_motif(spark, _written(_net(spark, sf).select("tf", "gene", "a"), "motif"))


@query(
    "read_expression",
    "SELECT gene, CAST(place AS INTEGER) AS sample, value FROM (SELECT tf AS gene, year - 1991 AS place, sum(q) AS value FROM lines GROUP BY tf, year) WHERE place BETWEEN 2 AND 5",
    _LINES,
)
def read_expression(spark, sf):
    """Rows of suppliers and columns of years, cut to the second to fifth sample."""
    wide = X.lines(spark, sf).groupBy("tf").pivot("year", list(range(1992, 1999))).agg(F.sum("q"))
    return R.read_expression(spark, _written(wide, "expression"), start=2, end=5).where("value IS NOT NULL").withColumn("gene", F.col("gene").cast("bigint"))


@query("read_ppi_nodes", "SELECT DISTINCT CAST(i AS VARCHAR) AS i FROM ppi", _PPI)
def read_ppi_nodes(spark, sf):
    return R.ppi_nodes(R.read_ppi(spark, _written(X.ppi(spark, sf), "ppi")))


@query("duplicate_genes", "SELECT gene, count(*) AS count FROM (SELECT DISTINCT gene, year FROM lines) GROUP BY gene HAVING count(*) > 1", _LINES)
def duplicate_genes(spark, sf):
    return R.duplicate_genes(X.lines(spark, sf).select("gene", "year").distinct())


@query("read_gmt", "SELECT DISTINCT kind AS set, CAST(part AS VARCHAR) AS gene FROM lines WHERE part IN (SELECT part FROM lines GROUP BY part HAVING count(*) > 25)", _LINES)
def read_gmt(spark, sf):
    li = X.lines(spark, sf)
    rows = li.groupBy("kind").agg(F.array_join(F.collect_list(F.col("part").cast("string")), "\t").alias("genes"))
    path = _lines_of(rows.select(F.concat_ws("\t", "kind", F.lit("link"), "genes").alias("value")), "sets")
    wanted = li.groupBy("part").count().where("count > 25").select(F.col("part").cast("string").alias("gene"))
    return R.read_gmt(spark, path, wanted)


@query("read_vcf", "SELECT 'chr' || (p_size % 5) || '_' || p_partkey AS snp, CAST(p_size % 2 + p_partkey % 2 AS INTEGER) AS alt FROM part")
def read_vcf(spark, sf):
    p = X.table(spark, sf, "part")
    gt = F.concat_ws("|", (F.col("p_size") % 2).cast("string"), (F.col("p_partkey") % 2).cast("string"))
    dot = F.lit(".")
    rows = p.select(F.concat(F.lit("chr"), (F.col("p_size") % 5).cast("string")), "p_partkey", dot, F.lit("A"), F.lit("C"), dot, dot, dot, F.lit("GT"), gt)
    return R.read_vcf(spark, _written(rows.toDF(*"abcdefghij"), "vcf"))


@query("read_eqtl", "SELECT CAST(l_suppkey AS VARCHAR) AS tf, 'g' || l_linenumber AS gene, l_partkey AS pos, 'chr1' AS chrom, l_tax AS beta, 'chr1_' || l_partkey AS snp FROM lineitem")
def read_eqtl(spark, sf):
    li = X.table(spark, sf, "lineitem")
    rows = li.select("l_suppkey", F.concat(F.lit("g"), F.col("l_linenumber").cast("string")), "l_partkey", F.lit("chr1"), "l_tax")
    return R.read_eqtl(spark, _lines_of(rows.select(F.concat_ws("  ", *(F.col(c).cast("string") for c in rows.columns)).alias("value")), "eqtl"))


@query("read_qbic", "SELECT CAST(l_partkey AS VARCHAR) AS snp, CAST(l_suppkey AS VARCHAR) AS tf, 'g' || l_linenumber AS gene, l_discount AS effect FROM lineitem")
def read_qbic(spark, sf):
    li = X.table(spark, sf, "lineitem")
    rows = li.select("l_partkey", "l_suppkey", F.concat(F.lit("g"), F.col("l_linenumber").cast("string")), "l_discount")
    return R.read_qbic(spark, _lines_of(rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns)).alias("value")), "qbic"))


@query("annotate", "SELECT tf, gene, kind, part FROM net LEFT JOIN (SELECT gene, kind, part, row_number() OVER (PARTITION BY gene ORDER BY part) AS k FROM (SELECT DISTINCT gene, kind, part FROM lines)) USING (gene) WHERE k = 1", _LINES, _NET)
def annotate(spark, sf):
    known = X.lines(spark, sf).select("gene", "kind", "part").distinct()
    return R.annotate(_net(spark, sf).select("tf", "gene"), known, "gene", ["part"])


@query("interactions", "SELECT DISTINCT a.s_name AS i, b.s_name AS j, CAST(1 AS DOUBLE) AS score FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2 JOIN supplier a ON a.s_suppkey = x.l_suppkey JOIN supplier b ON b.s_suppkey = y.l_suppkey")
def interactions(spark, sf):
    """Suppliers of the first two lines of an order, by their names."""
    s = X.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    li = X.table(spark, sf, "lineitem")
    at = lambda n, c: li.where(F.col("l_linenumber") == n).select("l_orderkey", F.col("l_suppkey").alias(c))
    return R.interactions(s.select("name"), s, at(1, "a").join(at(2, "b"), "l_orderkey").select("a", "b"))


@query("subject_attributes", "SELECT 'T-' || l_suppkey || '-' || l_linenumber AS sample, 'T-' || l_suppkey AS subject, s_name AS name FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) LEFT JOIN supplier ON s_suppkey = l_suppkey")
def subject_attributes(spark, sf):
    return _attributes(spark, sf)[0].select("sample", "subject", "name")


@query("versioned_counts", "SELECT gene, CAST(year AS VARCHAR) AS sample, sum(q) AS value FROM lines GROUP BY 1, 2", _LINES)
def versioned_counts(spark, sf):
    return _attributes(spark, sf)[1]


def _attributes(spark, sf):
    li = X.lines(spark, sf)
    samples = X.table(spark, sf, "lineitem").select(F.concat_ws("-", F.lit("T"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sample")).distinct()
    subjects = X.table(spark, sf, "supplier").select(F.concat(F.lit("T-"), F.col("s_suppkey").cast("string")).alias("subject"), F.col("s_name").alias("name"))
    counts = li.groupBy(F.concat("gene", F.lit(".7")).alias("gene"), F.col("year").cast("string").alias("sample")).agg(F.sum("q").alias("value"))
    return R.join_attributes(samples, subjects, counts.unionByName(counts.limit(1).withColumns({"gene": F.lit("none.1"), "value": F.lit(0.0)})))


@query("write_network", "SELECT CAST(tf AS VARCHAR) AS tf, gene, CAST(a AS VARCHAR) AS a FROM net", _LINES, _NET)
def write_network(spark, sf):
    path = scratch(spark, "network")
    R.write_network(_net(spark, sf).select("tf", "gene", "a"), path, "txt")
    return spark.read.options(sep="\t", header=True).csv(path)


@query("write_samples", f"SELECT tf, gene, CAST(year AS INTEGER) AS sample, {r6('sum(q)')} AS score FROM lines GROUP BY 1, 2, 3", _LINES)
def write_samples(spark, sf):
    """Networks of samples in a folder each."""
    path = scratch(spark, "samples")
    net = X.lines(spark, sf).groupBy("tf", "gene", F.col("year").alias("sample")).agg(F.sum("q").alias("score"))
    R.write_network(net, path, by_sample=True)
    return _rounded(spark.read.parquet(path).select("tf", "gene", "sample", "score"), "score")


@query("export_table", f"SELECT CAST(tf AS VARCHAR) AS tf, gene, CAST(year AS VARCHAR) AS sample, {r6('sum(q)')} AS score FROM lines GROUP BY 1, 2, 3", _LINES)
def export_table(spark, sf):
    path = scratch(spark, "export")
    R.export_table(X.lines(spark, sf).groupBy("tf", "gene", F.col("year").alias("sample")).agg(F.sum("q").alias("score")), path)
    back = spark.read.options(sep="\t", header=True).csv(path)
    return _rounded(back.withColumn("score", F.col("score").cast("double")), "score")


@query("write_stages", f"SELECT gene, {r6('sum(a)')} AS degree FROM net GROUP BY gene", _LINES, _NET)
def write_stages(spark, sf):
    kept = sinks.write_stages({"net": _net(spark, sf), "ppi": X.ppi(spark, sf)}, scratch(spark, "stages"))
    return _rounded(N.in_degree(kept["net"], "a"), "degree")


@query("write_modules", "SELECT CAST(tf AS VARCHAR) AS node, CAST(com AS VARCHAR) AS module FROM tfc WHERE com IN (SELECT com FROM gec) UNION ALL SELECT gene, CAST(com AS VARCHAR) FROM gec WHERE com IN (SELECT com FROM tfc)", _LINES, _COM)
def write_modules(spark, sf):
    from netloom.operators import communities as C

    t, g = _members(spark, sf)
    d = checkpoint_ready(C.dwbm(_net(spark, sf), t, g))
    path = scratch(spark, "modules")
    sinks.write_modules(g, d, C.module_scores(d.withColumn("d", F.abs("d")), t, g), path)
    return spark.read.options(sep="\t").csv(f"{path}/membership").toDF("node", "module")


@query("write_genotype_networks", "SELECT CAST(tf AS VARCHAR) AS tf, gene, CAST(a - b AS VARCHAR) AS prior FROM net", _LINES, _NET)
def write_genotype_networks(spark, sf):
    n = _net(spark, sf)
    path = scratch(spark, "genotype")
    sinks.write_genotype_networks(n.select("tf", "gene", (F.col("a") - F.col("b")).alias("prior")), n, n, path)
    return spark.read.options(sep="\t").csv(f"{path}/prior").toDF("tf", "gene", "prior")


@query("p_value_cache", f"SELECT tf, gene, {r6('p')} AS p FROM pv", _LINES, _NET, _PV)
def p_value_cache(spark, sf):
    """p values read from the cache that a first call has filled."""
    n, path = _net(spark, sf), scratch(spark, "p")
    one, null = S.combine([n.select("tf", "gene", F.col("a").alias("score"))]), n.select(F.col("b").alias("score"))
    S.p_values(one, null, cache=path)
    return _rounded(S.p_values(one.limit(0), null, cache=path), "p")


@query("write_transitions", f"SELECT perm, tf_from, tf_to, {r6('v')} AS v FROM tm", _LINES, _TM)
def write_transitions(spark, sf):
    path = scratch(spark, "transitions")
    sinks.write_transitions(_transitions(spark, sf), path)
    return _rounded(spark.read.parquet(path).select("perm", "tf_from", "tf_to", "v"), "v")


@query("write_fit", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(i * 10 + j AS DOUBLE) AS v FROM range(7) a(i) CROSS JOIN range(5) b(j)")
def write_fit(spark, sf):
    import numpy as np

    path = scratch(spark, "fit")
    sinks.write_fit(spark, {"W": np.arange(7)[:, None] * 10.0 + np.arange(5), "tfs": ["a"], "n": 3}, path)
    return spark.read.parquet(f"{path}/W")


@query("tiger")
def tiger(spark, sf):
    """Weights and activities read back from where they were written."""
    path = scratch(spark, "tiger")
    prior = _net(spark, sf).select("tf", "gene", F.when(F.col("motif") > 0, 1.0).otherwise(F.when(F.col("a") > F.col("b"), -1.0).otherwise(0.0)).alias("weight"))
    I.tiger(X.expression(spark, sf), prior, rounds=20, out_path=path)
    return spark.read.parquet(f"{path}/W").select(F.lit("W").alias("what"), "i", "j", "v").unionByName(spark.read.parquet(f"{path}/Z").select(F.lit("Z").alias("what"), "i", "j", "v"))


