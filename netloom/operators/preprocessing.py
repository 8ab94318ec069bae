"""Filtering, normalisation, mutation scores and enrichment. Expression is (gene, sample, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.stats import safe_corr
from netloom.functions.tails import f_upper, t_two_sided
from netloom.operators.kernels import classical_scaling, complete_linkage, enrichment_score


def extract_matrix(expr: DataFrame, log: bool = True) -> DataFrame:
    return expr.select("gene", "sample", F.log2(F.col("value") + 1).alias("value") if log else "value")


def filter_by_label(rows: DataFrame, labels: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """Rows whose key is (keep) or is not among the labels: for genes and samples alike."""
    return rows.join(labels.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def filter_missing_genes(expr: DataFrame, threshold: float = 0.0) -> DataFrame:
    return expr.join(expr.groupBy("gene").agg(F.sum("value").alias("s")).where(F.col("s") > threshold), "gene", "left_semi")


def filter_low_genes(expr: DataFrame, threshold: float = 1.0, least: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Genes with more than ``threshold`` counts per million in at least ``least`` samples (by
    default half the smallest of the groups (sample, grp))."""
    if least is None:
        sizes = groups.groupBy("grp").count() if groups is not None else expr.agg(F.count_distinct("sample").alias("count"))
        least = max(1, (sizes.agg(F.min("count")).first()[0] or 0) // 2)
    total = expr.groupBy("sample").agg(F.sum("value").alias("total"))
    cpm = expr.join(total, "sample").withColumn("cpm", F.coalesce(F.try_divide(F.col("value") * 1e6, "total"), F.lit(0.0)))
    ok = cpm.groupBy("gene").agg(F.count_if(F.col("cpm") > threshold).alias("n")).where(F.col("n") >= least)
    return expr.join(ok, "gene", "left_semi")


def filter_covered(expr: DataFrame, least: int = 20) -> DataFrame:
    ok = expr.groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("n")).where(F.col("n") > least)
    return expr.join(ok, "gene", "left_semi")


def top_variable(expr: DataFrame, n: int) -> DataFrame:
    """(gene, sd) of the n most variable genes with a positive sum."""
    s = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.stddev_samp("value").alias("sd")).where("s > 0")
    return s.orderBy(F.desc("sd"), "gene").limit(n).select("gene", "sd")


def sample_distance(expr: DataFrame) -> DataFrame:
    """(i, j, d), i < j: Euclidean distances of samples."""
    a, b = expr.alias("a"), expr.alias("b")
    d = a.join(b, (F.col("a.gene") == F.col("b.gene")) & (F.col("a.sample") < F.col("b.sample")))
    x = F.col("a.value") - F.col("b.value")
    return d.groupBy(F.col("a.sample").alias("i"), F.col("b.sample").alias("j")).agg(F.sqrt(F.sum(x * x)).alias("d"))


def scaling(expr: DataFrame, n: int = 1000, axes: int = 2, limit: int = 3000, distance=sample_distance) -> pd.DataFrame:
    """Coordinates of samples by classical scaling over the most variable genes. ``distance`` gives
    (i, j, d), i < j, of all samples of an expression."""
    if expr.select("sample").distinct().count() > limit:
        raise ValueError("too many samples for dense scaling")
    d = distance(expr.join(top_variable(expr, n), "gene", "left_semi")).toPandas()
    names = sorted(set(d["i"]) | set(d["j"]))
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for i, j, v in d.itertuples(index=False):
        m[at[i], at[j]] = m[at[j], at[i]] = v
    return pd.DataFrame(classical_scaling(m, axes), index=names)


def check_annotation(expr: DataFrame, control: DataFrame | None = None, **options) -> pd.DataFrame:
    """Coordinates of samples over the control genes (gene), or over all: samples whose phenotype is
    wrongly noted lie among those of the other. Options are those of ``scaling``."""
    return scaling(filter_by_label(expr, control, "gene", keep=True) if control is not None else expr, **options)


def tissues_to_merge(expr: DataFrame, samples: DataFrame, n: int = 1000, axes: int = 2, prepare=None, limit: int = 3000) -> DataFrame:
    """(major, minor, sample, axis, value): coordinates of the samples (sample, major, minor) of each
    major group over its own most variable genes with a positive sum; a task a group. ``prepare``,
    a function of the expression, may filter it first. A group is checked against ``limit`` samples."""
    x = prepare(expr) if prepare else expr
    x = x.join(samples.select("sample", "major", "minor"), "sample")
    largest = x.groupBy("major").agg(F.count_distinct("sample").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > limit:
        raise ValueError("too many samples in a group for dense scaling")
    s = x.groupBy("major", "gene").agg(F.sum("value").alias("s"), F.stddev_samp("value").alias("sd")).where("s > 0")
    top = s.withColumn("r", F.row_number().over(W.partitionBy("major").orderBy(F.desc("sd"), "gene"))).where(F.col("r") <= n)
    kinds = dict(samples.dtypes)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="sample", columns="gene", values="value").fillna(0.0)
        m = wide.to_numpy(float)
        d = np.sqrt(np.maximum(((m * m).sum(1)[:, None] + (m * m).sum(1) - 2 * m @ m.T), 0))
        at = classical_scaling(d, axes)
        minor = pdf.drop_duplicates("sample").set_index("sample")["minor"]
        rows = [(pdf["major"].iloc[0], minor[s], s, k + 1, float(at[i, k])) for i, s in enumerate(wide.index) for k in range(at.shape[1])]
        return pd.DataFrame(rows, columns=["major", "minor", "sample", "axis", "value"])

    schema = f"major {kinds['major']}, minor {kinds['minor']}, sample {kinds['sample']}, axis int, value double"
    return x.join(top.select("major", "gene"), ["major", "gene"], "left_semi").groupBy("major").applyInPandas(place, schema)


def histogram(expr: DataFrame, width: float) -> DataFrame:
    """(sample, bin, n): what a density plot shows."""
    return expr.groupBy("sample", F.floor(F.col("value") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantile_normalize(expr: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Values replaced by the mean, over the samples (of the same group), of the values of the same
    place; tied values get the mean over their places."""
    e = expr.join(groups.select("sample", "grp"), "sample") if groups is not None else expr.withColumn("grp", F.lit(0))
    e = e.withColumn("place", F.row_number().over(W.partitionBy("sample").orderBy("value", "gene")))
    ref = e.groupBy("grp", "place").agg(F.avg("value").alias("ref"))
    out = F.avg("ref").over(W.partitionBy("sample", "value"))
    return e.join(ref, ["grp", "place"]).select("gene", "sample", out.alias("value"))


def qstats(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(place, qref, sst, ssb, w): raw smooth-quantile weights, 1 - SSB / SST (1 if SST is tiny)."""
    e = expr.join(groups.select("sample", "grp"), "sample").withColumn("place", F.row_number().over(W.partitionBy("sample").orderBy("value", "gene")))
    g = e.groupBy("place", "grp").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    p = g.groupBy("place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    mean2 = F.col("s") * F.col("s") / F.col("n")
    p = p.select("place", (F.col("s") / F.col("n")).alias("qref"), (F.col("ss") - mean2).alias("sst"), (F.col("between") - mean2).alias("ssb"))
    return p.withColumn("w", F.when(F.col("sst") < 1e-6, 1.0).otherwise(1 - F.col("ssb") / F.col("sst")))


def running_median(df: DataFrame, value: str, order: str, half: int, out: str) -> DataFrame:
    """Median of 2 * half + 1 neighbours; the ends repeat the first and last full window's."""
    w = W.orderBy(order)  # as many rows as places
    n = F.count(F.lit(1)).over(W.partitionBy())
    med = F.expr(f"sort_array(__l)[{half}]")
    d = df.withColumns({"__o": F.row_number().over(w), "__n": n, "__l": F.collect_list(value).over(w.rowsBetween(-half, half))})
    d = d.withColumn("__m", F.when(F.size("__l") == 2 * half + 1, med))
    first, last = F.first("__m", True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last("__m", True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = d.withColumn(out, F.coalesce("__m", F.when(F.col("__o") <= half, first).otherwise(last), value))
    return d.drop("__o", "__n", "__l", "__m")


def qsmooth(expr: DataFrame, groups: DataFrame, window: float = 0.05) -> DataFrame:
    """w * overall reference + (1 - w) * group reference, put back by place, ties averaged."""
    q = qstats(expr, groups)
    n = q.count()
    half = max(0, int(np.floor(window * n)) // 2)
    q = running_median(q, "w", "place", half, "ws")
    e = expr.join(groups.select("sample", "grp"), "sample").withColumn("place", F.row_number().over(W.partitionBy("sample").orderBy("value", "gene")))
    hat = e.groupBy("grp", "place").agg(F.avg("value").alias("hat"))
    x = e.join(hat, ["grp", "place"]).join(q.select("place", "qref", "ws"), "place")
    v = F.col("ws") * F.col("qref") + (1 - F.col("ws")) * F.col("hat")
    return x.withColumn("__v", v).select("gene", "sample", F.avg("__v").over(W.partitionBy("sample", "value")).alias("value"))


# --- mutation scores ----------------------------------------------------------


def gene_rate(mutations: DataFrame, lengths: DataFrame) -> DataFrame:
    """(sample, gene, x): n / length of genes in both, divided by the sample's sum."""
    r = mutations.join(lengths, "gene").select("sample", "gene", (F.col("n") / F.col("length")).alias("r"))
    return r.select("sample", "gene", F.coalesce(F.try_divide("r", F.sum("r").over(W.partitionBy("sample"))), F.lit(0.0)).alias("x"))


def pathway_scores(rates: DataFrame, sets: DataFrame) -> DataFrame:
    """(sample, set, score): mean rate over a set's genes, each divided by the number of sets it is
    in; sets and samples of zeros are absent."""
    sets = sets.select("set", "gene").distinct()
    many = sets.groupBy("gene").agg(F.count(F.lit(1)).alias("f"))
    size = sets.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    s = rates.join(many, "gene").join(sets, "gene").groupBy("sample", "set").agg(F.sum(F.col("x") / F.col("f")).alias("s"))
    return s.join(size, "set").select("sample", "set", (F.col("s") / F.col("size")).alias("score")).where("score > 0")


def binomial_distance(scores: DataFrame) -> DataFrame:
    """(i, j, d), i < j: sum over sets of [x ln(x/n) + y ln(y/n) + n ln 2] / n, n = x + y. A set that one
    sample alone has adds ln 2, so that only those that both have are worked on: a block of
    samples at a time, from scores by sets that are sent to the tasks. Only scores are shuffled."""
    from netloom.operators.tiles import by_rows, sheet

    names, sets, _, (x,) = sheet(scores, "score", row="sample", col="set")
    spark, kind = scores.sparkSession, dict(scores.dtypes)["sample"]
    has = [np.flatnonzero(x[:, s] > 0) for s in range(len(sets))]
    shared = spark.sparkContext.broadcast((x, has, [x[h, s] for s, h in enumerate(has)], (x > 0).sum(1) * np.log(2.0)))

    def make(lo: int, hi: int):
        x, has, values, alone = shared.value
        d = alone[lo:hi, None] + alone
        for i in range(lo, hi):
            for s in np.flatnonzero(x[i] > 0):
                k = np.searchsorted(has[s], i + 1)
                v, y = x[i, s], values[s][k:]
                n = v + y
                d[i - lo, has[s][k:]] += (v * np.log(v / n) + y * np.log(y / n)) / n - np.log(2.0)
        return (d,), np.arange(lo, hi)[:, None] < np.arange(len(x))

    return by_rows(spark, names, names, f"i {kind}, j {kind}, d double", make, 500_000)


def subtypes(distance: DataFrame, ks: list[int], limit: int = 4_000_000) -> pd.DataFrame:
    """Complete-linkage clusters for each k, from all pairs of samples."""
    if distance.count() > limit:
        raise ValueError("too many samples for dense clustering")
    d = distance.toPandas()
    names = sorted(set(d["i"]) | set(d["j"]))
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for i, j, v in d.itertuples(index=False):
        m[at[i], at[j]] = m[at[j], at[i]] = v
    return pd.DataFrame({k: complete_linkage(m, k) for k in ks}, index=names)


def sambar(mutations: DataFrame, lengths: DataFrame, sets: DataFrame, genes: DataFrame | None = None, ks: tuple[int, ...] = (2, 3, 4)) -> pd.DataFrame:
    """Clusters of samples, a column for each k, from mutation counts (sample, gene, n): rates by gene
    length (gene, length), scores of gene sets (set, gene), binomial distance, complete linkage.
    Only the given genes count; samples without a mutation in them are absent."""
    if genes is not None:
        mutations, sets = (x.join(genes.select("gene").distinct(), "gene", "left_semi") for x in (mutations, sets))
    from netloom.operators.communities import checkpoint_ready

    scores = checkpoint_ready(pathway_scores(gene_rate(mutations, lengths), sets))  # read several times by the distance
    return subtypes(checkpoint_ready(binomial_distance(scores)), list(ks))


# --- associations ---------------------------------------------------------------


def numeric_association(expr: DataFrame, phenotype: DataFrame) -> DataFrame:
    """(gene, r): correlation of every gene with (sample, y)."""
    return expr.join(phenotype.select("sample", "y"), "sample").groupBy("gene").agg(safe_corr("value", "y").alias("r"))


def anova(expr: DataFrame, phenotype: DataFrame) -> DataFrame:
    """(gene, f, d1, d2): one-way F statistic over (sample, grp), from sums."""
    g = expr.join(phenotype.select("sample", "grp"), "sample").groupBy("gene", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    t = g.groupBy("gene").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count(F.lit(1)).alias("k"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("ss") - F.col("b")
    return t.select("gene", F.coalesce(F.try_divide(F.try_divide(between, d1), F.try_divide(within, d2)), F.lit(0.0)).alias("f"), d1.alias("d1"), d2.alias("d2"))


def anova_p(table: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f_upper(x, p, q) for x, p, q in zip(f, a, b, strict=True)])

    return table.withColumn("p", tail("f", "d1", "d2"))


def correlation_p(table: DataFrame, n: int) -> DataFrame:
    @F.pandas_udf("double")
    def tail(r: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x * np.sqrt((n - 2) / max(1 - x * x, 1e-300)), n - 2) for x in r])

    return table.withColumn("p", tail("r"))


def running_sum(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, es): largest deviation of the weighted running sum over genes (gene, stat), from the
    largest statistic on. Sets are worked on one by one in parallel."""
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    place = ranked.withColumn("place", F.row_number().over(W.orderBy(F.desc("stat"), "gene")))  # as many rows as genes
    hits = place.join(sets.select("set", "gene").distinct(), "gene").crossJoin(F.broadcast(total))
    w = W.partitionBy("set").orderBy("place")
    mass, size = F.sum(F.abs("stat")).over(W.partitionBy("set")), F.count(F.lit(1)).over(W.partitionBy("set"))
    run = F.sum(F.abs("stat")).over(w.rowsBetween(W.unboundedPreceding, 0)) / mass
    before = F.coalesce(F.sum(F.abs("stat")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / mass
    miss = F.try_divide(F.col("place") - F.row_number().over(w), F.col("n") - size)
    d = hits.withColumns({"up": run - miss, "down": before - miss}).groupBy("set").agg(F.max("up").alias("up"), F.min("down").alias("down"))
    return d.select("set", F.when(F.col("up") >= -F.col("down"), F.col("up")).otherwise(F.col("down")).alias("es"))


def seahorse(expr: DataFrame, phenotypes: dict[str, tuple[str, DataFrame]], sets: DataFrame, **options) -> dict:
    """Co-expression of genes, and for each phenotype the association of every gene and the
    enrichment of gene sets (set, gene) along it. A phenotype is ("numeric", (sample, y)), by
    correlation, or ("categorical", (sample, grp)), by the p value of an analysis of variance, which
    ranks genes from the largest p on unless ``significant_first`` is given."""
    from netloom.operators.networks import gene_correlation

    first = options.pop("significant_first", False)
    by_set: dict[str, list[str]] = {}
    for r in sets.select("set", "gene").distinct().orderBy("set", "gene").toLocalIterator():
        by_set.setdefault(r["set"], []).append(r["gene"])
    out: dict = {"coexpression": gene_correlation(expr), "association": {}, "enrichment": {}}
    for name, (kind, table) in phenotypes.items():
        if kind == "numeric":
            a = numeric_association(expr, table).select("gene", F.col("r").alias("stat"))
        elif kind == "categorical":
            a = anova_p(anova(expr, table)).select("gene", F.col("p").alias("stat"))
        else:
            raise ValueError("a phenotype is numeric or categorical")
        out["association"][name] = a
        ranked = a.orderBy("gene").toPandas()  # a row a gene
        if kind == "categorical" and first:
            ranked["stat"] = -np.log10(np.maximum(ranked["stat"], 1e-300))
        out["enrichment"][name] = gsea(ranked, by_set, **options)
    return out


# --- linear models -------------------------------------------------------------------


def linear_fit(values: DataFrame, design: pd.DataFrame, keys: tuple[str, ...] = ("tf", "gene"), value: str = "score") -> DataFrame:
    """(keys, coefficients array, s2, df): least squares of each key's values over samples on the columns of
    ``design`` (a row a sample). Sums of products per key are all that is shuffled; the design is
    sent along, as it has a row a sample only. Keys without a value for every sample are absent."""
    x = design.to_numpy(float)
    inverse = np.linalg.inv(x.T @ x)
    spark = values.sparkSession
    rows = spark.createDataFrame([(s if isinstance(s, str) else int(s), [float(v) for v in r]) for s, r in zip(design.index.tolist(), x, strict=True)], f"sample {dict(values.dtypes)['sample']}, x array<double>")
    q, n = x.shape[1], len(x)
    y = F.col(value)
    sums = values.join(F.broadcast(rows), "sample").groupBy(*keys).agg(
        F.array(*(F.sum(F.col("x")[k] * y) for k in range(q))).alias("xy"), F.sum(y * y).alias("yy"), F.count(F.lit(1)).alias("n")
    )
    b = F.array(*(sum((F.lit(float(inverse[i, k])) * F.col("xy")[k] for k in range(1, q)), F.lit(float(inverse[i, 0])) * F.col("xy")[0]) for i in range(q)))
    fit = sums.where(F.col("n") == n).withColumn("coefficients", b)
    rest = F.col("yy") - F.aggregate(F.zip_with("coefficients", "xy", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return fit.select(*keys, "coefficients", (F.greatest(rest, F.lit(0.0)) / max(n - q, 1)).alias("s2"), F.lit(n - q).alias("df"))


def moderated_t(values: DataFrame, design: pd.DataFrame, column: int, keys: tuple[str, ...] = ("tf", "gene"), value: str = "score") -> DataFrame:
    """(keys, effect, t, p, q): the coefficient of a design column for each key, with variances drawn
    towards their common prior (a scaled inverse chi-square fitted to the moments of their
    logarithms) and BH-adjusted p values."""
    from netloom.functions.stats import benjamini_hochberg
    from netloom.functions.tails import digamma, trigamma, trigamma_inverse

    x = design.to_numpy(float)
    unit = float(np.sqrt(np.linalg.inv(x.T @ x)[column, column]))
    fit = linear_fit(values, design, keys, value)
    d = len(x) - x.shape[1]
    m, v = fit.where("s2 > 0").agg(F.avg(F.ln("s2")), F.var_samp(F.ln("s2"))).first()
    extra = (v or 0.0) - trigamma(d / 2)
    if m is None:
        prior, d0 = 0.0, 0.0
    elif extra > 0:
        d0 = 2 * trigamma_inverse(extra)
        prior = float(np.exp(m - digamma(d / 2) + np.log(d / 2) + digamma(d0 / 2) - np.log(d0 / 2)))
    else:  # no more spread than chance: all share one variance
        d0, prior = float("inf"), float(np.exp(m - digamma(d / 2) + np.log(d / 2)))
    s2 = F.lit(prior) if d0 == float("inf") else (F.lit(d0 * prior) + F.col("s2") * d) / F.lit(d0 + d)
    effect = F.col("coefficients")[column]
    t = fit.select(*keys, effect.alias("effect"), F.coalesce(F.try_divide(effect, F.sqrt(s2) * unit), F.lit(0.0)).alias("t"))
    df = min(d0 + d, 1e6)

    @F.pandas_udf("double")
    def tail(t: pd.Series) -> pd.Series:
        return t.map(lambda z: t_two_sided(z, df))

    return benjamini_hochberg(t.withColumn("p", tail("t")), "p", "q")


def gsea(ranked: pd.DataFrame, sets: dict[str, list[str]], permutations: int = 1000, seed: int = 0, least: int = 15, most: int = 500) -> pd.DataFrame:
    """Enrichment scores with permutation p values for sets of ``least`` to ``most`` ranked genes."""
    stat = ranked["stat"].to_numpy(float)
    order = np.argsort(-stat, kind="stable")
    r = np.random.default_rng(seed)
    out = []
    for name, genes in sorted(sets.items()):
        hits = ranked["gene"].isin(genes).to_numpy()
        if not least <= hits.sum() <= most:
            continue
        es = enrichment_score(order, hits, stat)
        null = np.array([enrichment_score(order, r.permutation(hits), stat) for _ in range(permutations)])
        same = null[np.sign(null) == np.sign(es)]
        out.append((name, int(hits.sum()), es, (1 + (np.abs(same) >= abs(es)).sum()) / (1 + len(same))))
    return pd.DataFrame(out, columns=["set", "size", "es", "p"])
