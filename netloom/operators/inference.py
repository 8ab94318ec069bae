"""Network inference: tables in, tables out. The dense kernels' inputs are checked against a limit
before they are brought to the driver; samples, permutations and replicates run as tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.tails import normal_cdf, t_upper
from netloom.operators import kernels as K
from netloom.operators import tiles as B
from netloom.operators.networks import align

#: Cells of a dense matrix that a driver or task may hold.
LIMIT = 50_000_000


def matrix(edges: DataFrame, i: str, j: str, v: str, rows: list | None = None, cols: list | None = None) -> tuple[np.ndarray, list, list]:
    """A dense array from long rows, repeated cells summed and absent ones 0, with the names of rows
    and columns. Summed cells are counted against ``LIMIT`` before they come to the driver."""
    p = edges.where(F.col(i).isNotNull() & F.col(j).isNotNull()).groupBy(i, j).agg(F.sum(v).alias(v)).limit(LIMIT + 1).toArrow().to_pandas()
    rows = rows if rows is not None else sorted(p[i].unique().tolist())
    cols = cols if cols is not None else sorted(p[j].unique().tolist())
    if len(p) > LIMIT or len(rows) * len(cols) > LIMIT:
        raise ValueError(f"{len(rows)} x {len(cols)} cells are over the limit of {LIMIT} for a dense kernel")
    out = np.zeros((len(rows), len(cols)))
    at_r, at_c = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(cols)}
    a, b = p[i].map(at_r), p[j].map(at_c)
    ok = a.notna() & b.notna()
    out[a[ok].astype(int), b[ok].astype(int)] = p[v][ok]
    return out, rows, cols


def _frame(spark, m: np.ndarray, rows: list, cols: list, names: str) -> DataFrame:
    i, j = np.meshgrid(range(len(rows)), range(len(cols)), indexing="ij")
    a, b, c = names.split(", ")
    pdf = pd.DataFrame({a.split()[0]: [rows[k] for k in i.ravel()], b.split()[0]: [cols[k] for k in j.ravel()], c.split()[0]: m.ravel()})
    return spark.createDataFrame(pdf)


#: Correlations of the rows of genes x samples.
CORRELATIONS = {"pearson": K.correlation, "spearman": K.rank_correlation, "kendall": K.kendall_correlation}


class Prepared:
    """Aligned and normalised inputs of message passing. ``correlate`` is one of ``CORRELATIONS``,
    ``by_presence`` scales it by the share of samples that have both genes, ``randomize`` shuffles
    expression ``within`` each gene or ``by`` genes, ``missing`` holds ``align``'s legacy flags. Where
    ``tiled`` allows it, cooperation of many tfs is left in blocks on the shared folder (``p`` is then
    a ``tiles.Interactions``)."""

    def __init__(
        self, expr: DataFrame | None, motif: DataFrame, ppi: DataFrame | None, mode: str = "union", ppi_diag: float = 1.0, frozen: list | None = None,
        correlate: str = "pearson", by_presence: bool = False, randomize: str | None = None, seed: int = 0, samples: list | None = None, tiled: bool = False,
        **missing: bool,
    ) -> None:
        self.spark = motif.sparkSession
        if motif.isEmpty():
            raise ValueError("the motif prior has no edges")
        if correlate not in CORRELATIONS:
            raise ValueError(f"the correlation is one of {', '.join(CORRELATIONS)}")
        if expr is not None:
            if samples is not None:
                expr = expr.where(F.col("sample").isin(list(samples)))
            motif, expr, ppi2 = align(motif, expr, ppi if ppi is not None else motif.selectExpr("tf AS i", "tf AS j", "1D AS weight").limit(0), mode, **missing)
            ppi = ppi2 if ppi is not None else None
        self.w, self.tfs, self.genes = matrix(motif, "tf", "gene", "weight")
        if expr is not None:
            e, names, self.samples = matrix(expr, "gene", "sample", "value")
            if mode != "legacy":
                genes = sorted(set(self.genes) | set(names))
                w = np.zeros((len(self.tfs), len(genes)))
                w[:, np.searchsorted(genes, self.genes)] = self.w
                self.w, self.genes = w, genes
            self.expr = np.zeros((len(self.genes), len(self.samples)))
            at = {g: k for k, g in enumerate(names)}
            have = [k for k, g in enumerate(self.genes) if g in at]
            self.expr[have] = e[[at[self.genes[k]] for k in have]]
            if randomize == "within":
                self.expr = np.random.default_rng(seed).permuted(self.expr, axis=1)
            elif randomize == "by":
                self.expr = np.random.default_rng(seed).permutation(self.expr)
            elif randomize is not None:
                raise ValueError("randomize is within, by or None")
            self.c = CORRELATIONS[correlate](self.expr)
            if by_presence:
                there = (self.expr > 0).astype(float)
                self.c = self.c * (there @ there.T) / max(len(self.samples), 1)
        else:
            self.expr, self.samples, self.c = None, [], np.eye(len(self.genes))
        self.prior, self.kinds = self.w.copy(), dict(motif.dtypes)
        self.frozen = np.array([k for k, t in enumerate(self.tfs) if t in set(frozen or [])], int)
        if tiled and len(self.tfs) ** 2 > B.DENSE:
            none = motif.selectExpr("tf AS i", "tf AS j", "1D AS weight").limit(0)
            self.p = B.Interactions(ppi if ppi is not None else none, self.tfs, self.kinds["tf"], True, ppi_diag, self.frozen)
            return
        self.p = np.eye(len(self.tfs)) * ppi_diag
        if ppi is not None:
            m, _, _ = matrix(ppi, "i", "j", "weight", self.tfs, self.tfs)
            m = np.where(m != 0, m, m.T)
            np.fill_diagonal(m, ppi_diag)
            self.p = m
        if len(self.frozen):
            self.p[self.frozen], self.p[:, self.frozen] = 0, 0
            self.p[self.frozen, self.frozen] = 1
            np.fill_diagonal(self.p, np.where(np.diag(self.p) == 0, ppi_diag, np.diag(self.p)))

    def run(self, threshold: float, alpha: float) -> np.ndarray:
        if isinstance(self.p, B.Interactions):
            w, self.steps, self.change = B.panda(K.normalize(self.c), self.p, K.normalize(self.w), threshold, alpha, self.frozen)
            return w
        w, self.steps, self.change, self.coop, self.coreg = K.panda(K.normalize(self.c), K.normalize(self.p), K.normalize(self.w), threshold, alpha, self.frozen)
        return w

    def outputs(self, w: np.ndarray, which: tuple[str, ...], z_scale: bool = True) -> dict[str, DataFrame]:
        """The networks asked for: regulatory (tf, gene, motif, score), cooperative and coregulatory
        (i, j, score)."""
        make = {
            "regulatory": lambda: self.table(w, z_scale),
            "cooperative": lambda: _frame(self.spark, self.coop, self.tfs, self.tfs, "i, j, score"),
            "coregulatory": lambda: _frame(self.spark, self.coreg, self.genes, self.genes, "i, j, score"),
        }
        if not set(which) <= set(make):
            raise ValueError(f"outputs are {', '.join(make)}")
        return {k: make[k]() for k in which}

    def table(self, w: np.ndarray, z_scale: bool = True) -> DataFrame:
        """(tf, gene, motif, score); probabilities instead of z scores if asked for."""
        score = w if z_scale else np.vectorize(normal_cdf)(w)
        if isinstance(self.p, B.Interactions):
            return B.network(self.spark, self.tfs, self.genes, f"tf {self.kinds['tf']}, gene {self.kinds['gene']}, motif double, score double", self.prior, score)
        i, j = np.meshgrid(range(len(self.tfs)), range(len(self.genes)), indexing="ij")
        return self.spark.createDataFrame(
            pd.DataFrame({"tf": [self.tfs[k] for k in i.ravel()], "gene": [self.genes[k] for k in j.ravel()], "motif": self.prior.ravel(), "score": score.ravel()})
        )


def correlation_network(expr: DataFrame) -> DataFrame:
    """(tf, gene, motif, score): without a prior the network is the correlation of genes, both ways."""
    from netloom.operators.networks import gene_correlation

    r = gene_correlation(expr)
    both = r.unionByName(r.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    return both.select(F.col("i").alias("tf"), F.col("j").alias("gene"), F.lit(0.0).alias("motif"), F.col("r").alias("score"))


def panda(expr, motif, ppi=None, threshold: float = 0.001, alpha: float = 0.1, mode: str = "union", z_scale: bool = True, ppi_diag: float = 1.0, **options) -> DataFrame:
    """(tf, gene, motif, score). Without expression the co-regulation is the identity, without
    interactions the cooperation is; without a prior (None) the result is the genes' correlation.
    Further options are those of ``Prepared``."""
    if motif is None:
        if expr is None:
            raise ValueError("neither expression nor a prior is given")
        return correlation_network(expr)
    x = Prepared(expr, motif, ppi, mode, ppi_diag, tiled=True, **options)
    return x.table(x.run(threshold, alpha), z_scale)


def puma(
    expr, motif, ppi=None, mirs: list | None = None, threshold: float = 0.001, alpha: float = 0.1, mode: str = "union", z_scale: bool = True,
    output: tuple[str, ...] | None = None, **options,
) -> DataFrame | dict[str, DataFrame]:
    """As ``panda``, with the interactions of the given regulators frozen. With ``output`` a network
    for each of the names in it (see ``Prepared.outputs``)."""
    x = Prepared(expr, motif, ppi, mode, 1.0, mirs, tiled=output is None, **options)
    w = x.run(threshold, alpha)
    return x.outputs(w, output, z_scale) if output else x.table(w, z_scale)


def filtered_prior(motif: DataFrame, epifilter: DataFrame) -> DataFrame:
    """(tf, gene, weight): a prior times a filter (tf, gene, weight), 0 where the filter lacks an edge."""
    f = epifilter.select("tf", "gene", F.col("weight").alias("f"))
    return motif.join(f, ["tf", "gene"], "left").select("tf", "gene", (F.col("weight") * F.coalesce("f", F.lit(0.0))).alias("weight"))


def spider(expr, motif, epifilter, ppi=None, threshold: float = 0.001, alpha: float = 0.1, mode: str = "union") -> DataFrame:
    """As ``panda`` from the motif times an open-chromatin filter (tf, gene, weight), adjusted by
    degrees."""
    x = Prepared(expr, filtered_prior(motif, epifilter), ppi, mode, tiled=True)
    r, c = x.w.mean(1, keepdims=True), x.w.mean(0)
    x.w = x.w * np.sqrt(r * r + c * c)
    return x.table(x.run(threshold, alpha))


def otter(expr, motif, ppi, **options) -> DataFrame:
    x = Prepared(expr, motif, ppi, tiled=True)
    descend = B.otter if isinstance(x.p, B.Interactions) else K.otter
    return x.table(descend(x.p, x.w, x.c, **options) if descend is B.otter else descend(x.w, x.p, x.c, **options))


def lioness(
    expr, motif, ppi=None, samples: list | None = None, method: str = "panda", threshold: float = 0.001, alpha: float = 0.1, start: int = 1, end: int | None = None,
    output: str = "network",
) -> DataFrame:
    """(tf, gene, sample, score) = N net(all) - (N - 1) net(all but the sample); a task a sample. The
    inputs, checked against the limit, are sent to the tasks once. Samples are those given, or
    those from place ``start`` to ``end`` in their order; ``output`` is network, or gene_targeting or
    tf_targeting for sums (sample, gene or tf, score)."""
    if output not in ("network", "gene_targeting", "tf_targeting"):
        raise ValueError("output is network, gene_targeting or tf_targeting")
    if output != "network":
        from netloom.operators.networks import targeting

        return targeting(lioness(expr, motif, ppi, samples, method, threshold, alpha, start, end), output.split("_")[0])
    if motif is None:
        method = "pearson"
    if method not in ("panda", "pearson"):
        raise ValueError("method is panda or pearson")
    if method == "pearson":
        from netloom.operators.networks import lioness_pearson

        net = lioness_pearson(expr)
        if motif is None:
            net = net.select(F.col("i").alias("tf"), F.col("j").alias("gene"), "sample", "score")
        return net if samples is None else net.where(F.col("sample").isin(list(samples)))
    x = Prepared(expr, motif, ppi)
    full = x.run(threshold, alpha)
    spark = x.spark
    shared = spark.sparkContext.broadcast((x.expr, x.p, x.w, full, x.tfs, x.genes, x.samples))
    wanted = [k for k, s in enumerate(x.samples) if (samples is None or s in set(samples)) and start <= k + 1 <= (end or len(x.samples))]
    kinds = dict(motif.dtypes) | dict(expr.dtypes)

    def run(batches):
        e, p, w, full, tfs, genes, names = shared.value
        n = len(names)
        i, j = np.meshgrid(range(len(tfs)), range(len(genes)), indexing="ij")
        for pdf in batches:
            for k in pdf["k"]:
                part, *_ = K.panda(K.normalize(K.correlation(np.delete(e, k, axis=1))), K.normalize(p), K.normalize(w), threshold, alpha)
                net = n * full - (n - 1) * part
                yield pd.DataFrame({"tf": [tfs[a] for a in i.ravel()], "gene": [genes[a] for a in j.ravel()], "sample": names[k], "score": net.ravel()})

    return spark.createDataFrame([(k,) for k in wanted], "k int").repartition(max(1, len(wanted))).mapInPandas(
        run, f"tf {kinds['tf']}, gene {kinds['gene']}, sample {kinds['sample']}, score double"
    )


def max_abs(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The signed value of largest size per key, the lowest on a tie."""
    return table.groupBy(*keys).agg(F.min_by(value, F.struct(-F.abs(F.col(value)), F.col(value))).alias(value))


def egret_prior(motif: DataFrame, eqtl: DataFrame, qbic: DataFrame, genotype: DataFrame, sign: str = "signed") -> DataFrame:
    """(tf, gene, weight, modifier, prior): weight minus the sum over variants of |beta| * alternative
    alleles * binding effect, ``signed`` or ``abs``."""
    q = max_abs(qbic.distinct(), ["snp", "tf", "gene"], "effect")
    q = q.groupBy("tf", "snp").agg(F.min_by("effect", "gene").alias("effect"))
    e = eqtl.select("tf", "gene", "snp", "beta").distinct().join(genotype.groupBy("snp").agg(F.max("alt").alias("alt")), "snp", "left").join(q, ["tf", "snp"], "left")
    effect = F.coalesce("effect", F.lit(0.0))
    m = e.groupBy("tf", "gene").agg(F.sum(F.abs("beta") * F.coalesce("alt", F.lit(0)) * (F.abs(effect) if sign == "abs" else effect)).alias("modifier"))
    out = motif.join(m, ["tf", "gene"], "left").fillna(0.0, ["modifier"])
    return out.select("tf", "gene", "weight", "modifier", (F.col("weight") - F.col("modifier")).alias("prior"))


def egret(expr, motif, ppi, eqtl, qbic, genotype, sign: str = "signed", **options) -> tuple[DataFrame, DataFrame]:
    """Networks from the plain and from the modified prior."""
    prior = egret_prior(motif, eqtl, qbic, genotype, sign).select("tf", "gene", F.col("prior").alias("weight"))
    return panda(expr, motif, ppi, mode="legacy", **options), panda(expr, prior, ppi, mode="legacy", **options)


def layer_variances(expr: DataFrame) -> DataFrame:
    """(i, j, var, esq), i <= j: variance and squared expectation of covariances, from sums over
    samples, for two-layer shrinkage."""
    z = expr.withColumn("z", F.col("value") - F.avg("value").over(W.partitionBy("gene")))
    a, b = z.alias("a"), z.alias("b")
    w = a.join(b, (F.col("a.sample") == F.col("b.sample")) & (F.col("a.gene") <= F.col("b.gene"))).select(F.col("a.gene").alias("i"), F.col("b.gene").alias("j"), (F.col("a.z") * F.col("b.z")).alias("w"))
    n = F.col("n")
    s = w.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("w").alias("m"), F.var_pop("w").alias("v"))
    return s.select("i", "j", (n * n * F.col("v") / ((n - 1) * (n - 1) * (n - 1))).alias("var"), (F.col("m") * F.col("m") * n * n / ((n - 1) * (n - 1))).alias("esq"))


def shrinkage_terms(one: DataFrame, two: DataFrame) -> DataFrame:
    """(const, a1, a2, b1, b2, both, cross): the terms of the two-layer shrinkage's expected error, from
    expression (gene, sample, value) of both layers, each gene in deviations of its own."""
    sd = F.stddev_samp("value").over(W.partitionBy("gene"))
    scaled = lambda e, tag: e.select(F.concat(F.lit(tag), F.col("gene").cast("string")).alias("gene"), "sample", F.coalesce(F.try_divide("value", sd), F.col("value")).alias("value"))
    v = layer_variances(scaled(one, "1").unionByName(scaled(two, "2")))
    layer = lambda c: F.substring(c, 1, 1)
    x = v.withColumns({"m": layer("i"), "n": layer("j"), "off": F.col("i") != F.col("j")})
    pick = lambda what, cond: F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0.0))
    inside = lambda k: (F.col("m") == k) & (F.col("n") == k)
    s = x.agg(
        pick("var", F.col("off") & inside("1")).alias("o1"), pick("var", F.col("off") & inside("2")).alias("o2"), pick("var", ~F.col("off")).alias("d"),
        pick("esq", F.col("off") & inside("1")).alias("e1"), pick("esq", F.col("off") & inside("2")).alias("e2"),
        pick("var", F.col("m") != F.col("n")).alias("vc"), pick("esq", F.col("m") != F.col("n")).alias("ec"),
    )
    c = F.col
    return s.select(
        (c("d") + 2 * c("o1") + 2 * c("o2") - 2 * c("vc") + 4 * c("ec")).alias("const"), (-2 * (2 * c("o1") + c("ec"))).alias("a1"), (-2 * (2 * c("o2") + c("ec"))).alias("a2"),
        (2 * c("e1")).alias("b1"), (2 * c("e2")).alias("b2"), (2 * c("ec")).alias("both"), (4 * (c("vc") - c("ec"))).alias("cross"),
    )


def normal_equations(net: DataFrame) -> DataFrame:
    """(i, j, gram, cross): sums over genes of products of tfs' centred scores, within network a and
    between a and b of (tf, gene, a, b): what the least-squares transition is solved from."""
    w = W.partitionBy("tf")
    z = net.select("tf", "gene", (F.col("a") - F.avg("a").over(w)).alias("x"), (F.col("b") - F.avg("b").over(w)).alias("y"))
    return B.normal_equations(z)


def dragon(one: DataFrame, two: DataFrame) -> DataFrame:
    """(i, j, r): partial correlations within and between two layers (gene, sample, value)."""
    a, genes, samples = matrix(one, "gene", "sample", "value")
    b, more, _ = matrix(two, "gene", "sample", "value", None, samples)
    fit = K.dragon(a.T, b.T)
    names = [str(x) for x in [*genes, *more]]
    return _frame(one.sparkSession, fit["ggm"], names, names, "i, j, r")


def cobra(design: pd.DataFrame, expr: DataFrame, method: str = "pearson", second: DataFrame | None = None) -> dict:
    """Co-expression by covariates: of correlations, of shrunken partial ones (``pcorsh``), or of the
    shrunken covariance of two layers (``dragon``, with a second expression)."""
    if method not in ("pearson", "pcorsh", "dragon"):
        raise ValueError("method is pearson, pcorsh or dragon")
    e, genes, samples = matrix(expr, "gene", "sample", "value")
    x = design.loc[samples].to_numpy(float)
    if method == "pearson":
        return K.cobra(x, e) | {"genes": genes}
    if method == "pcorsh":
        return K.cobra_of(x, e, K.shrunken_partial_correlation(e)) | {"genes": genes}
    if second is None:
        raise ValueError("dragon needs a second layer")
    f, more, _ = matrix(second, "gene", "sample", "value", None, samples)
    return K.cobra_of(x, np.vstack([e, f]), K.dragon(e.T, f.T)["cov"]) | {"genes": [*genes, *more]}


def tiger(expr: DataFrame, prior: DataFrame, expressed: bool = False, signed: bool = True, out_path: str | None = None, **options) -> dict:
    """Activities and signed weights. ``expressed`` keeps tfs that the expression has; where it has
    them all, signs that contradict the shrunken partial correlations are blurred first. With
    ``out_path`` the fit is also written there as tables."""
    p, tfs, genes = matrix(prior, "tf", "gene", "weight")
    e, names, samples = matrix(expr, "gene", "sample", "value")
    at = {str(g): k for k, g in enumerate(names)}
    cols = [k for k, g in enumerate(genes) if str(g) in at]
    rows = [k for k in range(len(tfs)) if p[k, cols].any() and (not expressed or str(tfs[k]) in at)]
    if not rows or not cols:
        raise ValueError("no name is in both the expression and the prior")
    p, tfs, genes = p[np.ix_(rows, cols)], [tfs[k] for k in rows], [genes[k] for k in cols]
    if signed and all(str(t) in at for t in tfs):
        p = _blurred(p, [at[str(t)] for t in tfs], [at[str(g)] for g in genes], e)
    fit = K.tiger(e[[at[str(g)] for g in genes]], p, signed=signed, **options) | {"tfs": tfs, "genes": genes, "samples": samples}
    if out_path:
        from netloom.sources.sinks import write_fit

        write_fit(expr.sparkSession, fit, out_path)
    return fit


def _blurred(p: np.ndarray, tf_rows: list[int], gene_rows: list[int], expr: np.ndarray) -> np.ndarray:
    """The prior with 1e-6 where its sign contradicts the shrunken partial correlation."""
    every = sorted({*tf_rows, *gene_rows})
    place = {k: i for i, k in enumerate(every)}
    pc = K.shrunken_partial_correlation(expr[every])
    np.fill_diagonal(pc, 0.0)
    pc = pc[np.ix_([place[k] for k in tf_rows], [place[k] for k in gene_rows])]
    return np.where(p * pc < 0, 1e-6, p)


def signed_prior(expr: DataFrame, prior: DataFrame) -> DataFrame:
    """(tf, gene, weight): the prior between expressed tfs and genes, with 1e-6 where its sign
    contradicts the shrunken partial correlation, whose shrinkage is estimated; without zeros."""
    p, tfs, genes = matrix(prior, "tf", "gene", "weight")
    e, names, _ = matrix(expr.withColumn("gene", F.col("gene").cast("string")), "gene", "sample", "value")
    at = {x: k for k, x in enumerate(names)}
    r, c = [k for k, t in enumerate(tfs) if str(t) in at], [k for k, g in enumerate(genes) if str(g) in at]
    out = _blurred(p[np.ix_(r, c)], [at[str(tfs[k])] for k in r], [at[str(genes[k])] for k in c], e)
    return _frame(prior.sparkSession, out, [tfs[k] for k in r], [genes[k] for k in c], "tf, gene, weight").where("weight <> 0")


# --- transitions between conditions ----------------------------------------------


def monster(net1: DataFrame, net2: DataFrame, method: str = "ols", remove_diagonal: bool = True) -> DataFrame:
    """(tf_from, tf_to, v): the transition matrix between two networks (tf, gene, score)."""
    if method.lower() not in K.TRANSITIONS:
        raise ValueError(f"method is one of {', '.join(K.TRANSITIONS)}")
    genes = sorted({r[0] for r in net1.select("gene").intersect(net2.select("gene")).collect()})
    tfs = sorted({r[0] for r in net1.select("tf").intersect(net2.select("tf")).collect()})
    a, _, _ = matrix(net1, "tf", "gene", "score", tfs, genes)
    b, _, _ = matrix(net2, "tf", "gene", "score", tfs, genes)
    if method.lower() == "ols" and len(tfs) ** 2 > B.DENSE:
        return B.transition_ols(net1.sparkSession, a, b, tfs, dict(net1.dtypes)["tf"])
    m = K.TRANSITIONS[method.lower()](a, b)
    if remove_diagonal:
        np.fill_diagonal(m, 0.0)
    return _frame(net1.sparkSession, m, tfs, tfs, "tf_from, tf_to, v")


def check_expression(expr: DataFrame) -> DataFrame:
    """Expression with a numeric value (numbers in strings are read); other shapes are refused."""
    if not {"gene", "sample", "value"} <= set(expr.columns):
        raise ValueError("expression has the columns gene, sample and value")
    kind = dict(expr.dtypes)["value"]
    if kind not in ("double", "float", "int", "bigint", "string") and not kind.startswith("decimal"):
        raise ValueError("expression values are numbers")
    return expr.select("gene", "sample", F.col("value").cast("double").alias("value"))


def _permuted(spark, permutations: int, once, kind: str, tfs: list, path: str | None) -> DataFrame:
    """(perm, tf_from, tf_to, v) of ``once(k)``, a tfs x tfs matrix, a task a permutation; kept under
    ``path``, a folder a permutation, if one is given."""

    def run(batches):
        i, j = np.meshgrid(range(len(tfs)), range(len(tfs)), indexing="ij")
        for pdf in batches:
            for k in pdf["k"]:
                yield pd.DataFrame({"perm": k, "tf_from": [tfs[a] for a in i.ravel()], "tf_to": [tfs[a] for a in j.ravel()], "v": once(int(k)).ravel()})

    n = permutations + 1
    tm = spark.range(n).select(F.col("id").cast("int").alias("k")).repartition(n).mapInPandas(run, f"perm int, tf_from {kind}, tf_to {kind}, v double")
    if path is None:
        return tm
    from netloom.sources.sinks import write_transitions

    write_transitions(tm, path)
    return spark.read.parquet(path).select("perm", "tf_from", "tf_to", "v")


def _transition(one: np.ndarray, two: np.ndarray, method: str, remove_diagonal: bool) -> np.ndarray:
    t = K.TRANSITIONS[method](one, two)
    if remove_diagonal:
        np.fill_diagonal(t, 0.0)
    return t


def monster_permuted(
    expr: DataFrame, design: dict, motif: DataFrame, permutations: int = 100, method: str = "ols", seed: int = 0, network: str = "bere", alpha: float = 0.5,
    cutoff: float | None = None, resample: str = "labels", remove_diagonal: bool = True, path: str | None = None,
) -> DataFrame:
    """(perm, tf_from, tf_to, v) with perm 0 as observed: networks of controls (0) and cases (1) by motif
    and expression, their transition, and that of permuted data; a task a permutation. Samples
    without a design are left out. Networks are made by ``network``: bere, pearson or cd; permuted
    are the samples' ``labels`` or all ``entries`` of the expression."""
    if method.lower() not in K.TRANSITIONS:
        raise ValueError(f"method is one of {', '.join(K.TRANSITIONS)}")
    if network.lower() not in ("bere", "pearson", "cd"):
        raise ValueError("networks are made by bere, pearson or cd")
    if motif is None:
        raise ValueError("a motif is needed to make networks; give networks to monster_networks instead")
    keep = [s for s, d in design.items() if d in (0, 1)]
    m, tfs, genes = matrix(motif, "tf", "gene", "weight")
    e, names, samples = matrix(check_expression(expr), "gene", "sample", "value")
    pick = [k for k, s in enumerate(samples) if s in set(keep)]
    there = [k for k, g in enumerate(genes) if g in set(names)]
    if not there:
        raise ValueError("no gene is in both the motif and the expression")
    row = {g: k for k, g in enumerate(names)}
    m, e = m[:, there], e[[row[genes[k]] for k in there]][:, pick]
    label = np.array([design[samples[k]] for k in pick], int)
    if min((label == 0).sum(), (label == 1).sum()) < 3:
        raise ValueError("not enough samples of each condition to correlate")
    own = {str(genes[k]): i for i, k in enumerate(there)}
    of_tf = [own.get(str(t), -1) for t in tfs]
    spark = expr.sparkSession
    shared = spark.sparkContext.broadcast((m, e, label, of_tf))

    def once(k: int) -> np.ndarray:
        m, e, label, of_tf = shared.value
        if k:
            r = np.random.default_rng(seed + k)
            if resample == "labels":
                label = r.permutation(label)
            else:
                e = r.permutation(e.ravel()).reshape(e.shape)
        zero, one = (K.motif_network(m, e[:, label == c], of_tf, network.lower(), alpha, cutoff) for c in (0, 1))
        return _transition(zero, one, method.lower(), remove_diagonal)

    return _permuted(spark, permutations, once, dict(motif.dtypes)["tf"], tfs, path)


def monster_networks(control: DataFrame, case: DataFrame, permutations: int = 100, method: str = "ols", seed: int = 0, remove_diagonal: bool = True, path: str | None = None) -> DataFrame:
    """(perm, tf_from, tf_to, v) between two ready networks (tf, gene, score), of the tfs and genes that
    both have; permutations deal the gene columns of both anew to the two."""
    if method.lower() not in K.TRANSITIONS:
        raise ValueError(f"method is one of {', '.join(K.TRANSITIONS)}")
    a, t0, g0 = matrix(control, "tf", "gene", "score")
    b, t1, g1 = matrix(case, "tf", "gene", "score")
    tfs, genes = sorted(set(t0) & set(t1)), sorted(set(g0) & set(g1))
    if not tfs or not genes:
        raise ValueError("the networks have no tfs and genes in common")
    cut = lambda m, t, g: m[np.ix_(np.searchsorted(t, tfs), np.searchsorted(g, genes))]
    spark = control.sparkSession
    shared = spark.sparkContext.broadcast(np.hstack([cut(a, t0, g0), cut(b, t1, g1)]))

    def once(k: int) -> np.ndarray:
        both = shared.value
        if k:
            both = both[:, np.random.default_rng(seed + k).permutation(both.shape[1])]
        n = both.shape[1] // 2
        return _transition(both[:, :n], both[:, n:], method.lower(), remove_diagonal)

    return _permuted(spark, permutations, once, dict(control.dtypes)["tf"], tfs, path)


def transition_stats(tm: DataFrame, method: str = "z-score") -> DataFrame:
    """(tf, ssodm, t, p) of (perm, tf_from, tf_to, v): squared mass of a column against permuted ones."""
    s = tm.groupBy("perm", F.col("tf_to").alias("tf")).agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    obs = s.where("perm = 0").select("tf", F.col("s").alias("ssodm"))
    null = s.where("perm > 0")
    if method == "non-parametric":
        n = null.join(obs, "tf").groupBy("tf", "ssodm").agg((F.count_if(F.col("s") <= F.col("ssodm")) / F.count(F.lit(1))).alias("t"))
        return n.select("tf", "ssodm", "t", (1 - F.col("t")).alias("p"))
    if method != "z-score":
        raise ValueError("method is z-score or non-parametric")
    z = null.groupBy("tf").agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("sd")).join(obs, "tf").select("tf", "ssodm", F.try_divide(F.col("ssodm") - F.col("m"), "sd").alias("t"))

    @F.pandas_udf("double")
    def upper(t: pd.Series) -> pd.Series:
        return t.map(lambda x: 1 - normal_cdf(x))

    return z.withColumn("p", upper("t"))


# --- perturbed replicates --------------------------------------------------------------


def perturbed(net: DataFrame, replicates: int = 30, alpha: float = 0.1, beta: float = 0.0, seed: int = 0) -> DataFrame:
    """(replicate, tf, gene, weight): strength-preserving perturbations; a task a replicate."""
    w, tfs, genes = matrix(net, "tf", "gene", "weight")
    spark = net.sparkSession
    shared = spark.sparkContext.broadcast((w, tfs, genes))
    kinds = dict(net.dtypes)

    def run(batches):
        w, tfs, genes = shared.value
        i, j = np.meshgrid(range(len(tfs)), range(len(genes)), indexing="ij")
        for pdf in batches:
            for k in pdf["k"]:
                x = K.crane_bipartite(w, alpha, beta, seed + int(k))
                if x is None:
                    raise ValueError("strengths can't be kept: alpha is too large")
                yield pd.DataFrame({"replicate": k, "tf": [tfs[a] for a in i.ravel()], "gene": [genes[a] for a in j.ravel()], "weight": x.ravel()})

    return spark.range(replicates).select(F.col("id").cast("int").alias("k")).repartition(replicates).mapInPandas(run, f"replicate int, tf {kinds['tf']}, gene {kinds['gene']}, weight double")


def replicate_test(observed: DataFrame, replicates: DataFrame) -> DataFrame:
    """(node, score, t, p): one-sided t test that replicate scores (replicate, node, score) are below
    the observed score (node, score)."""
    r = replicates.groupBy("node").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"), F.count(F.lit(1)).alias("n"))
    t = observed.join(r, "node").select("node", "score", F.try_divide(F.col("score") - F.col("m"), F.col("sd") / F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("df"))

    @F.pandas_udf("double")
    def upper(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(x) else t_upper(x, d) for x, d in zip(t.astype(float), df, strict=True)])

    return t.withColumn("p", upper("t", "df")).drop("df")


def alpaca_crane(net: DataFrame, alpha: float = 0.1, beta: float = 0.0, replicates: int = 30, seed: int = 0) -> DataFrame:
    """(node, side, module, score, t, p): differential modules of (tf, gene, a, b), and how a node's score
    compares with its scores over perturbed copies of network b under the same modules."""
    from netloom.operators import communities as C

    result = C.checkpoint_ready(C.alpaca(net))
    com = lambda side: result.where(F.col("side") == side).select("node", F.col("module").alias("com"))
    named = net.select(F.col("tf").cast("string").alias("tf"), F.col("gene").cast("string").alias("gene"), "a", "b")
    copies = C.checkpoint_ready(perturbed(named.select("tf", "gene", F.col("b").alias("weight")), replicates, alpha, beta, seed))
    tf_com, gene_com = C.control_communities(named)
    parts = None
    for k in range(replicates):
        x = named.select("tf", "gene", "a").join(copies.where(F.col("replicate") == k).select("tf", "gene", F.col("weight").alias("b")), ["tf", "gene"])
        s = C.module_scores(C.dwbm(x, tf_com, gene_com), com("tf"), com("gene"))
        s = s.select(F.concat("side", F.lit(":"), "node").alias("node"), F.lit(k).alias("replicate"), "score")
        parts = s if parts is None else parts.unionByName(s)
    key = result.withColumn("key", F.concat("side", F.lit(":"), "node"))
    test = replicate_test(key.select(F.col("key").alias("node"), "score"), parts).select(F.col("node").alias("key"), "t", "p")
    return key.join(test, "key", "left").drop("key")


def null_scores(motif: DataFrame, ppi: DataFrame, samples: int = 20, networks: int = 3, seed: int = 0) -> DataFrame:
    """(score): message passing on random expression, without prior edges and edges of tfs that
    interact with a prior tf of the gene."""
    spark = motif.sparkSession
    genes = sorted(r[0] for r in motif.select("gene").distinct().collect())
    out = None
    for k in range(networks):
        r = np.random.default_rng(seed + k)
        x = Prepared(None, motif, ppi)
        x.genes, x.expr = genes, r.normal(size=(len(genes), samples))
        x.c = K.correlation(x.expr)
        near = (x.p @ (x.prior > 0)) > 0
        w = x.run(0.001, 0.1)
        part = spark.createDataFrame(pd.DataFrame({"score": w[~near & ~(x.prior > 0)].ravel()}), "score double")
        out = part if out is None else out.unionByName(part)
    return out
