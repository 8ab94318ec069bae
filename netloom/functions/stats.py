"""Column expressions and grouped statistics that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of a group; 0 where either side has no variance."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def zscore(value: str, *keys: str) -> Column:
    """(value - mean) / population deviation within the keys (of all rows without keys): null
    where there is no variance."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))


def mean_rank(value: str, *keys: str) -> Column:
    """Rank with ties averaged."""
    w = W.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / F.lit(2.0)


#: Ranges of a distributed ordering, at most.
RANGES = 512


def cuts_of(df: DataFrame, *values: str) -> dict[str, list[float]]:
    """Approximate quantiles of each column, one job for all: bounds of ranges of about equal size,
    as many as the session has shuffle partitions."""
    n = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    at = F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(0.5))
    got = df.agg(*(F.percentile_approx(F.col(v).cast("double"), at, F.lit(10 * n)).alias(f"c{i}") for i, v in enumerate(values))).first()
    return {v: sorted(set(got[f"c{i}"] or [])) for i, v in enumerate(values)}


def running(df: DataFrame, order: str, total: str, out: str, cuts: list[float]) -> DataFrame:
    """Add to rows of distinct ``order`` the sum of ``total`` up to and with each row, and ``<out>_all``
    of all rows. Rows are ordered within ranges of ``order`` only; what the ranges before hold comes
    from one row a range. Nulls come first."""
    place = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.lit([*cuts, float("inf")]), lambda c: c < F.col(order))))
    rows = df.withColumn("__range", place)
    per = rows.groupBy("__range").agg(F.sum(total).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    per = per.select("__range", before.alias("__before"), F.sum("__sum").over(W.partitionBy()).alias(f"{out}_all"))
    within = F.sum(total).over(W.partitionBy("__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(F.broadcast(per), "__range").withColumn(out, F.col("__before") + within).drop("__before", "__range")


def ecdf(df: DataFrame, value: str, out: str, cuts: list[float] | None = None) -> DataFrame:
    """Add the share of rows whose value is no larger, ties sharing. Distinct values are counted
    first, and ordered within ranges, so that no task meets all of them."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cuts = cuts_of(df, value)[value] if cuts is None else cuts
    table = running(counts, "__v", "__n", "__r", cuts).select("__v", (F.col("__r") / F.col("__r_all")).alias(out))
    return df.join(table, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def global_rank(df: DataFrame, value: str, out: str, descending: bool = False, ties: str = "mean") -> DataFrame:
    """Add each row's rank among all rows, ties averaged or (``ties="min"``) least."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    r = running(counts, "__v", "__n", "__r", cuts_of(df, value)[value])
    last = (F.col("__r_all") - F.col("__r") + F.col("__n")) if descending else F.col("__r")
    rank = last - (F.col("__n") - 1) / F.lit(2.0) if ties == "mean" else last - F.col("__n") + 1
    return df.join(r.select("__v", rank.alias(out)), F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def benjamini_hochberg(df: DataFrame, p: str, out: str, *tie: str) -> DataFrame:
    """Add BH-adjusted p values: least(1, running minimum from the end of p * n / rank). Equal p
    values share the largest of their ranks, which gives what any order of them gives. Ordered
    within ranges; a range takes the minimum over those behind it from one row a range."""
    cuts = cuts_of(df, p)[p]
    counts = df.groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    raw = running(counts, "__p", "__n", "__k", cuts)
    raw = raw.withColumn("__r", F.col("__p") * F.col("__k_all") / F.col("__k"))
    raw = raw.withColumn("__range", F.size(F.filter(F.lit([*cuts, float("inf")]), lambda c: c < F.coalesce("__p", F.lit(float("-inf"))))))
    behind = raw.groupBy("__range").agg(F.min("__r").alias("__m"))
    behind = behind.select("__range", F.min("__m").over(W.orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)).alias("__m"))
    within = F.min("__r").over(W.partitionBy("__range").orderBy(F.desc("__p")).rowsBetween(W.unboundedPreceding, 0))
    table = raw.join(F.broadcast(behind), "__range").select("__p", F.least(F.lit(1.0), within, F.coalesce("__m", F.lit(1.0))).alias(out))
    return df.join(table, F.col(p).eqNullSafe(F.col("__p"))).drop("__p")
