"""What the corpus operators share: tables, scratch space on the shared folder, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table below ``sf_dir``, through Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary one is made.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="netloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/netloom/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute
    it nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch. Rows run from a few bytes to megabytes, so rows alone bound nothing.
BATCH_BYTES = 8 << 20


def map_batches(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInPandas(run, schema)`` with batches of ``BATCH_BYTES`` at most (or of what the
    session sets below that). Batches are cut when a plan runs, so the setting stays."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    known = re.match(r"\d+", conf.get(key))
    if not known or int(known[0]) <= 0 or int(known[0]) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return rows.mapInPandas(run, schema)


def slices(texts: list[str | None], size: int = 1 << 18):
    """Bounds of runs of texts of about ``size`` characters, or of one longer text."""
    at = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and total + n > size:
            yield at, i
            at = i
            total = 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of ``edges(a, b)`` (both bigint).

    Alternates the large-star and small-star steps, so rounds grow with the logarithm
    of the longest path. Every step is a shuffled aggregate and a shuffled join, and the
    edges of each round are checkpointed on the shared folder. Self-loops, null ends and
    repeated edges are allowed and add nothing. Raises if ``max_rounds`` don't suffice.
    Returns ``(node, component)``; nodes without an edge to another node are absent.
    """
    shared_dir(edges.sparkSession)
    cur = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    seen = None
    for _ in range(max_rounds):
        # large star: what lies above a node hangs on the least of its neighbourhood
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            cur.join(low, cur.b == low.u)
            .select("a", F.col("m").alias("b"))
            .distinct()
        )
        # small star: what lies below a node, and the node, hang on the least of them
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        down = large.join(least, large.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = (
            down.where("a <> b")
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
            .checkpoint()
        )
        state = nxt.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")
        ).first()
        cur = nxt
        # a forest of stars: every upper end has one edge, and no lower end is an upper one
        if state == seen or state[0] == 0:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
