"""Shards of near-equal bytes by sampled splitters.

Rows are ordered by the hash of their text and then of their id and place in the table, so that
equal texts lie next to each other and the copies of one can be cut apart. A sample drawn in proportion to size gives quantile boundaries of many fine
ranges; exact sizes of these are counted, and ranges that turn out overfull are subdivided by
a sample of their own. A boundary falls between two texts, unless one text's copies alone
outweigh a range. The fine ranges then go to shards, the largest first, each to the emptiest.
Only slim rows are shuffled, and only once: a row's place comes from its range.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.common import map_batches, materialise

OVERHEAD = 16
#: Fine ranges per shard, and rows per fine range at most, at the mean.
RANGES = 128
RANGE_ROWS = 50_000
#: Sampled rows per fine range.
DRAWS = 12
FIRST = np.iinfo(np.int64).min


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, key, tie)`` of each row; a null text has no bytes. The tie tells
    rows apart that share text and id, so that their range can be cut."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("tie"),
    )


def locate(key: np.ndarray, tie: np.ndarray, bk: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (bk, bt) are at or before each (key, tie)."""
    lo, hi = np.searchsorted(bk, key, "left"), np.searchsorted(bk, key, "right")
    out = lo.copy()
    hit = np.flatnonzero(hi > lo)
    for a in np.unique(lo[hit]):
        of = hit[lo[hit] == a]
        b = hi[of[0]]
        out[of] = a + np.searchsorted(bt[a:b], tie[of], "right")
    return out


def boundaries(key: np.ndarray, tie: np.ndarray, parts: int) -> list[tuple[int, int]]:
    """Quantiles of a sample that cut it into about ``parts``: at the start of a text, or within
    one where it holds several quantiles."""
    if parts < 2 or not len(key):
        return []
    order = np.lexsort((tie, key))
    at = order[(np.arange(1, parts) * len(order)) // parts]
    k, t = key[at], tie[at]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    return sorted({(int(a), int(b) if r else FIRST) for a, b, r in zip(k, t, again, strict=True)})


def _ranged(rows: DataFrame, bk: np.ndarray, bt: np.ndarray) -> DataFrame:
    bounds = rows.sparkSession.sparkContext.broadcast((bk, bt))  # as many as ranges

    def run(batches):
        k, t = bounds.value
        for pdf in batches:
            yield pdf.assign(range=locate(pdf["key"].to_numpy(), pdf["tie"].to_numpy(), k, t)).astype({"doc_id": "Int64"})

    return map_batches(rows, run, "doc_id bigint, size bigint, text_crc32 bigint, key bigint, tie bigint, range bigint")


def _draw(rows: DataFrame, per_byte: float, salt: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of rows drawn with probability size * per_byte."""
    u = F.pmod(F.xxhash64("key", "tie", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(u < F.col("size") * per_byte).select("key", "tie").toPandas()
    return got["key"].to_numpy(np.int64), got["tie"].to_numpy(np.int64)


def shard(docs: DataFrame, shards: int = 40, rounds: int = 3) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of
    ``docs(doc_id, text, ...)``; the law is ``bytes``.

    Null texts count as empty. Rows repeated or sharing a doc_id each get a slot of their own;
    a null doc_id stays null. An empty table has no rows. Other columns are ignored.
    """
    rows = materialise(sized(docs), "sized")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 0
    parts = max(shards * RANGES, n // RANGE_ROWS)
    target = max(1.0, total / parts)
    bounds = set(boundaries(*_draw(rows, DRAWS / target, "0"), parts)) if n else set()
    for again in range(1, rounds + 2):
        ordered = sorted(bounds)
        bk = np.array([k for k, _ in ordered], np.int64)
        bt = np.array([t for _, t in ordered], np.int64)
        ranged = _ranged(rows, bk, bt)
        sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.max("size").alias("top"))
        sizes = sizes.toPandas()  # a row for each range
        over = sizes[(sizes["n"] > 1) & (sizes["b"] > 2 * target) & (sizes["b"] > 1.5 * sizes["top"])]
        if again > rounds or not len(over):
            break
        wanted = dict(zip(over["range"], over["b"], strict=True))
        mine = ranged.where(F.col("range").isin([int(x) for x in wanted])) if len(wanted) < 200 else ranged
        key, tie = _draw(mine, DRAWS * 4 / target, str(again))
        of = locate(key, tie, bk, bt)
        groups = defaultdict(list)
        for i, r in enumerate(of.tolist()):
            if r in wanted:
                groups[r].append(i)
        for r, at in groups.items():
            bounds.update(boundaries(key[at], tie[at], int(np.ceil(wanted[r] / target))))
    # the largest range first, each to the emptiest shard
    place: dict[int, int] = {}
    heap = [(0, s) for s in range(shards)]
    for r, b in sorted(zip(sizes["range"].tolist(), sizes["b"].tolist(), strict=True), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        place[r] = s
        heapq.heappush(heap, (load + b, s))
    count = dict(zip(sizes["range"].tolist(), sizes["n"].tolist(), strict=True))
    table = np.zeros((2, len(bk) + 1), np.int64)  # shard of a range, slot of its first row
    filled = [0] * shards
    for r in sorted(place):
        table[:, r] = place[r], filled[place[r]]
        filled[place[r]] += count[r]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for pdf in batches:
            s, base = shared.value[:, pdf["range"].to_numpy()]
            out = pdf[["doc_id", "size", "text_crc32"]].astype({"doc_id": "Int64"})
            yield out.assign(law="bytes", shard=s.astype(np.int32), slot=base + pdf["row"].to_numpy(), grown_shard=pd.array([None] * len(out), "Int32"))

    row = F.row_number().over(W.partitionBy("range").orderBy("key", "tie", "doc_id")) - 1
    return map_batches(
        ranged.withColumn("row", row.cast("bigint")), run, "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"
    )
