"""Packing of tokenised documents into sequences by minimum bin slack.

Documents become token ids once; their whole windows of ``capacity`` ids are sequences of
their own, and what remains of each is packed: a histogram of the remaining lengths (at most
``capacity - 1`` classes, however many documents) goes to the driver, where a bitset
subset-sum dynamic program picks, window after window, the multiset of lengths that fills it
closest to capacity. The multiset is read back from the bitsets as counts per length and used
as often as the histogram allows. If nothing fills a window exactly, one piece is cut to close
the gap; what is left over at the end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.common import map_batches, materialise
from netloom.llm.tokens import IdEncoder

CAPACITY = 4096
#: Rows of one length and salt, at the mean, that are ranked in one task.
RANKED = 20_000


@dataclass
class _Class:
    """Items of one length: what starts at ``start`` of the remainders that are ``rest``
    ids long and ranked ``lo`` to ``hi`` (exclusive) among these."""

    rest: int
    start: int
    lo: int
    hi: int


@dataclass
class Plan:
    """Where each piece of a remainder goes, in parallel lists. The rows of one (rest, start)
    cover disjoint ranks."""

    rest: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)  # ranks that the row covers
    hi: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)  # of the piece, within the remainder
    length: list[int] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)  # pieces of this row in a sequence
    seq: list[int] = field(default_factory=list)  # the first sequence
    offset: list[int] = field(default_factory=list)  # of the first copy in a sequence
    sequences: int = 0

    def add(self, c: _Class, n: int, length: int, copies: int, seq: int, offset: int, start: int | None = None) -> None:
        self.rest.append(c.rest)
        self.lo.append(c.lo)
        self.hi.append(c.lo + n)
        self.start.append(c.start if start is None else start)
        self.length.append(length)
        self.copies.append(copies)
        self.seq.append(seq)
        self.offset.append(offset)


def best_fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of lengths, each used at most as often as it is there, that is no more
    than ``room``, and the counts used. Bitset subset-sum: bit s of a set says that s can be
    reached; a length's copies enter in powers of two; longest lengths first, and the search
    ends as soon as the room can be filled exactly."""
    full = (1 << (room + 1)) - 1
    sets, steps, reach = [1], [], 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            reach |= (reach << (k * length)) & full
            steps.append((length, k))
            sets.append(reach)
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    at = total
    for i in range(len(steps) - 1, -1, -1):
        if not sets[i] >> at & 1:  # only with this step's copies
            length, k = steps[i]
            used[length] += k
            at -= length * k
    return total, dict(used)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, first: int = 0) -> Plan:
    """Pack ``histogram[length]`` remainders (0 < length < capacity) into sequences numbered
    from ``first``. Each is full, but for the last few, whose lengths are powers of two."""
    plan = Plan(sequences=first)
    classes: dict[int, list[_Class]] = defaultdict(list)
    counts: dict[int, int] = {}
    for length, n in sorted(histogram.items()):
        if n:
            classes[length].append(_Class(length, 0, 0, n))
            counts[length] = n

    def take(length: int, n: int, copies: int, seq: int, offset: int) -> None:
        """n items, ``copies`` to a sequence."""
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        while n:
            c = classes[length][-1]
            k = min(n, c.hi - c.lo)
            if k < n:
                k -= k % copies
            if not k:  # the class ends inside a sequence: one item at a time
                _one(c, length, copies, seq, offset)
                n -= copies
                seq += 1
                continue
            plan.add(c, k, length, copies, seq, offset)
            seq += k // copies
            n -= k
            c.lo += k
            if c.lo == c.hi:
                classes[length].pop()

    def _one(c: _Class, length: int, copies: int, seq: int, offset: int) -> None:
        for i in range(copies):
            c = classes[length][-1]
            plan.add(c, 1, length, 1, seq, offset + i * length)
            c.lo += 1
            if c.lo == c.hi:
                classes[length].pop()

    def cut(length: int, gap: int, n: int, seq: int, offset: int) -> None:
        """Cut n items after ``gap`` ids: the first part of each goes to a sequence of its own
        from ``seq`` on, the rest of it becomes an item again."""
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        counts[length - gap] = counts.get(length - gap, 0) + n
        while n:
            c = classes[length][-1]
            k = min(n, c.hi - c.lo)
            plan.add(c, k, gap, 1, seq, offset)
            classes[length - gap].append(_Class(c.rest, c.start + gap, c.lo, c.lo + k))
            seq += k
            n -= k
            c.lo += k
            if c.lo == c.hi:
                classes[length].remove(c)

    total = sum(k * v for k, v in counts.items())
    while total >= capacity:
        head = max(counts)
        counts[head] -= 1
        filled, used = best_fill(counts, capacity - head)
        counts[head] += 1
        used[head] = used.get(head, 0) + 1
        filled += head
        gap = capacity - filled
        short = min((x for x in counts if x > gap and counts[x] > used.get(x, 0)), default=0) if gap else 0
        need = {**used, short: used.get(short, 0) + 1} if gap else used
        repeat = min(counts[x] // k for x, k in need.items())
        offset = 0
        for length, k in sorted(used.items(), reverse=True):
            take(length, repeat * k, k, plan.sequences, offset)
            offset += k * length
        if gap:  # every item left is longer than the gap
            cut(short, gap, repeat, plan.sequences, offset)
        plan.sequences += repeat
        total -= repeat * capacity
    # the rest: one sequence for each power of two in its binary form
    room = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    fill = 0
    while room:
        length = max((x for x in counts if x <= room[0] - fill), default=0)
        if length:
            take(length, 1, 1, plan.sequences, fill)
            fill += length
        else:
            length = min(counts)
            cut(length, room[0] - fill, 1, plan.sequences, fill)
            fill = room[0]
        if fill == room[0]:
            room.pop(0)
            plan.sequences += 1
            fill = 0
    return plan


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, ids binary, n, row)``: little-endian unsigned 16-bit
    ids of the whole text and ``end_id`` (a null text has that one id alone), and a number that
    tells rows apart."""

    def run(batches):
        encoder = IdEncoder.shared(tokenizer_path)
        end = int(end_id).to_bytes(2, "little")
        for pdf in batches:
            ids = [encoder.packed(t or "") + end for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids, "n": [len(x) // 2 for x in ids], "row": pdf["row"]})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, ids binary, n bigint, row bigint")


def ranked(tokens: DataFrame, capacity: int) -> tuple[DataFrame, dict[int, int], int]:
    """Give each row its place (from 0) among the rows of the same remainder, and the number of
    whole windows before its own. Ranks run within (remainder, salt) and then go on from
    offsets per salt, so that a remainder that a third of all rows share is ranked by many
    tasks. Returns the rows, the histogram of remainders, and the number of whole windows."""
    n = tokens.count()
    salts = max(16, n // RANKED)
    rows = tokens.withColumn("rest", F.col("n") % capacity).withColumn("whole", F.expr(f"n div {capacity}")).withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.lit(salts))
    )
    sizes = materialise(
        rows.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("rows"), F.sum("whole").alias("windows")), "sizes"
    )
    histogram = {r["rest"]: r["c"] for r in sizes.groupBy("rest").agg(F.sum("rows").alias("c")).collect()}
    per_rest = sizes.groupBy("rest").agg(F.sum("windows").alias("w")).collect()  # capacity rows at most
    before, base = 0, {}
    for r in sorted(per_rest, key=lambda r: r["rest"]):
        base[r["rest"]] = before
        before += r["w"]
    spark = tokens.sparkSession
    bases = spark.createDataFrame(sorted(base.items()) or [(0, 0)], "rest bigint, base bigint")
    along = W.partitionBy("rest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("rank0", F.coalesce(F.sum("rows").over(along), F.lit(0)))
        .withColumn("win0", F.coalesce(F.sum("windows").over(along), F.lit(0)))
        .join(F.broadcast(bases), "rest")
        .select("rest", "salt", "rank0", (F.col("win0") + F.col("base")).alias("win0"))
    )
    within = W.partitionBy("rest", "salt").orderBy("row")
    numbered = (
        rows.join(offsets, ["rest", "salt"])
        .withColumn("rank", F.col("rank0") + F.row_number().over(within) - 1)
        .withColumn(
            "window",
            F.col("win0") + F.coalesce(F.sum("whole").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .select("doc_id", "ids", "n", "rest", "whole", "rank", "window")
    )
    return numbered, {k: v for k, v in histogram.items() if k}, before


def ids_crc32(packed: bytes) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.frombuffer(packed, "<u2").astype("<u4").tobytes())


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, checksums: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` into sequences of at most ``capacity`` ids.

    Returns a row for each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset`` and
    ``ids`` (little-endian unsigned 16-bit), or with ``checksums`` their ``ids_crc32``, made where
    the pieces are, so that ids are not sent on. Every id of every row is in exactly one piece.
    Rows repeated or sharing a doc_id are each packed; a null doc_id stays null; null and empty
    texts have the end id alone; an empty table has no sequence. Other columns are ignored.
    """
    tokens = materialise(tokenise(docs, tokenizer_path, end_id), "tokens")
    rows, histogram, windows = ranked(tokens, capacity)
    plan = plan_packing(histogram, capacity, windows)
    order = np.lexsort((plan.lo, plan.start, plan.rest)) if plan.rest else np.zeros(0, int)
    names = ("rest", "lo", "hi", "start", "length", "copies", "seq", "offset")
    table = {k: np.asarray(getattr(plan, k), np.int64)[order] for k in names}
    # grows with the number of classes, which the capacity bounds, not with the documents
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        t = shared.value
        by_rest: dict[int, list[tuple[list, list]]] = defaultdict(list)
        edge = np.flatnonzero(np.diff(t["rest"], prepend=-1) | np.diff(t["start"], prepend=-1)).tolist()
        for at, to in zip(edge, [*edge[1:], len(t["rest"])], strict=True):
            by_rest[int(t["rest"][at])].append((t["lo"][at:to].tolist(), list(range(at, to))))
        cols = {k: v.tolist() for k, v in t.items()}
        for pdf in batches:
            out: list[tuple] = []
            for doc, ids, n, rest, whole, rank, window in pdf.itertuples(index=False):
                for i in range(whole):
                    out.append((doc, i * capacity, capacity, n, window + i, 0, ids[2 * i * capacity : 2 * (i + 1) * capacity]))
                if rest:
                    for los, at in by_rest[rest]:
                        k = at[bisect_right(los, rank) - 1]
                        if cols["lo"][k] <= rank < cols["hi"][k]:
                            j = rank - cols["lo"][k]
                            m, length = cols["copies"][k], cols["length"][k]
                            start = whole * capacity + cols["start"][k]
                            out.append((doc, start, length, n, cols["seq"][k] + j // m, cols["offset"][k] + j % m * length, ids[2 * start : 2 * (start + length)]))
            pieces = pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64"})
            if checksums:
                crc = np.array([ids_crc32(x) for x in pieces["ids"]], np.int64)
                pieces = pieces.drop(columns="ids").assign(ids_crc32=crc)
            yield pieces

    last = "ids_crc32 bigint" if checksums else "ids binary"
    return map_batches(rows, run, f"doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, {last}")
