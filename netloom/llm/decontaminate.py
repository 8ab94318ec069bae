"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages: runs of ``BLOCK`` words, an item's length of blocks at a time, a
block further each time. Words are hashed and counted over all documents. A randomised SVD of the
TF-IDF passages of the median item's length, from every block of every text on (range finder with
a power iteration, sums over partitions), gives a latent space; the leading directions, which only
tell languages and common words apart, are left out, and the others are scaled to weigh alike. A
passage is a candidate for the items of its length that its projection reaches a cosine of
``COSINE`` with.

Candidates are checked word by word: the longest common subsequence of the item and the passage
with its surroundings must hold most of the item's words in order within a stretch not much
longer than the item, and the item's last words, its answer, must be there as well. The
subsequence can be no longer than the number of the item's words in the passage, so this is counted
first, for all passages and items, and cosines are taken of the pairs that it leaves: no pair that
would pass the check is lost by that. An item or a passage without a projection, as its words are
all commonplace, has no cosine: such pairs are candidates if they have words enough in common.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import map_batches, materialise, slices
from netloom.llm.wordhash import Words, split_words

BITS = 15
BLOCK = 8
#: Directions kept, leading ones dropped, and further ones drawn for accuracy.
RANK, DROP, EXTRA = 48, 4, 8
POWER = 1
#: Words in more than this share of the passages say nothing of a passage.
COMMONPLACE = 0.05
#: Least cosine of a candidate.
COSINE = 0.4
#: Length, of a word's median one, up to which a projection counts as none.
FLAT = 1e-4
#: Least share of an item's words in order in the passage, and of its last words.
COMMON, ANSWER = 0.6, 0.5
ANSWER_WORDS = 5
LONGER = 1.6
#: Share of an item's words, the commonest, that the first count leaves out. It decides the work,
#: not the result.
UNCOUNTED = 0.3
#: Items to a block of queries.
QUERIES = 512
_WORD = re.compile(r"[^\W_]+")


def _index(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Batch:
    """Words of a slice of texts, cut into blocks that end with their text."""

    term: np.ndarray
    doc: np.ndarray
    block: np.ndarray  # of a word
    first: np.ndarray  # word of a block
    of: np.ndarray  # text of a block


def blocks(texts: list[str | None], w: Words | None = None) -> Batch:
    w = w or split_words(texts)
    n = len(w.hash)
    new = np.diff(w.doc, prepend=-1) != 0
    at = np.arange(n)
    place = at - np.maximum.accumulate(np.where(new, at, 0)) if n else at
    head = place % BLOCK == 0
    return Batch(_index(w.hash), w.doc, np.cumsum(head) - 1, np.flatnonzero(head), w.doc[head])


def hashed_words(docs: DataFrame) -> DataFrame:
    """``terms``: each text's hashed words, little-endian unsigned 16-bit, on the shared folder."""

    def run(batches):
        for pdf in batches:
            texts, out = pdf["text"].tolist(), []
            for at, to in slices(texts):
                b = blocks(texts[at:to])
                ends = np.searchsorted(b.doc, np.arange(to - at + 1)).tolist()
                raw = b.term.astype("<u2").tobytes()
                out += [raw[2 * x : 2 * y] for x, y in zip(ends, ends[1:], strict=False)]
            yield pd.DataFrame({"terms": out})

    return materialise(map_batches(docs.select("text"), run, "terms binary"), "words")


def word_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How often each hashed word occurs in all documents, and how many blocks these have. In a
    passage of some dozen words few occur twice, so occurrences stand for passages that have
    the word."""
    return _count(hashed_words(docs))


def _count(hashed: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        count, total = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            count += np.bincount(np.frombuffer(b"".join(pdf["terms"]), "<u2"), minlength=1 << BITS)
            total += sum(-(-len(x) // (2 * BLOCK)) for x in pdf["terms"])
        at = np.flatnonzero(count)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(count[at], total)})

    rows = map_batches(hashed, run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row for each term
    df = np.zeros(1 << BITS, np.int64)
    there = rows[rows["term"] >= 0]
    df[there["term"].to_numpy()] = there["n"].to_numpy()
    return df, int(rows.loc[rows["term"] < 0, "n"].sum())


def idf_of(df: np.ndarray, passages: int) -> np.ndarray:
    """0 for a term that is commonplace."""
    idf = np.log((1.0 + passages) / (1.0 + df)).astype(np.float32)
    return np.where(df > COMMONPLACE * passages, np.float32(0), idf)


def _sums(table: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups, which rise, and the sums of the rows ``table[at]`` of each; the table's last row
    is 0. Eight rows at a time: many times faster than ``np.add.reduceat`` on narrow tables."""
    while True:
        new = np.flatnonzero(np.diff(group, prepend=-1))
        if len(new) == len(group):
            return group, table[at]
        many = np.diff(new, append=len(group))
        eights = -(-many // 8)
        grid = np.full(8 * int(eights.sum()), len(table) - 1)
        grid[np.arange(len(group)) - np.repeat(new - 8 * (np.cumsum(eights) - eights), many)] = at
        grid = grid.reshape(-1, 8)
        out = np.zeros((len(grid) + 1, table.shape[1]), table.dtype)
        for k in range(0, len(grid), 2048):  # what the caches hold
            g, part = grid[k : k + 2048], out[k : min(k + 2048, len(grid))]
            row = np.empty_like(part)
            for j in range(8):
                np.take(table, g[:, j], axis=0, out=row, mode="clip")
                part += row
        table, at, group = out, np.arange(len(grid)), np.repeat(group[new], eights)


def _between(rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sums of ``rows[a:b]`` for each of the bounds, which rise."""
    out = np.empty((len(start), *rows.shape[1:]), rows.dtype)
    for k in range(0, len(start), 1024):  # what the caches hold
        a, b = start[k : k + 1024], stop[k : k + 1024]
        upto = np.zeros((b[-1] - a[0] + 1, *rows.shape[1:]))
        np.cumsum(rows[a[0] : b[-1]], axis=0, out=upto[1:])
        out[k : k + 1024] = upto[b - a[0]] - upto[a - a[0]]
    return out


def _gram(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a tall matrix, largest first, and its right singular vectors, from the
    small matrix ``z' z``."""
    total = np.zeros((z.shape[1],) * 2)
    for k in range(0, len(z), 1 << 12):
        part = z[k : k + (1 << 12)].astype(np.float64)
        total += part.T @ part
    s, v = np.linalg.eigh(total)
    return np.sqrt(np.maximum(s[::-1], 0)), v[:, ::-1]


def latent_space(hashed: DataFrame, idf: np.ndarray, span: int, seed: int = 7) -> np.ndarray:
    """(terms, RANK) directions: right singular vectors of the TF-IDF passages of all texts of
    ``hashed_words``: from each block on that has ``span`` blocks left; a shorter text is one passage.

    Each step of the subspace iteration is a sum over partitions of ``A' (A Q)``, whose size
    depends on the number of terms, directions and cores only.
    """
    spark = hashed.sparkSession
    width = RANK + DROP + EXTRA
    q = np.random.default_rng(seed).standard_normal((1 << BITS, width), np.float32)
    slice_rows = 1 << 12
    few = hashed.coalesce(max(6, 2 * spark.sparkContext.defaultParallelism))  # all rows; each task sends sums of all terms

    def step(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((idf, q))

        def run(batches):
            idf, q = shared.value
            none = np.zeros((1, width), np.float32)
            weighted = np.vstack([q * idf[:, None], none])
            total = np.zeros((1 << BITS, width), np.float64)
            for pdf in batches:
                texts = pdf["terms"].tolist()
                for at, to in slices(texts, 1 << 20):
                    raw = texts[at:to]
                    term = np.frombuffer(b"".join(raw), "<u2").astype(np.int64)
                    many = np.array([len(x) // 2 for x in raw], np.int64)
                    pieces = -(-many // BLOCK)
                    ends = np.cumsum(pieces)
                    place = np.arange(len(term)) - np.repeat(np.cumsum(many) - many, many)
                    row = np.repeat(ends - pieces, many) + place // BLOCK
                    use = idf[term] > 0
                    term, row = term[use], row[use]
                    if not len(term):
                        continue
                    # a block is in the passages that begin up to span - 1 blocks before it
                    block, head, tail = np.arange(ends[-1]), np.repeat(ends - pieces, pieces), np.repeat(ends, pieces)
                    stop, since = np.minimum(block + span, tail), np.maximum(block - span + 1, head)
                    whole = (block == head) | (block + span <= tail)
                    there, sums = _sums(weighted, term, row)
                    y = np.zeros((len(block), width), np.float32)
                    y[there] = sums
                    y = _between(y, block, stop)
                    norm = _between(np.bincount(row, idf[term] ** 2, len(block)), block, stop)
                    lit = whole & (_between(np.bincount(row, minlength=len(block)), block, stop) > 0)
                    y *= np.where(lit, 1 / np.where(lit, norm, 1), 0)[:, None].astype(np.float32)  # rows of unit length, on both sides
                    y = np.vstack([_between(y, since, block + 1), none])
                    order = np.argsort(term.astype(np.uint16), kind="stable")
                    term, back = _sums(y, row[order], term[order])
                    total[term] += back
            total *= idf[:, None]
            for k in range(0, 1 << BITS, slice_rows):
                yield pd.DataFrame({"k": [k], "part": [total[k : k + slice_rows].astype(np.float32).tobytes()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            out = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["part"])
            return pd.DataFrame({"k": pdf["k"].iloc[:1], "part": [out.astype(np.float32).tobytes()]})

        parts = map_batches(few, run, "k bigint, part binary").groupBy("k").applyInPandas(add, "k bigint, part binary")
        out = np.zeros((1 << BITS, width), np.float32)
        for r in parts.toLocalIterator():
            out[r["k"] : r["k"] + slice_rows] = np.frombuffer(r["part"], np.float32).reshape(-1, width)
        shared.destroy()
        return out

    def scaled(z: np.ndarray, power: float) -> np.ndarray:
        """Left singular vectors times a power of their singular values; 0 where there is no more than rounding."""
        s, v = _gram(z)
        there = s > 1e-5 * max(s[0], 1e-30)
        return z @ (v * np.where(there, np.where(there, s, 1) ** (power - 1), 0)).astype(np.float32)

    for _ in range(POWER):
        q = scaled(step(q), 0)
    # the singular values of A'A are squared ones: divided by their roots, all directions weigh alike
    # and passages that have nothing to do with each other are as good as perpendicular
    return np.ascontiguousarray(scaled(step(q), -0.5)[:, DROP : DROP + RANK])


def longest_common(item: list, passage: list) -> tuple[int, int, list[bool]]:
    """Length of the longest common subsequence, the length of the stretch of ``passage`` that
    it lies in, and which places of ``item`` are in it."""
    n, m = len(item), len(passage)
    t = np.zeros((n + 1, m + 1), np.int32)
    eq = np.asarray(item, np.uint64)[:, None] == np.asarray(passage, np.uint64)[None, :]
    for i in range(n):
        best = np.where(eq[i], t[i, :-1] + 1, t[i, 1:])
        t[i + 1, 1:] = np.maximum.accumulate(best)
    used, at = [False] * n, []
    i, j = n, m
    while i and j:
        if t[i, j] == t[i - 1, j]:
            i -= 1
        elif t[i, j] == t[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            used[i] = True
            at.append(j)
    return int(t[n, m]), (at[0] - at[-1] + 1 if at else 0), used


def lacking(item: list, distinct: set, passage: list) -> bool:
    """Whether the item's distinct words that the passage lacks, once each, are too many."""
    return len(item) - len(distinct) + len(distinct.intersection(passage)) < COMMON * len(item)


def same_text(item: list, passage: list) -> float:
    """Share of the item that a passage holds, or 0 if it is no paraphrase of it."""
    if not item or not passage:
        return 0.0
    if lacking(item, set(item), passage):
        return 0.0
    n, stretch, used = longest_common(item, passage)
    tail = used[-min(ANSWER_WORDS, len(item)) :]
    if n < COMMON * len(item) or stretch > LONGER * len(item) + 4 or sum(tail) < ANSWER * len(tail):
        return 0.0
    return n / len(item)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(doc_id, item_id, overlap)``: for every document and benchmark item that it holds, in
    the item's words or a paraphrase, the share of the item's words found.

    The items are a stated query set, searched in blocks against every passage of every
    document. Null and wordless texts hold nothing and are held by nothing; rows sharing a
    doc_id, and items sharing an item_id, give one row with the largest overlap; a null doc_id
    is given as null. Empty tables give no rows. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id bigint, item_id bigint, overlap double"
    ids, texts = [], []
    known: list[tuple[list, list]] = []
    for r in items.where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        if len(ids) == QUERIES:
            known.append((ids, texts))
            ids, texts = [], []
    if ids:
        known.append((ids, texts))
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    if not known:
        return out
    sizes = [len(split_words([t]).hash) for _, ts in known for t in ts]
    span = max(1, round(float(np.median(sizes)) / BLOCK))
    hashed = hashed_words(x)
    df, n = _count(hashed)
    passages = -(-n // span)
    if not passages:
        return out
    idf = idf_of(df, passages)
    space = latent_space(hashed, idf, span)
    for ids, texts in known:
        out = out.unionByName(map_batches(x, _search(spark, ids, texts, df, idf, space, cosine), schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))


def _search(spark, ids: list[int], texts: list[str], df: np.ndarray, idf: np.ndarray, space: np.ndarray, cosine: float = COSINE):
    words = [split_words([t]) for t in texts]
    keep = sorted((i for i, w in enumerate(words) if len(w.hash)), key=lambda i: len(words[i].hash))
    terms = [_index(words[i].hash) for i in keep]
    weighted = space * idf[:, None]
    vec = np.array([weighted[t].sum(0) for t in terms], np.float32).reshape(len(keep), space.shape[1])
    length = np.linalg.norm(weighted, axis=1)
    flat = FLAT * float(np.median(length[length > 0])) if length.any() else 0.0
    norm = np.linalg.norm(vec, axis=1)
    dark = norm <= flat
    vec /= np.maximum(norm, 1e-9)[:, None]
    spans = np.array([max(1, -(-len(t) // BLOCK)) for t in terms], np.int64)
    items = [words[i].hash.tolist() for i in keep]
    counted, least = zip(*(_counted(t, df) for t in terms), strict=True) if terms else ((), ())
    weighted = np.vstack([weighted, np.zeros((1, weighted.shape[1]), np.float32)])  # the last row is for no term
    shared = spark.sparkContext.broadcast((weighted, [ids[i] for i in keep], items, counted, vec, spans, np.array(least, np.int64), length > flat, flat, dark, cosine))

    def run(batches):
        _, ids, items, counted, _, spans, *_ = shared.value
        distinct = [set(x) for x in items]
        # which items have each term; the last row is for no term
        has = np.zeros(((1 << BITS) + 1, len(items)), np.uint8)
        for k, t in enumerate(counted):
            has[t, k] = 1
        for pdf in batches:
            docs, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            out = []
            for at, to in slices(texts, 1 << 18):
                w = split_words(texts[at:to])
                b = blocks(texts[at:to], w)
                if not len(b.term) or not items:
                    continue
                found, words = set(), w.hash.tolist()
                for x, i, lo, hi in _candidates(b, has, shared.value):
                    passage = words[lo:hi]
                    if lacking(items[i], distinct[i], passage) or (x, i) in found:
                        continue
                    share = same_text(items[i], passage)
                    if share:
                        found.add((x, i))
                        out.append((docs[at + x], ids[i], share))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "overlap"]).astype({"doc_id": "Int64", "item_id": "Int64", "overlap": float})

    return run


def _counted(term: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, int]:
    """The terms of an item that are counted in passages, and how many there have to be at least.

    ``COMMON`` of the item's words have to be in the passage. If the commonest of them are not counted,
    all of those may be there, and so many fewer of the others have to be.
    """
    least = int(np.ceil(COMMON * len(term) - 1e-9))
    distinct, many = np.unique(term, return_counts=True)
    order = np.argsort(-df[distinct], kind="stable")
    left = np.cumsum(many[order])
    out = int(np.searchsorted(left, min(UNCOUNTED * len(term), least - 1), side="right"))
    return distinct[order[out:]], least - (int(left[out - 1]) if out else 0)


def _candidates(b: Batch, has: np.ndarray, known: tuple):
    """(text, item, first word, end word): what has to be compared word by word, with the stretch to
    compare, the passage and two blocks on either side."""
    weighted, _, _, _, vec, spans, least, sighted, flat, dark, cosine = known
    n = len(b.of)
    block = np.arange(n)
    first, last = np.searchsorted(b.of, b.of, side="left"), np.searchsorted(b.of, b.of, side="right")
    bounds = np.append(b.first, len(b.term))
    seen = np.append(0, np.cumsum(sighted[b.term]))
    grid = np.full((n, BLOCK), 1 << BITS)
    grid[b.block, np.arange(len(b.term)) - b.first[b.block]] = b.term
    # how many counted words of each item the blocks hold, up to each block; differences are right in
    # a type that holds those of a passage
    most = BLOCK * (int(spans[-1]) + 4)
    dtype = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64
    upto = np.zeros((n + 1, len(spans)), dtype)
    for k in range(0, n, 1024):  # what the caches hold
        part = np.zeros((min(1024, n - k), len(spans)), np.uint8)
        row = np.empty_like(part)
        for j in range(BLOCK):
            np.take(has, grid[k : k + 1024, j], axis=0, out=row, mode="clip")
            part += row
        upto[k + 1 : k + 1 + len(part)] = part
    np.add.accumulate(upto, axis=0, out=upto)
    for span in np.unique(spans).tolist():
        mine = slice(*np.searchsorted(spans, [span, span + 1]).tolist())
        lo, hi = np.maximum(block - 2, first), np.minimum(block + span + 2, last)
        own = upto[:, mine]
        there = np.take(own, hi, axis=0)
        there -= np.take(own, lo, axis=0)
        x, i = np.divmod(np.flatnonzero(there >= least[mine].astype(dtype)), there.shape[1])
        if not len(x):
            continue
        # the cosines of these passages and items
        stop = np.minimum(block + span, last)
        passage, of = np.unique(x, return_inverse=True)
        many = bounds[stop[passage]] - bounds[passage]
        at = np.arange(many.sum()) + np.repeat(bounds[passage] - (np.cumsum(many) - many), many)
        _, y = _sums(weighted, b.term[at], np.repeat(np.arange(len(passage)), many))
        norm = np.linalg.norm(y, axis=1)
        blind = (seen[bounds[stop[passage]]] == seen[bounds[passage]]) | (norm <= flat)
        y /= np.maximum(norm, 1e-9)[:, None]
        i += mine.start
        hit = np.einsum("ij,ij->i", y[of], vec[i]) >= cosine
        hit |= blind[of] | dark[i]
        x, i = x[hit], i[hit]
        yield from zip(b.of[x].tolist(), i.tolist(), bounds[lo[x]].tolist(), bounds[hi[x]].tolist(), strict=True)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows with a null doc_id stay."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__bad")).where("__bad IS NOT NULL").distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
