"""SimHash fingerprints, exact tiled comparison of them, and near-duplicate groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import connected_components, map_batches, materialise

BLOCK_BITS = 16
#: Rows of a bucket from which it is split into tiles of equal population counts.
TILE = 4096


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words of the ASCII-lower-cased text, repeats
    included; of all its words if there are fewer; empty for a null or wordless text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        w = [b" ".join(w)]
    else:
        w = list(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(x, 42) for x in w], np.uint64, len(w))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    n = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        n += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(n * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp bigint)``: the fingerprint's 64 bits as a signed number, a row for a row."""

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(shingle_hashes(t, words)) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, fp bigint")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links i-j reach."""
    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, label[i], m)
        np.minimum.at(label, label[j], m)
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (was == label).all():
            break
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
    while (label != label[label]).any():
        label = label[label]
    return label


def tile_links(group: np.ndarray, fp: np.ndarray, radius: int, more: np.ndarray | None = None) -> np.ndarray:
    """The least row that each row reaches by links of ``radius`` differing bits or fewer
    inside its group. Rows are ordered by group and population count and compared along
    the diagonals of each group's tile; a diagonal ends where the counts are further apart
    than the radius, as they differ by no more than the bits do."""
    n = len(fp)
    pop = np.bitwise_count(fp).astype(np.int64)
    if more is not None:  # 64 further bits of each
        pop += np.bitwise_count(more)
    order = np.lexsort((pop, group))
    g, x, p = group[order], fp[order], pop[order]
    z = more[order] if more is not None else None
    label = np.arange(n)
    live = np.arange(n)
    shift = 1
    ends_i, ends_j = [], []
    held = 0
    while True:
        live = live[live + shift < n]
        live = live[(g[live] == g[live + shift]) & (p[live + shift] - p[live] <= radius)]
        if not len(live):
            break
        differ = np.bitwise_count(x[live] ^ x[live + shift])
        if z is not None:
            differ = differ + np.bitwise_count(z[live] ^ z[live + shift])
        hit = live[differ <= radius]
        if len(hit):
            ends_i.append(hit)
            ends_j.append(hit + shift)
            held += len(hit)
            if held > 1 << 20:  # fold what is known into labels: links aren't gathered without end
                label = _forest(n, np.concatenate([*ends_i, np.arange(n)]), np.concatenate([*ends_j, label]))
                ends_i, ends_j, held = [], [], 0
        shift += 1
    label = _forest(n, np.concatenate([*ends_i, np.arange(n)]), np.concatenate([*ends_j, label]))
    out = np.arange(n)
    out[order] = order[label]
    return out


def by_group(links, columns: tuple[str, str]):
    """A function over batches of rows sorted by two columns that calls ``links`` on whole
    groups only; a group may span batches."""

    def run(batches):
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            last = pdf[list(columns)].iloc[-1]
            tail = (pdf[columns[0]] == last.iloc[0]) & (pdf[columns[1]] == last.iloc[1])
            rest = pdf[tail]
            if not tail.all():
                yield links(pdf[~tail].reset_index(drop=True))
        if rest is not None:
            yield links(rest.reset_index(drop=True))

    return run


def _compare(radius: int):
    """Links within each group of rows sorted by (k, pair)."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf["k"].to_numpy()
        pair = pdf["pair"].to_numpy()
        change = np.ones(len(k), bool)
        change[1:] = (k[1:] != k[:-1]) | (pair[1:] != pair[:-1])
        more = pdf["more"].to_numpy().view(np.uint64) if "more" in pdf else None
        root = tile_links(np.cumsum(change), pdf["fp"].to_numpy().view(np.uint64), radius, more)
        far = root != np.arange(len(root))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

    return by_group(links, ("k", "pair"))


def bucket_links(keyed: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """``keyed(k bigint, fp bigint, id bigint)`` -> ``(a, b)``: for each k a spanning forest
    of the links of ``radius`` bits or fewer. A column ``more`` holds 64 further bits.

    A k of over ``tile`` rows is split into tiles by population count and salt. Only pairs
    of tiles whose counts differ by the radius at most are dealt out, each to one group, so
    that no task gets a whole large bucket.
    """
    spark = keyed.sparkSession
    more = ["more"] if "more" in keyed.columns else []
    pop = F.expr("bit_count(fp) + bit_count(more)" if more else "bit_count(fp)").cast("bigint")
    hot = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("k")
    fine = (
        keyed.join(hot, "k")
        .groupBy("k", pop.alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("tiles", F.ceil(F.col("n") / tile).cast("bigint"))
    )
    fine = materialise(fine, "tiles")
    if fine.isEmpty():
        dealt = keyed.select("k", F.lit(0).cast("bigint").alias("pair"), "fp", *more, "id")
    else:
        # (k, p) -> the tiles of p and of all counts within the radius
        near = (
            fine.select("k", "p", F.col("tiles").alias("own"))
            .withColumn("q", F.explode(F.sequence(F.col("p") - radius, F.col("p") + radius)))
            .join(fine.select("k", F.col("p").alias("q"), "tiles"), ["k", "q"])
            .groupBy("k", "p", "own")
            .agg(F.collect_list(F.struct("q", "tiles")).alias("others"))
        )
        salted = keyed.withColumn("p", pop).join(near, ["k", "p"], "left")
        other = F.explode(
            F.flatten(
                F.transform("others", lambda o: F.transform(F.sequence(F.lit(0).cast("bigint"), o["tiles"] - 1), lambda t: F.shiftleft(o["q"], 32) + t))
            )
        )
        many = (
            salted.where("own IS NOT NULL")
            .withColumn("mine", F.shiftleft(F.col("p"), 32) + F.pmod(F.xxhash64("id"), F.col("own")))
            .withColumn("other", other)
            .select("k", F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other")).alias("pair"), "fp", *more, "id")
        )
        dealt = salted.where("own IS NULL").select("k", F.lit(0).cast("bigint").alias("pair"), "fp", *more, "id").unionByName(many)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return map_batches(dealt.repartition(n, "k", "pair").sortWithinPartitions("k", "pair"), _compare(radius), "a bigint, b bigint")


def link_fingerprints(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """``fps(fp, id)``, each fp once -> spanning links ``(a, b)`` between ids.

    Two fingerprints with ``radius`` differing bits or fewer agree on one of ``radius + 1``
    blocks of their bits, so comparing the rows of each block value loses no link.
    """
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    keys = F.array(
        *[
            F.expr(f"shiftleft({i}L, 58) ^ (shiftrightunsigned(fp, {lo}) & {(1 << min(hi - lo, 57)) - 1}L)")
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
        ]
    )
    return bucket_links(fps.select(F.explode(keys).alias("k"), "fp", "id"), radius, tile)


def simhash_components(docs: DataFrame, radius: int = 3, words: int = 3, tile: int = TILE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Null, empty and wordless texts have fingerprint 0. Equal fingerprints are folded before
    any comparison. Rows repeated or sharing a doc_id are each returned; a row with a null doc_id
    links like any other but its id is no component's smallest: a component of such rows alone
    has a null component_id. An empty table gives no rows. Other columns are ignored.
    """
    fps = materialise(fingerprints(docs, words), "fingerprints")
    top = fps.agg(F.max("doc_id")).first()[0] or 0
    # a fingerprint that only rows without an id have gets a number above all ids
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialise(distinct.select("fp", F.coalesce("least", F.lit(max(top, 0) + 1) + F.monotonically_increasing_id()).alias("id")), "distinct")
    comp = connected_components(link_fingerprints(distinct, radius, tile))
    whole = distinct.join(comp, distinct.id == comp.node, "left").select("fp", F.coalesce("component", "id").alias("least"))
    component = F.when(F.col("least") <= max(top, 0), F.col("least"))
    return fps.join(whole, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id")
    )


#: Near duplicates: words of a shingle, least Jaccard similarity, and bits of 128 by which the
#: fingerprints of a pair that shares a rare shingle may differ to be looked at. A pair of
#: similarity 0.8 differs in 19.4 bits on average (24 for sets of 4 and 5 shingles, the worst).
NEAR_WORDS, NEAR_SIMILARITY, NEAR_RADIUS = 5, 0.8, 40
#: Texts, in expectation, that tell which shingles are common, occurrences there from which one
#: is, and common shingles known at most. They decide the work, not the result.
COMMON_TEXTS, COMMON_TIMES, COMMON_SHINGLES = 20_000, 8, 1 << 16
#: Texts of a cluster that are compared in one task; a larger cluster is dealt out in pairs of
#: tiles of half as many.
CLUSTER = 512


def _second(h: np.ndarray) -> np.ndarray:
    """64 further bits of a shingle's hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """``(uid, first, node, fp, more)``: ``node`` hashes the lower-cased words in order; the
    fingerprints are those of the set of shingles that is compared later."""

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                h = np.unique(shingle_hashes(t, words))
                node = xxhash.xxh64_intdigest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()), 7)
                out.append((node, fingerprint(h), fingerprint(_second(h))))
            a = np.array(out, np.uint64).reshape(-1, 3).view(np.int64)
            yield pd.DataFrame({"uid": pdf["uid"], "first": pdf["first"], "node": a[:, 0], "fp": a[:, 1], "more": a[:, 2]})

    return map_batches(docs, run, "uid bigint, first bigint, node bigint, fp bigint, more bigint")


def common_shingles(texts: DataFrame, n: int, words: int) -> np.ndarray:
    """Hashes of the shingles that many texts of a sample hold, the commonest last."""

    def run(batches):
        for pdf in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in pdf["text"]]
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)})

    share = min(1.0, COMMON_TEXTS / max(n, 1))
    few = texts.where(F.pmod(F.xxhash64("uid", F.lit("common")), F.lit(1 << 30)) < int(share * (1 << 30)))
    times = map_batches(few.select("text"), run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = times.where(F.col("n") >= COMMON_TIMES).orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toPandas()
    return rows["h"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def prefix(shingles: np.ndarray, percent: int, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first of a set's shingles in the order of all: those in ``known`` (sorted) last, by
    their ``place``. Two sets of a similarity of percent/100 or more share ``percent`` of a hundred
    of either at least, so the prefixes that leave out one less than that have one in common."""
    n = len(shingles)
    if not n:
        return shingles
    rank = np.full(n, -1)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, place[at], -1)
    order = np.lexsort((shingles, rank))
    return shingles[order[: n + (-percent * n) // 100 + 1]]


def _prefixed(nodes: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """``nodes(id, fp, more, text)`` -> a row ``(k, fp, more, id)`` for each shingle of its prefix."""
    place = np.argsort(common)
    shared = nodes.sparkSession.sparkContext.broadcast((common[place], place))

    def run(batches):
        known, place = shared.value
        for pdf in batches:
            rows = [prefix(np.unique(shingle_hashes(t, words)), percent, known, place) for t in pdf["text"]]
            many = [len(x) for x in rows]
            k = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
            again = {c: np.repeat(pdf[c].to_numpy(), many) for c in ("fp", "more", "id")}
            yield pd.DataFrame({"k": k.view(np.int64), **again})

    return map_batches(nodes.select("id", "fp", "more", "text"), run, "k bigint, fp bigint, more bigint, id bigint")


def similar_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of sorted unique arrays whose Jaccard similarity is at least percent/100."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    common = np.zeros((n, n), np.float64)
    values, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, index, count = np.unique(values, return_inverse=True, return_counts=True)
    use = count[index] > 1
    index, row = index[use], row[use]
    if len(index):
        _, index = np.unique(index, return_inverse=True)
        width = 4096
        order = np.argsort(index, kind="stable")
        index, row = index[order], row[order]
        cuts = np.searchsorted(index, np.arange(0, index[-1] + width + 1, width))
        for c, (at, to) in enumerate(zip(cuts, cuts[1:], strict=False)):
            m = np.zeros((n, width), np.float32)
            m[row[at:to], index[at:to] - c * width] = 1
            common += m @ m.T
    union = size[:, None] + size[None, :] - common
    return np.nonzero(np.triu(100 * common >= percent * union, 1))


def _verify(words: int, percent: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, g in pdf.groupby(["cluster", "pair"], sort=False):
            ids = g["id"].to_numpy()
            if len(ids) < 2:
                continue
            root = _forest(len(ids), *similar_pairs([np.unique(shingle_hashes(t, words)) for t in g["text"]], percent))
            far = root != np.arange(len(ids))
            out_a.append(ids[far])
            out_b.append(ids[root[far]])
        return pd.DataFrame({"a": np.concatenate(out_a or [np.zeros(0, np.int64)]), "b": np.concatenate(out_b or [np.zeros(0, np.int64)])})

    return by_group(links, ("cluster", "pair"))


def without_near_duplicates(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY, cluster: int = CLUSTER) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id.

    Texts with the same words in order (white space and the case of A-Z aside) are copies; null,
    empty and wordless texts are copies of each other. Of the rest, pairs whose sets of
    shingles of ``words`` words have a Jaccard similarity of ``similarity`` or more are linked,
    and groups are the components of the links.
    Candidates share a shingle of their prefixes, the rarest fifth or so of their shingles, as
    every such pair does, and their 128-bit SimHash fingerprints differ by ``NEAR_RADIUS`` bits
    at most. The candidates' clusters are then compared exactly. Null ids come after all others; of rows sharing id and text one
    stays. All columns of ``docs`` are kept.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("bigint").alias("uid"))
    odd = slim.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR uid IS NULL")
    if odd.isEmpty():
        rows, uid = docs, F.col("doc_id").cast("bigint")
    else:  # ids that don't tell rows apart
        rows = materialise(docs.withColumn("__uid", F.monotonically_increasing_id()), "numbered")
        uid = F.col("__uid")
    first = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    texts = rows.select(uid.alias("uid"), first.alias("first"), F.col("text").cast("string").alias("text"))
    marks = materialise(_marked(texts, words), "marks")
    nodes = marks.groupBy("node").agg(
        F.min(F.struct("first", "uid")).alias("best"), F.first("fp").alias("fp"), F.first("more").alias("more")
    )
    nodes = materialise(nodes.select(F.col("node").alias("id"), "best", "fp", "more"), "nodes")
    percent = round(100 * similarity)
    alone = nodes.select("id", "fp", "more", F.col("best.uid").alias("uid")).join(texts.select("uid", "text"), "uid")
    common = common_shingles(alone.select("uid", "text"), nodes.count(), words)
    keyed = materialise(_prefixed(alone, words, percent, common), "prefixes")
    found = connected_components(bucket_links(keyed, NEAR_RADIUS))
    found = materialise(found.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    sizes = found.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) * 2 / cluster).cast("bigint").alias("tiles"))
    many = found.join(sizes.where(F.col("tiles") > 2), "cluster", "left").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles"))
    pairs = F.when(
        F.col("tiles").isNotNull(),
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1), lambda t: F.shiftleft(F.least("tile", t), 32) + F.greatest("tile", t)),
    ).otherwise(F.array(F.lit(0).cast("bigint")))
    dealt = (
        many.select("id", "cluster", F.explode(pairs).alias("pair"))
        .join(nodes.select("id", F.col("best.uid").alias("uid")), "id")
        .join(texts.select("uid", "text"), "uid")
        .select("cluster", "pair", "id", "text")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = dealt.repartition(n, "cluster", "pair").sortWithinPartitions("cluster", "pair")
    links = map_batches(dealt, _verify(words, percent), "a bigint, b bigint")
    groups = connected_components(links)
    of = nodes.join(groups, nodes["id"] == groups["node"], "left").select("id", "best", F.coalesce("component", "id").alias("group"))
    kept = of.groupBy("group").agg(F.min("best").alias("best")).select(F.col("best.uid").alias("__kept"))
    return rows.join(kept, uid == F.col("__kept"), "left_semi").select(*docs.columns)
