"""Matrices of all pairs of a network's tfs, which grow with the square of their number. They are made a block
of rows at a time, in tasks, from what grows with the tfs only: tfs x genes arrays, which are sent to
the tasks, and interactions, which are kept by blocks on the shared folder. No pair is shuffled but those
that interact, and no task or driver holds more than a block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.communities import checkpoint_ready

#: Cells of a block.
CELLS = 2_000_000
#: Cells of a matrix of pairs up to which it is made on the driver.
DENSE = 4_000_000
#: Columns that are worked on at once, so that they stay near the processor.
WIDTH = 2048


def sheet(net: DataFrame, *values: str, row: str = "tf", col: str = "gene") -> tuple[list, list, np.ndarray, list[np.ndarray]]:
    """Names of rows and columns, which cells are there, and an array for each value: repeated cells
    summed, absent ones 0, sums of nulls alone NaN."""
    t = net.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(*(F.sum(v).cast("double").alias(f"v{k}") for k, v in enumerate(values))).toArrow()

    def coded(c: str) -> tuple[list, np.ndarray]:
        d = t[c].combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        names = d.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(names), int)
        place[order] = np.arange(len(names))
        return [names[k] for k in order], place[d.indices.to_numpy(zero_copy_only=False)]

    (rows, a), (cols, b) = coded(row), coded(col)
    there = np.zeros((len(rows), len(cols)), bool)
    there[a, b] = True
    out = []
    for k in range(len(values)):
        m = np.zeros(there.shape)
        m[a, b] = t[f"v{k}"].to_numpy()
        out.append(m)
    return rows, cols, there, out


def height(n: int, cells: int | None = None) -> int:
    return max(1, (cells or CELLS) // max(n, 1))


def _typed(names: list, kind: str) -> pa.Array:
    return pa.array(names, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind))


def _table(kinds: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [k.split()[0] for k in kinds.split(", ")])


def _ends(one: pa.Array, lo: int, hi: int, other: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Both ends of the pairs of a block of rows with all columns, row by row."""
    return one.take(pa.array(np.repeat(np.arange(lo, hi), len(other)))), other.take(pa.array(np.tile(np.arange(len(other)), hi - lo)))


def by_rows(spark: SparkSession, rows: list, cols: list, kinds: str, make: Callable, cells: int | None = None, swap: bool = False) -> DataFrame:
    """Rows (``kinds``: both ends, then values) of ``make(lo, hi)`` for each block of rows: arrays of (hi -
    lo) x columns, and which pairs there are (None: all). ``swap`` names the columns' ends first."""
    n, step = len(rows), height(len(cols), cells)
    blocks = -(-n // step)
    one, two = (k.split()[1] for k in kinds.split(", ")[:2])
    names = spark.sparkContext.broadcast((_typed(rows, two if swap else one), _typed(cols, one if swap else two)))

    def run(batches):
        r, c = names.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                lo, hi = k * step, min(n, (k + 1) * step)
                values, there = make(lo, hi)
                ends = _ends(r, lo, hi, c)
                out = _table(kinds, *(ends[::-1] if swap else ends), *(pa.array(v.ravel(), from_pandas=True) for v in values))
                yield out if there is None else out.filter(pa.array(there.ravel()))

    return spark.range(0, blocks, 1, max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, kinds)


def normal_equations(z: DataFrame) -> DataFrame:
    """(i, j, gram, cross) of (tf, gene, x, y): sums over the genes that both tfs have."""
    tfs, _, there, (x, y) = sheet(z, "x", "y")
    spark, kind = z.sparkSession, dict(z.dtypes)["tf"]
    known = None if not (np.isnan(x).any() or np.isnan(y).any()) else (~np.isnan(x) & there, ~np.isnan(y) & there)
    shared = spark.sparkContext.broadcast((np.nan_to_num(x), np.nan_to_num(y), None if there.all() else there.astype(float), known))

    def make(lo: int, hi: int):
        x, y, there, known = shared.value
        gram, cross = x[lo:hi] @ x.T, x[lo:hi] @ y.T
        if known is not None:
            kx, ky = (k.astype(float) for k in known)
            gram, cross = np.where(kx[lo:hi] @ kx.T > 0, gram, np.nan), np.where(kx[lo:hi] @ ky.T > 0, cross, np.nan)
        return (gram, cross), None if there is None else there[lo:hi] @ there.T > 0

    return by_rows(spark, tfs, tfs, f"i {kind}, j {kind}, gram double, cross double", make)


def transition_ols(spark: SparkSession, a: np.ndarray, b: np.ndarray, tfs: list, kind: str) -> DataFrame:
    """(tf_from, tf_to, v): what ``kernels.transition_ols`` computes. The other tfs' scores are a = Q R without
    row i: Q without the row q has the right singular vectors of (1 - c q q'), so a target's least squares
    of least norm need a decomposition of genes x genes only."""
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    q, r = np.linalg.qr(a)
    shared = spark.sparkContext.broadcast((a, b, q, r))

    def make(lo: int, hi: int):
        a, b, q, r = shared.value
        own = (a[lo:hi] * b[lo:hi]).sum(1) / np.maximum((a[lo:hi] ** 2).sum(1), 1e-300)
        y = b[lo:hi] - a[lo:hi] * own[:, None]
        p = q[lo:hi]
        size = (p * p).sum(1)
        left = np.sqrt(np.maximum(1 - size, 0))
        left[1 - size < 1e-13] = 0
        unit = p / np.sqrt(np.maximum(size, 1e-300))[:, None]
        root = np.eye(p.shape[1]) - (1 - left)[:, None, None] * unit[:, :, None] * unit[:, None, :]
        back = np.eye(p.shape[1]) + (np.divide(1, left, out=np.zeros_like(left), where=left > 0) - 1)[:, None, None] * unit[:, :, None] * unit[:, None, :]
        u, s, vt = np.linalg.svd(r.T @ root, full_matrices=False)
        keep = s > np.finfo(float).eps * max(len(a) - 1, a.shape[1]) * s.max(1, keepdims=True, initial=0)
        coef = np.einsum("bkg,bk->bg", vt, np.divide(np.einsum("bgk,bg->bk", u, y), s, out=np.zeros_like(s), where=keep))
        out = np.einsum("bgh,bh->bg", back, coef) @ q.T
        out[np.arange(hi - lo), np.arange(lo, hi)] = 0.0
        return (np.where(np.abs(out) < 1e-12, 0.0, out),), None

    return by_rows(spark, tfs, tfs, f"tf_from {kind}, tf_to {kind}, v double", make, swap=True)


def network(spark: SparkSession, tfs: list, genes: list, kinds: str, *arrays: np.ndarray) -> DataFrame:
    """Long rows of tfs x genes arrays, made in tasks."""
    shared = spark.sparkContext.broadcast(arrays)
    return by_rows(spark, tfs, genes, kinds, lambda lo, hi: (tuple(m[lo:hi] for m in shared.value), None), 200_000)


# --- interactions ------------------------------------------------------------------------


def similar(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, none: bool = False) -> np.ndarray:
    """x y / sqrt(|nx + ny - |x y||), with the squared lengths given; ``none`` makes 0 of a division by 0."""
    a = x @ y
    d = nx[:, None] + ny
    d -= np.abs(a)
    np.abs(d, out=d)
    np.sqrt(d, out=d)
    return np.divide(a, d, out=np.zeros_like(a), where=d > 0) if none else np.divide(a, d, out=a)


class Interactions:
    """tfs x tfs interactions (i, j, weight) by blocks of rows, repeated pairs summed and absent ones 0, as sparse
    rows on the shared folder. With ``both`` a pair without a weight takes that of the other way, the
    diagonal is ``diag``, and ``frozen`` places have theirs only."""

    def __init__(self, ppi: DataFrame, tfs: list, kind: str, both: bool = False, diag: float = 1.0, frozen: np.ndarray | None = None, cells: int | None = None) -> None:
        spark, self.n, self.tfs, self.kind = ppi.sparkSession, len(tfs), tfs, kind
        tasks = 4 * spark.sparkContext.defaultParallelism
        self.spark, self.step = spark, min(height(len(tfs), cells), max(1, len(tfs) // (4 * tasks)))
        n, step, off = self.n, self.step, np.array([] if frozen is None else frozen, int)
        at = spark.createDataFrame(pa.table({"name": _typed(tfs, kind), "at": pa.array(range(n), pa.int32())}))
        named = lambda c, to: F.broadcast(at.select(F.col("name").alias(c), F.col("at").alias(to)))  # noqa: E731 - a row a tf
        known = ppi.join(named("i", "r"), "i").join(named("j", "c"), "j").select("r", "c", F.col("weight").cast("double").alias("v"))
        block = lambda c: F.floor(F.col(c) / step).cast("int").alias("block")
        rows = known.select(block("r"), "r", "c", "v", F.lit(True).alias("own")).unionByName(known.select(block("c"), F.col("c").alias("r"), F.col("r").alias("c"), "v", F.lit(False).alias("own")))
        every = spark.range(-(-n // step)).select(F.col("id").cast("int").alias("block"), F.lit(-1).alias("r"), F.lit(-1).alias("c"), F.lit(0.0).alias("v"), F.lit(True).alias("own"))

        def pack(key, table):
            k = key[0].as_py()
            lo, hi = k * step, min(n, (k + 1) * step)
            r, c, v, own = (table[x].to_numpy() for x in ("r", "c", "v", "own"))
            m, t = (np.bincount(((r[o] - lo) * n + c[o]).astype(np.int64), np.nan_to_num(v[o]), (hi - lo) * n).astype(float).reshape(hi - lo, n) for o in ((r >= 0) & own.astype(bool), (r >= 0) & ~own.astype(bool)))
            if both:
                m, t = np.where(m != 0, m, t), np.where(t != 0, t, m)
                for x in (m, t):
                    d = x[:, lo:hi]
                    np.fill_diagonal(d, diag)
                    if len(off):
                        inside = off[(off >= lo) & (off < hi)]
                        x[inside - lo] = 0
                        x[:, off] = 0
                        x[inside - lo, inside] = 1
                        np.fill_diagonal(d, np.where(np.diag(d) == 0, diag, np.diag(d)))
            at = np.nonzero(m)
            v = m[at]
            v = v[:1] if len(v) and (v == v[0]).all() else v  # equal weights are kept once
            parts = [np.bincount(at[0], minlength=hi - lo).astype(np.int32), at[1].astype(np.int32), v, np.diag(m[:, lo:hi]), m.mean(1), m.var(1), t.mean(1), t.var(1)]
            return pa.table({"block": pa.array([k], pa.int32()), **{x: pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for x, p in zip(("n", "c", "v", "d", "rm", "rv", "cm", "cv"), parts, strict=True)}})

        schema = "block int, n binary, c binary, v binary, d binary, rm binary, rv binary, cm binary, cv binary"
        self.rows = checkpoint_ready(rows.unionByName(every).repartition(tasks, "block").groupBy("block").applyInArrow(pack, schema))
        got = sorted(self.rows.select("block", "d", "rm", "rv", "cm", "cv").toArrow().to_pylist(), key=lambda x: x["block"])  # five numbers a tf
        self.diagonal, rm, rv, cm, cv = (np.concatenate([np.frombuffer(x[k]) for x in got]) for k in ("d", "rm", "rv", "cm", "cv"))
        mean = rm.mean()
        sd = np.sqrt((rv + (rm - mean) ** 2).mean())

        def line(m: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            with np.errstate(all="ignore"):
                return np.where(var > 0, 1 / np.sqrt(var), 1 / sd) / np.sqrt(2), np.where(var > 0, m / np.sqrt(var), mean / sd) / np.sqrt(2)

        #: A normalised cell is x (scale of row + of column) - (shift of row + of column).
        self.lines = (*line(rm, rv), *line(cm, cv))

    def map(self, make: Callable, schema: str, normal: bool = True) -> DataFrame:
        """Record batches of ``make(lo, hi, rows)``, with the block's rows dense, normalised if asked for."""
        n, step = self.n, self.step
        lines = self.spark.sparkContext.broadcast(self.lines)

        def run(batches):
            s, u, t, v = lines.value
            for batch in batches:
                for x in batch.to_pylist():
                    lo = x["block"] * step
                    hi = min(n, lo + step)
                    m = np.zeros((hi - lo, n))
                    w = np.frombuffer(x["v"])
                    m[np.repeat(np.arange(hi - lo), np.frombuffer(x["n"], np.int32)), np.frombuffer(x["c"], np.int32)] = w[0] if len(w) == 1 else w
                    if normal:
                        for a in range(0, n, WIDTH):
                            p, b = m[:, a : a + WIDTH], slice(a, a + WIDTH)
                            p *= s[lo:hi, None] + t[b]
                            p -= u[lo:hi, None] + v[b]
                    yield make(lo, hi, m)

        return self.rows.select("block", "n", "c", "v").mapInArrow(run, schema)

    def times(self, make: Callable, normal: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Arrays of all tfs, tfs x width and a number a tf, from ``make(lo, hi, rows)``, on the driver."""
        one = lambda lo, hi, m: pa.RecordBatch.from_pydict({"block": pa.array([lo], pa.int32()), "x": pa.array([(y := make(lo, hi, m))[0].tobytes()], pa.binary()), "d": pa.array([y[1].tobytes()], pa.binary())})
        got = sorted(self.map(one, "block int, x binary, d binary", normal).toArrow().to_pylist(), key=lambda x: x["block"])
        return np.concatenate([np.frombuffer(x["x"]) for x in got]).reshape(-1, width), np.concatenate([np.frombuffer(x["d"]) for x in got])


def message_step(p: Interactions, w: np.ndarray, c: np.ndarray, genes: list, gene_kind: str, alpha: float = 0.1) -> DataFrame:
    """``networks.message_step`` of normalised arrays and of interactions, which are normalised by blocks."""
    r, g = _typed(p.tfs, p.kind), _typed(genes, gene_kind)
    shared = p.spark.sparkContext.broadcast((w, c, r, g))
    schema = f"tf {p.kind}, gene {gene_kind}, v double"

    def make(lo: int, hi: int, m: np.ndarray) -> pa.RecordBatch:
        w, c, r, g = shared.value
        part, wide = w[lo:hi], (w * w).sum(0)
        moved = similar(m, w, (m * m).sum(1), wide, True) + similar(part, c, (part * part).sum(1), (c * c).sum(0), True)
        return _table(schema, *_ends(r, lo, hi, g), ((1 - alpha) * part + alpha * moved / 2).ravel())

    return p.map(make, schema)


def off_diagonal(a: np.ndarray, lo: int) -> np.ndarray:
    """The deviation of the cells of each row off the diagonal, where row 0 is row ``lo`` of the whole."""
    n, own = a.shape[1], a[np.arange(len(a)), np.arange(lo, lo + len(a))]
    if n < 2:
        return np.zeros(len(a))
    mean = (a.sum(1) - own) / (n - 1)
    d = a - mean[:, None]
    return np.sqrt(np.maximum(((d * d).sum(1) - (own - mean) ** 2) / (n - 1), 0))


def cooperation_step(p: Interactions, w: np.ndarray, alpha: float = 0.1, step: int = 0, frozen: list | None = None) -> DataFrame:
    """``networks.cooperation_step`` of a normalised array and of interactions: all pairs, which is the result."""
    off = np.isin(np.array(p.tfs, object), np.array(frozen or [], object))
    r = _typed(p.tfs, p.kind)
    shared = p.spark.sparkContext.broadcast((w, (w * w).sum(1), off, r))
    schema = f"i {p.kind}, j {p.kind}, v double"

    def make(lo: int, hi: int, m: np.ndarray) -> pa.RecordBatch:
        w, size, off, r = shared.value
        new = similar(w[lo:hi], w.T, size[lo:hi], size, True)
        at = np.arange(hi - lo), np.arange(lo, hi)
        new[at] = off_diagonal(new, lo) * len(w) * np.exp(2 * alpha * step)
        new *= alpha
        new += (1 - alpha) * m
        if off.any():
            own = new[at]
            new[off[lo:hi]] = m[off[lo:hi]]
            new[:, off] = m[:, off]
            new[at] = own
        return _table(schema, *_ends(r, lo, hi, r), new.ravel())

    return p.map(make, schema)


def descent_gradient(p: Interactions, w: np.ndarray, c: np.ndarray, lam: float, gamma: float, trace: float) -> np.ndarray:
    """W W'W + P W + W C, with P and C as descent weighs them: P is read by blocks."""
    shared = p.spark.sparkContext.broadcast(w)
    pw, _ = p.times(lambda lo, hi, m: (m @ shared.value, np.zeros(hi - lo)), False, w.shape[1])
    shared.destroy()
    return w @ (w.T @ w + c) - (1 - lam) / trace * pw + gamma * w


def descent_step(p: Interactions, w: np.ndarray, c: np.ndarray, genes: list, gene_kind: str, lam: float = 0.035, gamma: float = 0.335, eta: float = 1e-5, bexp: float = 1.0) -> DataFrame:
    """``networks.descent_step`` of arrays and of interactions: (tf, gene, gradient, v)."""
    w, c = w / np.sqrt((w * w).sum()), -lam * c / np.trace(c)
    g = descent_gradient(p, w, c, lam, gamma, p.diagonal.sum())
    b1, b2 = 0.9, 0.999  # the moments' decay
    root, lead = (1 - b2 ** (bexp + 1)) ** 0.5, 1 - b1 ** (bexp + 1)
    moved = w - root / lead * eta * 4 * (1 - b1) * g / (1e-8 * root + np.sqrt(16 * (1 - b2) * g * g))
    return network(p.spark, p.tfs, genes, f"tf {p.kind}, gene {gene_kind}, gradient double, v double", g, moved)


def otter(p: Interactions, w: np.ndarray, c: np.ndarray, lam=0.035, gamma=0.335, rounds=60, eta=1e-5, bexp=1.0) -> np.ndarray:
    """``kernels.otter`` with interactions by blocks."""
    trace = p.diagonal.sum()
    trace = trace if trace > 0 else 1.0
    c, w = -lam * c / np.trace(c), w / np.sqrt((w * w).sum())
    m, v, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.9, 0.999
    for i in range(1, rounds + 1):
        grad = descent_gradient(p, w, c, lam, gamma, trace)
        m = b1 * m + 4 * (1 - b1) * grad
        v = b2 * v + 16 * (1 - b2) * grad * grad
        t1, t2 = b1 ** (bexp + i), b2 ** (bexp + i)
        root = np.sqrt(1 - t2)
        w = w - root / (1 - t1) * eta * m / (1e-8 * root + np.sqrt(v))
    return w


def panda(c: np.ndarray, p: Interactions, w: np.ndarray, threshold: float = 0.001, alpha: float = 0.1, frozen: np.ndarray | None = None, rounds: int = 500):
    """``kernels.panda`` with cooperation by blocks: its rows are made anew in each round from the interactions and
    the regulations of the rounds before, so that nothing of the size tfs x tfs is kept. Returns w,
    the number of steps and the last change."""
    from netloom.operators import kernels as K

    c, w = c.copy(), w.copy()
    off = np.zeros(len(w), bool)
    off[np.array([] if frozen is None else frozen, int)] = True
    sc = p.spark.sparkContext
    before, change, step = [], np.inf, 0  # (regulation, squared lengths of its rows, diagonal of its similarity or None) of the rounds
    while change > threshold and step < rounds:
        now, past = sc.broadcast(w), list(before)

        def make(lo: int, hi: int, m: np.ndarray, now=now, past=past):
            w, n, k = now.value, m.shape[1], len(past)
            fixed = m[:, off].copy(), m[off[lo:hi]].copy()
            at = np.arange(hi - lo), np.arange(lo, hi)
            last = np.zeros(hi - lo)
            m *= (1 - alpha) ** k
            for l, (kept, diagonal) in enumerate(past):
                x, size = kept.value
                share = alpha * (1 - alpha) ** (k - 1 - l)
                own = m[at]
                if diagonal is None:
                    new = similar(x[lo:hi], x.T, size[lo:hi], size)
                    last = off_diagonal(new, lo) * n * np.exp(2 * alpha * l)
                    new *= share
                    m += new
                else:
                    for a in range(0, n, WIDTH):
                        b = slice(a, a + WIDTH)
                        new = similar(x[lo:hi], x[b].T, size[lo:hi], size[b])
                        new *= share
                        m[:, b] += new
                m[at] = own + share * (last if diagonal is None else diagonal.value[lo:hi])
            if k and off.any():
                own = m[at]
                m[:, off], m[off[lo:hi]] = fixed
                m[at] = own
            return similar(m, w, (m * m).sum(1), (w * w).sum(0)), last

        responsible, last = p.times(make, True, w.shape[1])
        now.destroy()
        if before:
            before[-1] = (before[-1][0], sc.broadcast(last))
        ra = 0.5 * (responsible + K.tanimoto(w, c))
        change = float(np.abs(w - ra).mean())
        w = (1 - alpha) * w + alpha * ra
        if change > threshold:
            before.append((sc.broadcast((w, (w * w).sum(1))), None))
            new = K.tanimoto(w.T, w)
            K.diagonal(new, w.shape[1], alpha, step)
            c = (1 - alpha) * c + alpha * new
        step += 1
    for kept, diagonal in before:
        kept.destroy()
        if diagonal is not None:
            diagonal.destroy()
    if not change <= threshold:
        raise RuntimeError(f"message passing did not settle in {rounds} rounds")
    return w, step, change
