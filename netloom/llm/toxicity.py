"""Toxicity by multiple-instance learning: documents carry labels, sentences get scores.

A sentence's score is ``p = sigmoid(bias + sum of the weights of its words)``; a word's weight
is that of its hash plus those of its first 4 and 5 bytes, so that inflected forms share what
they learn. A document is toxic unless all its sentences let it pass: a noisy-or,
``1 - prod (1 - p_s) ** e_s``. A sentence's exponent ``e_s`` is its share of the document's
words times a learned strength: with plain exponents of 1 a long clean text would be condemned
by its length alone. Bias, weights and strength are learned together from document labels by
gradient ascent on the likelihood, so the sentences that offend are found, not given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import map_batches, slices
from netloom.llm.wordhash import Words, split_words

BITS = 17
PREFIXES = (4, 5)
#: Labelled documents that a fit takes at most, in expectation, and their bytes of text.
FIT_ROWS = 5000
FIT_BYTES = 12_000_000


def features(w: Words, bits: int = BITS) -> np.ndarray:
    """(words, 1 + prefixes) indices of weights."""
    shift = np.uint64(64 - bits)
    return np.stack([(w.hash >> shift), *((w.prefix[m] >> shift) for m in PREFIXES)], axis=1).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    strength: float

    def sentence_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
        """Logit, document and number of words of each sentence that has words; the words."""
        w = split_words(texts, PREFIXES, digits=False)
        if not len(w.hash):
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), w
        first = np.flatnonzero(np.diff(w.sentence, prepend=-1))
        of_word = self.weights[features(w)].sum(1)
        z = self.bias + np.add.reduceat(of_word, first)
        return z, w.doc[first], np.diff(np.append(first, len(w.hash))), w

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability for each text; a text without words has one sentence of bias alone."""
        z, doc, n, _ = self.sentence_logits(texts)
        words = np.bincount(doc, n, len(texts))
        passed = np.bincount(doc, np.logaddexp(0, z) * n, len(texts)) / np.maximum(words, 1)
        passed = np.where(words > 0, passed, np.logaddexp(0, self.bias))
        return -np.expm1(-self.strength * passed)

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(first byte, end byte, p) of each sentence of a text: where it offends."""
        z, _, n, w = self.sentence_logits([text])
        stop = np.cumsum(n)
        return [
            (int(w.start[e - k]), int(w.start[e - 1] + w.size[e - 1]), float(1 / (1 + np.exp(-x))))
            for x, k, e in zip(z, n, stop, strict=True)
        ]


def strictness(toxic: int) -> float:
    """Standard errors that tell an index from chance, given the number of toxic documents: 2 up to 50
    of them, where no index could reach more, rising to 4 at 300 and beyond."""
    return 2 + 2 * min(1.0, max(0.0, float(np.log(max(toxic, 1) / 50) / np.log(6))))


def telling(texts: list[str | None], y: np.ndarray, least: float | None = None) -> np.ndarray:
    """Which indices are denser in toxic documents than in others: their mean share of a
    document's words differs by over ``least`` standard errors (Welch; ``strictness`` unless given),
    and at least 3 toxic documents have them. The rest, nearly all, would only let single
    documents be remembered."""
    pos = y > 0
    least = strictness(int(pos.sum())) if least is None else least
    n1, n0 = max(pos.sum(), 1), max((~pos).sum(), 1)
    seen, s1, s0, q1, q0 = (np.zeros(1 << BITS) for _ in range(5))
    for at, to in slices(texts):
        w = split_words(texts[at:to], PREFIXES, digits=False)
        f, docs = features(w), to - at
        total = np.maximum(np.bincount(w.doc, minlength=docs), 40)
        for c in range(f.shape[1]):
            pair, n = np.unique(f[:, c] * docs + w.doc, return_counts=True)  # sorted: by index
            j, d = pair // docs, pair % docs
            x = np.minimum(n / total[d], 0.1)
            on = pos[at + d]
            seen += np.bincount(j[on], minlength=1 << BITS)
            s1 += np.bincount(j[on], x[on], 1 << BITS)
            q1 += np.bincount(j[on], x[on] ** 2, 1 << BITS)
            s0 += np.bincount(j[~on], x[~on], 1 << BITS)
            q0 += np.bincount(j[~on], x[~on] ** 2, 1 << BITS)
    m1, m0 = s1 / n1, s0 / n0
    se = np.sqrt((q1 / n1 - m1**2) / n1 + (q0 / n0 - m0**2) / n0 + 1e-12)
    return (seen >= 3) & (m1 - m0 > least * se)


def gathered(texts: list[str | None], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known indices and the sentence of each; every sentence's document and number of words. A
    slice of texts at a time, so that words are never held for all of them."""
    parts = []
    sentences = 0
    for at, to in slices(texts):
        w = split_words(texts[at:to], PREFIXES, digits=False)
        first = np.flatnonzero(np.diff(w.sentence, prepend=-1))
        count = np.diff(np.append(first, len(w.hash)))
        f = features(w)
        word, column = np.nonzero(known[f])
        sentence = np.repeat(np.arange(sentences, sentences + len(first)), count)
        parts.append((f[word, column], sentence[word], w.doc[first] + at, count))
        sentences += len(first)
    idx, sen, doc, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    return idx, sen, doc, count


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 200, rate: float = 0.08, l2: float = 2e-6) -> Model:
    """Likelihood fit by Adam over all given documents at once; classes weigh as they are.

    Without documents, or with one class only, the model gives that class's share throughout.
    """
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        share = min(max(share, 0.01), 0.99)
        lam = -np.log1p(-share)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(np.expm1(lam))), 1.0)
    idx, sen, doc, count = gathered(texts, telling(texts, y))
    words = np.maximum(np.bincount(doc, count, len(texts)), 1)
    share = count / words[doc]
    has = np.bincount(doc, minlength=len(texts)) > 0
    theta = np.zeros(1 << BITS)
    bias, strength = -4.0, np.log(20.0)
    m, v = np.zeros((1 << BITS) + 2), np.zeros((1 << BITS) + 2)
    for step in range(1, epochs + 1):
        z = bias + np.bincount(sen, theta[idx], len(doc))
        soft, p = np.logaddexp(0, z), 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        mean = np.where(has, np.bincount(doc, soft * share, len(texts)), np.logaddexp(0, bias))
        k = np.exp(strength)
        lam = np.maximum(k * mean, 1e-9)
        # log P(toxic) = log(1 - exp(-lam)), log P(clean) = -lam
        g_lam = (y / np.expm1(np.minimum(lam, 50)) - (1 - y)) / len(y)
        g_z = g_lam[doc] * k * share * p
        g_b = g_z.sum() + (g_lam * k * ~has).sum() / (1 + np.exp(-bias))
        g = np.concatenate([np.bincount(idx, g_z[sen], 1 << BITS) - l2 * theta, [g_b, (g_lam * lam).sum()]])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        theta += d[:-2]
        bias += d[-2]
        strength += d[-1]
    return Model(theta.astype(np.float32), float(bias), float(np.exp(strength)))


def held_out(doc_id, modulus: int, remainder: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> pd.DataFrame:
    """At most about ``rows`` labelled documents and ``size`` bytes of text, drawn by a hash of
    the id from all labelled documents outside the held-out part. A document with two different
    labels, or with a null id or label, teaches nothing."""
    y = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
        .where("lo = hi")
        .select("doc_id", F.col("lo").alias("y"))
    )
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    x = x.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    seen = x.select("doc_id", F.octet_length("text").alias("b")).join(y, "doc_id").agg(F.count(F.lit(1)), F.sum("b")).first()
    share = min(1.0, rows / max(seen[0], 1), size / max(seen[1] or 0, 1))
    drawn = y.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    return x.join(drawn, "doc_id").orderBy("doc_id").toPandas()


def learn(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    rows = training_rows(docs, labels, **kw)
    return fit(rows["text"].tolist(), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, score)``, a row for a row.

    Null, empty and wordless texts get the score of a sentence without known words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            out = np.zeros(len(texts))
            for at, to in slices(texts):
                out[at:to] = shared.value.score(texts[at:to])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": out})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns are kept. The
    score is computed beside each row, so neither repeated nor null ids matter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        out = np.zeros(len(texts))
        for at, to in slices(texts):
            out[at:to] = shared.value.score(texts[at:to])
        return pd.Series(out)

    return docs.where(scored(F.col("text").cast("string")) < threshold)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; learned from the
    labels of rows whose crc32(doc_id) mod 5 is not 0. A null doc_id counts as not held out and
    teaches nothing; null, empty and wordless texts get the score of a sentence without known
    words; repeated rows each get the same score; without labels, or with one kind only, all score
    alike; an empty table gives no rows; other columns are ignored."""
    model = learn(docs, labels)
    out = score(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
