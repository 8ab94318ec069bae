"""Language identification by segmentation-marginalised unigrams over a fixed vocabulary.

For each language a probability for every piece of a public vocabulary; a word's probability
in the language is the sum over all ways to cut it into pieces, by the forward algorithm. The
pieces' probabilities are learned by expectation-maximisation (forward-backward over all
segmentations). A text's languages are compared by the sum of its words' log probabilities;
a word is scored once per worker for all languages together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import map_batches, slices

#: Documents per language that a fit takes at most, in expectation, and their characters.
FIT_ROWS = 500
FIT_CHARS = 400_000
ROUNDS = 3
_LETTERS = re.compile(r"[^\W\d_]+")
_STRICT = regex.compile(r"\p{L}+")
_SPACE = "▁"
_FLOOR = 1e-7
#: Letters up to which words are scored together as arrays; longer ones are scored one by one.
_LONG = 38
#: Word scores that a worker keeps; beyond that it starts anew.
WORDS = 300_000


def vocabulary(path: str) -> list[str]:
    """Pieces of letters (and the word mark) of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in pieces if p == _SPACE or _LETTERS.fullmatch(p.lstrip(_SPACE))})


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) of the lower-cased text."""
    text = (text or "").lower()
    words = _LETTERS.findall(text)
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # number signs such as superscripts count as word characters but not as letters
    return [x for w in words for x in ([w] if w.isalpha() else _STRICT.findall(w))]


def _lattice(word: str, index: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(from, to, piece) of the marked word; a lone letter outside the vocabulary is piece -1."""
    s = _SPACE + word
    n = len(s)
    out = []
    for i in range(n):
        got = False
        for j in range(i + 1, min(n, i + longest) + 1):
            k = index.get(s[i:j])
            if k is not None:
                out.append((i, j, k))
                got |= j == i + 1
        if not got:
            out.append((i, i + 1, -1))
    return out


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # (languages, pieces)

    def __post_init__(self) -> None:
        # pieces that no language uses weigh nothing beside the segmentations without them
        used = [i for i, p in enumerate(self.pieces) if len(p) == 1 or (len(self.languages) and self.prob[:, i].max() > 2 * _FLOOR)]
        self.index = {self.pieces[i]: k for k, i in enumerate(used)}
        self.column = np.vstack([self.prob[:, used].T, np.full((1, len(self.languages)), _FLOOR)])
        self.reach: dict[str, int] = {}  # longest piece that begins with these two letters
        for p in self.index:
            self.reach[p[:2]] = max(self.reach.get(p[:2], 1), len(p))
        self.forget()

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "prob": self.prob}

    def __setstate__(self, state) -> None:
        self.__init__(**state)

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(self.languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages) log P(word | language): the forward algorithm over all words
        and languages together; over ``_LONG`` letters a word at a time."""
        short = [i for i, w in enumerate(words) if len(w) <= _LONG]
        if len(short) < len(words):
            out = np.zeros((len(words), len(self.languages)))
            if short:
                out[short] = self.word_scores([words[i] for i in short])
            for i, w in enumerate(words):
                if len(w) > _LONG:
                    out[i] = self.long_score(w)
            return out
        get, reach, missing = self.index.get, self.reach.get, len(self.column) - 1
        arcs = []
        for w, word in enumerate(words):
            s = _SPACE + word
            n = len(s)
            for i in range(n):
                k = get(s[i], missing)
                arcs.append(((i + 1) << 48) | (i << 40) | (w << 16) | k)
                for j in range(i + 2, min(n, i + reach(s[i : i + 2], 1)) + 1):
                    k = get(s[i:j])
                    if k is not None:
                        arcs.append((j << 48) | (i << 40) | (w << 16) | k)
        a = np.array(arcs, np.int64)
        a.sort()
        w, k = (a >> 16) & 0xFFFFFF, a & 0xFFFF
        alpha = np.zeros((_LONG + 2, len(words), len(self.languages)))
        alpha[0] = 1.0
        step = a >> 40
        bounds = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(a))
        for at, to in zip(bounds, bounds[1:], strict=False):
            i, j = int(step[at]) & 0xFF, int(step[at]) >> 8
            ww = w[at:to]  # each word once
            alpha[j, ww] += alpha[i, ww] * self.column[k[at:to]]
        ends = np.array([len(x) + 1 for x in words])
        return np.log(np.maximum(alpha[ends, np.arange(len(words))], 1e-300))

    def long_score(self, word: str) -> list[float]:
        """log P(word | language) of a word of any length: a window of forward sums, as wide as the
        longest piece, that is scaled up whenever it gets small."""
        get, reach, missing = self.index.get, self.reach.get, len(self.column) - 1
        column = self.column.tolist()
        s = _SPACE + word
        n, wide = len(s), max(self.reach.values(), default=1) + 1
        none = [0.0] * len(self.languages)
        ahead = [none] * wide  # sums at place i + d are in (i + d) % wide
        ahead[0] = [1.0] * len(self.languages)
        scale = list(none)
        for i in range(n):
            now, ahead[i % wide] = ahead[i % wide], none
            for c, x in enumerate(now):
                if x < 1e-150:
                    up = 1e150 if x > 1e-300 else 1e300
                    scale[c] -= math.log(up)
                    now = [y * up if d == c else y for d, y in enumerate(now)]
                    for j in range(wide):
                        if ahead[j] is not none:
                            ahead[j] = [y * up if d == c else y for d, y in enumerate(ahead[j])]
            for j in range(i + 1, min(n, i + max(reach(s[i : i + 2], 1), 1)) + 1):
                k = get(s[i:j], missing if j == i + 1 else None)
                if k is not None:
                    ahead[j % wide] = [a + x * p for a, x, p in zip(ahead[j % wide], now, column[k], strict=True)]
        return [math.log(max(x, 1e-300)) + y for x, y in zip(ahead[n % wide], scale, strict=True)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Most probable language and its posterior for each text, languages being equally
        likely beforehand; ``und`` and 0 without a letter."""
        lists = [words_of(t) for t in texts]
        if len(self.cache) > WORDS:
            self.forget()
        cache = self.cache
        flat = [w for x in lists for w in x]
        new = list({w: None for w in flat if w not in cache})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            have = len(cache)
            while have + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[have : have + len(part)] = self.word_scores(part)
            cache.update(zip(part, range(have, have + len(part)), strict=True))
        index = np.fromiter(map(cache.__getitem__, flat), np.int64, len(flat))
        out: list[tuple[str, float]] = []
        at = 0
        for x in lists:
            if not x or not self.languages:
                out.append(("und", 0.0))
            else:
                t = self.rows[index[at : at + len(x)]].sum(0)
                best = int(np.argmax(t))
                out.append((self.languages[best], float(1 / np.exp(t - t[best]).sum())))
            at += len(x)
        return out


def _expected(lat: list[tuple[int, int, int]], size: int, q: list[float]) -> list[float] | None:
    """How often each arc of a word's lattice is used, in expectation over its segmentations."""
    fwd, bwd = [0.0] * (size + 1), [0.0] * (size + 1)
    fwd[0] = bwd[size] = 1.0
    for i, j, k in lat:
        fwd[j] += fwd[i] * q[k]
    if fwd[size] > 1e-280:
        for i, j, k in reversed(lat):
            bwd[i] += bwd[j] * q[k]
        return [fwd[i] * q[k] * bwd[j] / fwd[size] for i, j, k in lat]
    # a long word: the same in logarithms
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)
    lq = [math.log(x) if x > 0 else -math.inf for x in q]
    fwd, bwd = [-math.inf] * (size + 1), [-math.inf] * (size + 1)
    fwd[0] = bwd[size] = 0.0
    for i, j, k in lat:
        fwd[j] = add(fwd[j], fwd[i] + lq[k])
    if fwd[size] == -math.inf:
        return None
    for i, j, k in reversed(lat):
        bwd[i] = add(bwd[i], bwd[j] + lq[k])
    return [math.exp(fwd[i] + lq[k] + bwd[j] - fwd[size]) for i, j, k in lat]


def fit(samples: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation for each language from its word counts; pieces begin in
    proportion to how often the words hold them. Languages are equally likely beforehand."""
    index = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)
    languages = sorted(samples)
    prob = np.full((len(languages), len(pieces)), _FLOOR)
    for row, lang in enumerate(languages):
        arcs = [(_lattice(w, index, longest), n, len(w) + 1) for w, n in sorted(samples[lang].items())]
        p = np.full(len(pieces) + 1, 0.01)
        for lat, n, _ in arcs:
            for _, _, k in lat:
                p[k] += n
        p[-1] = 0
        for _ in range(rounds):
            q = (p / max(p.sum(), 1e-9)).tolist()
            q[-1] = _FLOOR
            count = [0.001] * (len(pieces) + 1)
            for lat, n, size in arcs:
                for (_, _, k), x in zip(lat, _expected(lat, size, q) or (), strict=False):
                    count[k] += n * x
            p = np.array(count)
            p[-1] = 0
        prob[row] = np.maximum(p[:-1] / max(p.sum(), 1e-9), _FLOOR)
    return Model(languages, pieces, prob)


def held_out(doc_id, modulus: int = 4, remainder: int = 2):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder


def learn(docs: DataFrame, vocabulary_path: str, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """Fit on at most about ``rows`` documents and ``chars`` characters of each language, drawn
    by a hash of the text from all rows outside the held-out part whose lang is not null."""
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    x = x.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    there = x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    share = there.select("lang", F.least(F.lit(1.0), F.lit(rows) / F.col("n"), F.lit(chars) / F.greatest("b", F.lit(1))).alias("share"))
    shares = {r["lang"]: r["share"] for r in share.collect()}  # a row for each language
    pick = F.lit(False)
    for lang, s in sorted(shares.items()):
        pick = pick | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 30)) < int(s * (1 << 30))))
    samples: dict[str, Counter] = {lang: Counter() for lang in shares}
    for r in x.where(pick).select("lang", "text").toLocalIterator():
        samples[r["lang"]].update(words_of(r["text"]))
    return fit(samples, vocabulary(vocabulary_path))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, lang_pred, score)``, a row for a row. Null texts
    and texts without a letter are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            got = [x for at, to in slices(texts) for x in shared.value.predict(texts[at:to])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": [x for x, _ in got], "score": [x for _, x in got]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, lang_pred string, score double")


def judge(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang, ...)``.
    A null doc_id is not held out and teaches nothing; without a labelled row all are ``und``."""
    out = identify(docs, learn(docs, vocabulary_path))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
