"""Words of a batch of texts as 64-bit hashes, by array operations over the bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest batch so far needs."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(1 << 19, 1 << (n - 1).bit_length())
            self.up, self.down = (np.ones(self.n, np.uint64) for _ in range(2))
            np.multiply.accumulate(np.full(self.n - 1, _P, np.uint64), out=self.up[1:])
            np.multiply.accumulate(np.full(self.n - 1, _INVERSE, np.uint64), out=self.down[1:])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[0x80:] = True  # bytes of letters outside ASCII
_WORD = _LETTER.copy()
_WORD[ord("0") : ord("9") + 1] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(ord("A"), ord("Z") + 1):  # lower case, in ASCII
    _VALUE[_c] = _VALUE[_c + 32]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """All words of a batch in order. ``prefix[m]`` hashes the first m bytes of a word."""

    hash: np.ndarray
    doc: np.ndarray  # the text's number in the batch
    sentence: np.ndarray  # numbers that rise through the batch; none spans two texts
    start: np.ndarray  # byte offset within the text
    size: np.ndarray  # bytes
    prefix: dict[int, np.ndarray]


def split_words(texts: list[str | None], prefixes: tuple[int, ...] = (), digits: bool = True) -> Words:
    """Runs of letters (and digits); other bytes part words. Sentences end at . ! ? or a line
    end. Null and empty texts have no words. Only A-Z is lower-cased, and every character outside
    ASCII counts as a letter: typographic signs stick to their word, and É is not é."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.array([len(x) + 1 for x in raw], np.int64)) if raw else np.zeros(0, np.int64)
    word = (_WORD if digits else _LETTER)[b]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none.view(np.uint64), none, none, none, none, {m: none.view(np.uint64) for m in prefixes})
    size = stop - start
    up, down = _POWERS.upto(len(b) + 1)
    # sums of value * base ** place from the batch's start; a word's share is a difference
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * up[:-1], out=sums[1:])
    before, scale = sums[start], down[start]
    whole = _mix((sums[stop] - before) * scale)
    heads = {m: _mix((sums[np.minimum(start + m, stop)] - before) * scale + np.uint64(m)) for m in prefixes}
    doc = np.searchsorted(ends, start, side="right")
    sentence = np.cumsum(_END[b])[start]
    base = np.concatenate([[0], ends])[doc]
    return Words(whole, doc, sentence, start - base, size, heads)
