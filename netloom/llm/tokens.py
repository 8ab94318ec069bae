"""Token ids of the lower-casing word BPE, a word at a time.

The tokenizer normalises (NFC, runs of white space to one space, lower case), takes the
pieces that its pattern matches, none of which holds white space, and merges the characters
of each piece, the last of which carries an end mark. So the ids of a text are those of its
white-space separated words in a row, and a word's ids are computed once per worker. New
words go to a byte-level merge table of the same vocabulary in which the end mark is a
control character; texts and words for which the two could differ go to the tokenizer itself, so
do texts that hold the name of a special token, which the tokenizer gives that token's id.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import regex

_MARK = "\x01"
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space to Python's split() but not to the pattern, the mark, and letters whose lower
#: case depends on their place or takes several characters.
_ODD = regex.compile("[\x00-\x08\x0e-\x1fİΣ]")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    extra = (b for b in range(256) if b not in set(plain))
    out.update({chr(256 + i): b for i, b in enumerate(extra)})
    return out


class IdEncoder:
    """``packed(text)``: the ids of a text as little-endian unsigned 16-bit numbers."""

    _held: dict[str, IdEncoder] = {}
    #: Words whose ids a worker keeps; beyond that it starts anew.
    WORDS = 250_000

    @classmethod
    def shared(cls, path: str) -> IdEncoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path = path
        self._exact = None
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab = whole["model"]["vocab"]
        names = {t["content"] for t in whole.get("added_tokens", [])}
        self.special = sorted(names)
        letters = _byte_letters()
        ranks = {bytes([b]): b for b in range(256)}
        ids = np.zeros(len(vocab) + 257, np.uint16)
        for token, i in sorted(vocab.items(), key=lambda x: x[1]):
            if token in names:
                continue
            word, mark = (token[:-4], b"\x01") if token.endswith("</w>") else (token, b"")
            key = bytes(letters[c] for c in word) + mark
            rank = ranks.setdefault(key, len(ranks))
            ids[rank] = i
        self.ids = ids
        self.last = np.zeros(len(ids), bool)  # ranks that end a piece
        self.last[[r for k, r in ranks.items() if k.endswith(b"\x01")]] = True
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    @property
    def exact(self):
        """The tokenizer itself; most workers never need it."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact

    def _exactly(self, text: str) -> bytes:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Add new words to the cache: one call for all of them."""
        cache = self.cache
        counts, flat = [], []
        for w in words:
            if len(w) > 2000:  # merging a piece takes time with the square of its length
                cache[w] = self._exactly(w)
                counts.append(0)
                continue
            pieces = [w] if w.isalpha() else _PIECES.findall(w)
            counts.append(len(pieces))
            flat += pieces
        ranks = np.array(self.merge.encode_ordinary(_MARK.join(flat) + _MARK) if flat else [], np.int64)
        ids = self.ids[ranks].astype("<u2").tobytes()
        ends = np.append(0, 2 * (np.flatnonzero(self.last[ranks]) + 1)).tolist()
        at = 0
        for w, n in zip(words, counts, strict=True):
            if n or w not in cache:
                cache[w] = ids[ends[at] : ends[at + n]]
                at += n

    def packed(self, text: str) -> bytes:
        if _ODD.search(text) or any(x in text for x in self.special):
            return self._exactly(text)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        words = text.lower().split()
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) > self.WORDS:
            cache.clear()
        self._learn([w for w in dict.fromkeys(words) if w not in cache])
        return b"".join([cache[w] for w in words])
