"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks in order: runs of text inside one innermost block element, with
character references decoded, white space collapsed, and what is never shown (scripts, styles,
comments, titles) left out. Features of a block are the tags of its ancestors, kinds of words
in their class, id and role names, and its text: length, share of link text, punctuation, place.
The field has two labels, main or not, a weight for each feature and label, and a weight for
each pair of neighbouring labels. It is trained on labelled pages by gradient ascent on the
likelihood (forward-backward), and decoded by Viterbi.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import map_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never shown as text. One that is never closed hides nothing.
HIDDEN = frozenset("noscript template svg math iframe object textarea title canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that an opening tag closes if they are the innermost block.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+>""",
    re.S | re.I,
)
_MAY_HIDE = re.compile("<(?:" + "|".join(sorted(HIDDEN)) + r")\b", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
KINDS = [
    ("menu", r"nav|menu|breadcrumb|pagination|pager|toc|skip"),
    ("advert", r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|sponsor|promo|banner"),
    ("comment", r"comment|reply|replies|disqus|discuss"),
    ("notice", r"cookie|consent|notice|popup|modal|alert|gdpr|overlay"),
    ("foot", r"foot|copyright|legal|bottom"),
    ("head", r"header|masthead|topbar|logo|site-title"),
    ("side", r"side|related|widget|share|social|recommend|trending|tags?(?:$|[\s_-])"),
    ("form", r"form|search|subscribe|newsletter|login|signup"),
    ("body", r"content|article|post|entry|main|body|story|text"),
]
_KINDS = [(k, re.compile(p, re.I)) for k, p in KINDS]
_CLOSING = re.compile(r"[.!?…:;\"'»”)]$")


class Path(NamedTuple):
    """The distinct tags of a block's ancestors, with "@kind" for their names, and the innermost tag.
    Paths that add nothing share one set, so a page's paths grow with its tags and not its depth."""

    names: frozenset[str]
    own: str


@dataclass
class Block:
    text: str
    path: Path
    linked: int  # characters inside links


def _hidden_regions(source: str) -> dict[int, int]:
    """Where each closed hidden element begins -> where it ends. An end tag closes the last open
    element of its name; self-closed and unclosed elements hide nothing."""
    if not _MAY_HIDE.search(source):
        return {}
    opened: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for m in _TOKEN.finditer(source):
        tag = (m.group(3) or "").lower()
        if tag not in HIDDEN:
            continue
        if m.group(2):
            if opened.get(tag):
                out[opened[tag].pop()] = m.end()
        elif not (tag in ("svg", "math") and m.group(4).endswith("/")):
            opened.setdefault(tag, []).append(m.start())
    return out


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page. Unclosed, crossed and stray tags do no harm: an end tag closes up to
    its innermost open tag, or nothing; text in a head whose end tag is left out is text."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []  # open blocks, with their paths
    opened: Counter[str] = Counter()
    top = Path(frozenset(), "")
    parts: list[tuple[str, bool]] = []
    links = 0
    source = page or ""
    hidden = _hidden_regions(source)

    def flush() -> None:
        if not parts:
            return
        text = " ".join(html_lib.unescape("".join(x for x, _ in parts)).split())
        if text:
            linked = sum(len(x) for x, a in parts if a)
            out.append(Block(text, stack[-1][1] if stack else top, min(linked, len(text))))
        parts.clear()

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() < at:  # inside a hidden element
            continue
        if m.start() > at:
            parts.append((source[at : m.start()], links > 0))
        at = hidden.get(m.start(), m.end())
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "head":
                flush()
            elif tag in BLOCK_TAGS and opened[tag]:
                flush()
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                links = 0
            continue
        if tag in HIDDEN or tag in ("hr", "head", "body"):
            flush()
        elif tag == "br":
            parts.append((" ", links > 0))
        elif tag == "a":
            links += 1
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
                opened[stack.pop()[0]] -= 1
            names = " ".join(x for g in _NAMES.findall(m.group(4) or "") for x in g if x)
            above = stack[-1][1].names if stack else top.names
            more = {tag, *(f"@{k}" for k, p in _KINDS if names and p.search(names))} - above
            stack.append((tag, Path(above | more if more else above, tag)))
            opened[tag] += 1
    if at < len(source):
        parts.append((source[at:], links > 0))
    flush()
    return out


def text_features(b: Block, i: int, n: int) -> list[str]:
    size, share = len(b.text), b.linked / max(len(b.text), 1)
    out = ["bias", f"size{min(9, size.bit_length())}", f"link{min(4, int(share * 5))}", f"place{4 * i // n}"]
    if _CLOSING.search(b.text):
        out.append("closed")
    if "©" in b.text or "All rights reserved" in b.text:
        out.append("copyright")
    if "," in b.text:
        out.append("comma")
    if b.text.count("|") + b.text.count("·") > 1:
        out.append("bars")
    return out


def path_features(path: Path) -> list[str]:
    return [*(f"in:{x}" for x in sorted(path.names)), f"own:{path.own}"]


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # (features, 2)
    change: np.ndarray  # (2, 2): from, to

    def __post_init__(self) -> None:
        self.paths: dict[Path, tuple[float, float]] = {}
        self.rows = {k: tuple(self.weights[i].tolist()) for k, i in self.index.items()}

    def emission(self, b: Block, i: int, n: int) -> tuple[float, float]:
        p = self.paths.get(b.path)
        if p is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            p = self.paths[b.path] = tuple(sum(x) for x in zip((0.0, 0.0), *(self.rows[f] for f in path_features(b.path) if f in self.rows), strict=False))
        x, y = p
        for f in text_features(b, i, n):
            r = self.rows.get(f)
            if r:
                x += r[0]
                y += r[1]
        return x, y

    def labels(self, page: list[Block]) -> list[int]:
        """Viterbi: the most probable labels of a page's blocks together."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.change.tolist()
        n = len(page)
        back = []
        s, t = self.emission(page[0], 0, n)
        for i in range(1, n):
            x, y = self.emission(page[i], i, n)
            from_s, from_t = (s + aa, t + ba), (s + ab, t + bb)
            back.append((from_s[1] > from_s[0], from_t[1] > from_t[0]))
            s, t = max(from_s) + x, max(from_t) + y
        now = int(t > s)
        out = [now]
        for b in reversed(back):
            now = int(b[now])
            out.append(now)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        b = blocks(page)
        return "\n".join(x.text for x, y in zip(b, self.labels(b), strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Weights of greatest regularised likelihood (Adam), from pages with a label for each block."""
    pages = [(b, y) for b, y in pages if b]
    names = [[path_features(b.path) + text_features(b, i, len(bs)) for i, b in enumerate(bs)] for bs, _ in pages]
    index = {f: i for i, f in enumerate(sorted({f for p in names for x in p for f in x}))}
    length = max(len(b) for b, _ in pages)
    x = np.zeros((len(pages), length, len(index)), np.float32)
    mask, y = np.zeros((len(pages), length), bool), np.zeros((len(pages), length), int)
    for p, (bs, ys) in enumerate(pages):
        mask[p, : len(bs)] = True
        y[p, : len(bs)] = ys
        for i, fs in enumerate(names[p]):
            x[p, i, [index[f] for f in fs]] = 1
    w, c = np.zeros((len(index), 2)), np.zeros((2, 2))
    gold = np.eye(2)[y] * mask[..., None]
    pair = mask[:, 1:]
    gold_pairs = np.einsum("pia,pib,pi->ab", gold[:, :-1], gold[:, 1:], pair)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)]
    for step in range(1, epochs + 1):
        e = (x @ w).astype(np.float64)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for i in range(1, length):
            f[:, i] = np.where(mask[:, i, None], np.logaddexp(f[:, i - 1, :1] + c[0], f[:, i - 1, 1:] + c[1]) + e[:, i], f[:, i - 1])
        for i in range(length - 2, -1, -1):
            nxt = b[:, i + 1] + e[:, i + 1]
            b[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(nxt[:, :1] + c[:, 0], nxt[:, 1:] + c[:, 1]), 0)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        node = np.exp(f + b - z[:, None, None]) * mask[..., None]
        edge = np.exp(f[:, :-1, :, None] + c + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * pair[..., None, None]
        gw = np.einsum("pif,pia->fa", x, gold - node, optimize=True) / len(pages) - l2 * w
        gc = (gold_pairs - edge.sum((0, 1))) / len(pages) - l2 * c
        for k, (g, target) in enumerate(((gw, w), (gc, c))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            target += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(index, w, c)


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Made-up pages of many layouts, with a label for each block: those of the article are
    marked in the source with a sign that is taken out again."""
    r = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sta tre vi ko an er in on es at".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3))))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def prose(long: bool = True) -> str:
        many = r.randint(1, 5) if long else 1
        return " ".join(words(2, 18).capitalize() + r.choice(".....!?") for _ in range(many))

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 3)}</a></{tag}>' for _ in range(r.randint(2, 8)))

    mark = "\x02"
    cls = lambda *names: f' {r.choice(("class", "id", "class"))}="{r.choice(names)}"'
    out = []
    for _ in range(n):
        head = r.choice([f"<nav><ul>{links()}</ul></nav>", f"<header><h2>{words(1, 3)}</h2><nav>{links('span')}</nav></header>", f"<div{cls('menu', 'navbar', 'top-nav')}><ul>{links()}</ul></div>", ""])
        before = "".join(
            r.sample(
                [f"<div{cls('ad', 'advert', 'sponsored', 'ad-slot')}>{prose(r.random() < 0.5)}</div>", f"<div{cls('cookie-notice', 'consent', 'popup')}><p>{prose(False)}</p><button>{word()}</button></div>", f"<form{cls('search', 'login')}><label>{words(1, 2)}</label><button>{word()}</button></form>", f"<div{cls('breadcrumb')}>{words(1, 4)}</div>"],
                r.randint(0, 2),
            )
        )
        body = []
        if r.random() < 0.85:
            body.append(f"<h1>{mark}{words(1, 9).capitalize()}{r.choice(('', '.'))}</h1>")
        for _ in range(r.choice((0, 1, 2, 4, 7, 11))):
            kind = r.random()
            if kind < 0.75:
                body.append(r.choice(("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><em>{}</em></p>")).format(mark + (prose() if r.random() < 0.85 else words(1, 2).capitalize() + ".")))
            elif kind < 0.82:
                level = r.randint(2, 4)
                body.append(f"<h{level}>{mark}{words(1, 6)}</h{level}>")
            elif kind < 0.88:
                body.append("<ul>" + "".join(f"<li>{mark}{words(2, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.92:
                body.append(f"<blockquote>{mark}{prose()}</blockquote>")
            elif kind < 0.95:
                body.append(f"<table><tr><td>{mark}{words(1, 3)}</td><td>{mark}{r.randint(1, 999)}</td></tr></table>")
            else:
                body.append(f"<div{cls('ad', 'advert')}>{prose(False)}</div>")
        inner = "".join(body)
        article = r.choice([f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", f"<div{cls('content', 'article-body', 'post', 'entry-content', 'story')}>{inner}</div>", f"<article>{inner}</article>"])
        after = "".join(
            r.sample(
                [f"<aside><h3>{words(1, 3)}</h3><ul>{links()}</ul><p>{prose(False)}</p></aside>", f"<div{cls('sidebar', 'related', 'widget', 'share')}><h4>{words(1, 2)}</h4>{links('p')}<p>{prose(False)}</p></div>", f"<section{cls('comments', 'comment-list', 'replies')}><h3>{words(1, 2)}</h3><div{cls('comment', 'reply')}><p>{prose()}</p></div><div{cls('comment')}><p>{prose()}</p></div></section>", f"<form{cls('newsletter', 'subscribe')}><p>{prose(False)}</p><button>{word()}</button></form>"],
                r.randint(0, 3),
            )
        )
        foot = r.choice([f"<footer>&copy; {word()}.example &middot; {prose(False)}</footer>", f"<footer><p>{prose()}</p><ul>{links()}</ul></footer>", f"<div{cls('footer', 'copyright')}>&copy; {r.randint(1999, 2030)} {words(1, 4)}</div>", ""])
        page = f"<html><head><title>{words(2, 5)}</title></head><body>{head}{before}{article}{after}{foot}</body></html>"
        made = blocks(page)
        labels = [int(mark in b.text) for b in made]
        for b in made:
            b.text = b.text.replace(mark, "")
        out.append((made, labels))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``(page_id, url, text, n_chars)``, a row for a row.

    Null and empty pages, and pages without main text, have an empty text. Null ids and urls stay
    null; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))

    def run(batches):
        for pdf in batches:
            text = [shared.value.main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    # ids as strings: a nullable integer would pass through floating point
    rows = pages.select(F.col("page_id").cast("bigint").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = map_batches(rows, run, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast("bigint"))
