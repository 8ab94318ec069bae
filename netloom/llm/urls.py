"""URL filters: domain and path rules first, then gradient-boosted trees on lexical features.

Built-in functions only. The trees are grown level by level: one grouped aggregate gives the
gradient and weight sums of every node, feature and bin of the training rows, from which the
driver picks splits; a grown tree is a CASE expression, so training rows and all URLs are scored
inside generated code. Labels are the verdicts of the rules, on URLs that a rule decides; the
training rows are a bounded sample of these. Features are length, path depth, shares of digits
and of punctuation, Shannon entropy of the characters, numbers of query parameters and host
labels, and how often URLs of the same suffix (the last labels of the host) are blocked among
those the rules decide. Suffixes are counted exactly, all of them; URLs that teach take their
suffix's share from the other half of the URLs, by a hash, so that no label tells of itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import materialise

#: (verdict, rule): a rule is ``host-suffix/path-prefix``.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Labelled rows that a fit takes at most, in expectation.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 8, 3, 12, 0.4, 1.0
#: Weight, in URLs, of the overall share of blocked ones in a suffix's share.
PRIOR = 10.0
#: A suffix with over this share of all URLs gets its counts from a table of such suffixes, which its
#: share bounds; the others by a join, in which none is large.
HOT = 1 / 1024
#: Second-level labels below country domains under which names are registered.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
FEATURES = ("length", "depth", "digits", "marks", "entropy", "parameters", "labels", "suffix")


def with_parts(urls: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` to ``urls(url, ...)``. Host: after the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Both are
    empty for a null url or one without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return urls.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), upper, lower),
            "path": F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1),
        }
    )


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` (null if none fits) from ``host`` and ``path``: the longest of
    the rules whose host is the URL's or a parent of it, and with whose path the URL's begins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def suffix_of(host: str = "host") -> Column:
    """A host's last two labels, or three below a country's second-level domain."""
    last, second = F.substring_index(host, ".", -1), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    return F.when((F.length(last) == 2) & second.isin(*SECOND), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _half() -> Column:
    return F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2)).cast("int")


def with_suffix_counts(urls: DataFrame) -> tuple[DataFrame, int, float]:
    """Add ``suffix``, the numbers of URLs of the same suffix that a rule decides and of those blocked,
    [n, y] for each half of the URLs, to ``urls(url, host, rule_verdict, ...)``; and n and y of all."""
    rows = urls.withColumn("__suffix", suffix_of())
    decided, blocked = F.col("rule_verdict").isNotNull(), F.col("rule_verdict").eqNullSafe("block")
    cells = F.array(*(F.count_if((_half() == h) & what) for h in (0, 1) for what in (decided, blocked)))
    counts = materialise(rows.groupBy("__suffix").agg(F.count(F.lit(1)).alias("all"), cells.alias("suffix")), "suffixes")
    total, n, y = counts.agg(F.sum("all"), F.sum(F.col("suffix")[0] + F.col("suffix")[2]), F.sum(F.col("suffix")[1] + F.col("suffix")[3])).first()
    least = F.lit((total or 0) * HOT)
    hot = counts.where(F.col("all") > least).orderBy("__suffix").collect()  # 1 / HOT rows at most
    known = F.create_map(*(x for r in hot for x in (F.lit(r["__suffix"]), F.array(*map(F.lit, r["suffix"]))))) if hot else None
    rows = rows.withColumn("__hot", F.try_element_at(known, F.col("__suffix")) if hot else F.lit(None).cast("array<bigint>"))
    # rows of hot suffixes find nothing in the join, and are spread over it
    key = F.when(F.col("__hot").isNull(), F.col("__suffix")).otherwise(F.concat(F.lit("\n"), F.xxhash64("url").cast("string")))
    rare = counts.where(F.col("all") <= least).select(F.col("__suffix").alias("__key"), "suffix")
    out = rows.withColumn("__key", key).join(rare, "__key", "left")
    none = F.array(*[F.lit(0).cast("bigint")] * 4)
    return out.withColumn("suffix", F.coalesce("__hot", "suffix", none)).drop("__key", "__hot", "__suffix"), n or 0, float(y or 0)


def entropy(text: str) -> str:
    """SQL: Shannon entropy, in bits, of a string's characters."""
    count = f"(length({text}) - length(replace({text}, ch, '')))"
    return (
        f"if(length({text}) > 0, -aggregate(array_distinct(slice(split({text}, ''), 1, length({text}))), 0D, "
        f"(a, ch) -> a + {count} / length({text}) * log2({count} / length({text}))), 0D)"
    )


def with_features(urls: DataFrame, overall: float, teach: bool = False) -> DataFrame:
    """Add ``f_<name>`` of each feature, as doubles, from ``url``, ``host``, ``path`` and ``suffix``;
    ``overall`` is the share of blocked URLs. Rows that teach take their suffix's counts from the
    other half of the URLs."""
    url = "coalesce(url, '')"
    c = F.col("suffix")
    n, y = (F.when(_half() == 0, c[2 + k]).otherwise(c[k]) if teach else c[k] + c[2 + k] for k in (0, 1))
    rate = (y + PRIOR * overall) / (n + PRIOR)
    made = {
        "length": F.expr(f"length({url})"),
        "depth": F.expr("length(path) - length(replace(path, '/', ''))"),
        "digits": F.expr(f"length(regexp_replace({url}, '[^0-9]', '')) / greatest(length({url}), 1)"),
        "marks": F.expr(f"length(regexp_replace({url}, '[A-Za-z0-9]', '')) / greatest(length({url}), 1)"),
        "entropy": F.expr(entropy("concat(host, path)")),
        "parameters": F.expr(f"length({url}) - length(regexp_replace({url}, '[=&]', ''))"),
        "labels": F.expr("length(host) - length(replace(host, '.', '')) + 1"),
        "suffix": rate,
    }
    return urls.withColumns({f"f_{k}": F.round(v.cast("double"), 6) for k, v in made.items()})


def _leaf(tree: list | float) -> Column:
    """A tree, ``[feature, cut, low, high]`` or a value, as a column."""
    if not isinstance(tree, list):
        return F.lit(float(tree))
    feature, cut, low, high = tree
    return F.when(F.col(f"f_{feature}") <= F.lit(cut), _leaf(low)).otherwise(_leaf(high))


def _node(tree: list) -> Column:
    """The node of a growing tree that a row is in; leaves are named."""
    if tree[0] is None:
        return F.lit(tree[1])
    feature, cut, low, high = tree
    return F.when(F.col(f"f_{feature}") <= F.lit(cut), _node(low)).otherwise(_node(high))


def raw_score(trees: list, base: float) -> Column:
    total = F.lit(base)
    for t in trees:
        total = total + F.lit(RATE) * _leaf(t)
    return total


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> tuple[list, float]:
    """Boosted trees for logistic loss from ``labelled(y, f_...)``, y in 0, 1: ``(trees, base)``.

    Cuts are quantiles of the training rows. Without rows, or with one label only, there are no
    trees and the base says that label (or, without rows, allow).
    """
    n, ones = labelled.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or ones in (0, n):
        return [], (4.0 if n and ones else -4.0)
    base = math.log(ones / (n - ones))
    at = [i / bins for i in range(1, bins)]
    got = labelled.agg(*(F.expr(f"percentile(f_{f}, array({', '.join(f'{x:.6f}D' for x in at)}))").alias(f) for f in FEATURES)).first()
    cuts = {f: sorted({float(x) for x in got[f]}) for f in FEATURES}
    # every row's bin of every feature: the number of cuts below it
    binned = labelled.withColumn(
        "cells",
        F.array(*(F.struct(F.lit(f).alias("feature"), sum((F.col(f"f_{f}") > F.lit(c)).cast("int") for c in cuts[f]).alias("bin")) for f in FEATURES)),
    )
    binned = materialise(binned, "binned")
    grown: list = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-raw_score(grown, base)))
        rows = binned.withColumns({"g": F.col("y") - p, "h": p * (1 - p)})
        tree = [None, "r", 0.0]  # [None, name, value] is a leaf so far
        leaves = [tree]
        for _level in range(depth):
            sums = (
                rows.withColumn("node", _node(tree))
                .select("node", "g", "h", F.explode("cells").alias("cell"))
                .groupBy("node", "cell.feature", "cell.bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()  # nodes x features x bins
            )
            nxt = []
            for leaf in leaves:
                mine = [r for r in sums if r["node"] == leaf[1]]
                split = _best_split(mine, cuts)
                name = leaf[1]
                if split is None:
                    continue
                feature, cut, low, high = split
                left, right = [None, name + "l", low], [None, name + "h", high]
                leaf[:] = [feature, cut, left, right]
                nxt += [left, right]
            leaves = nxt
            if not leaves:
                break
        if tree[0] is None:
            break
        grown.append(_finished(tree))
    return grown, base


def _finished(tree: list):
    return tree[2] if tree[0] is None else [tree[0], tree[1], _finished(tree[2]), _finished(tree[3])]


def _best_split(sums: list, cuts: dict[str, list[float]]) -> tuple | None:
    """The cut of most gain, ties by feature and cut, with the values of its sides."""
    best, out = 1e-6, None
    for f in FEATURES:
        cells = {r["bin"]: (r["g"], r["h"]) for r in sums if r["feature"] == f}
        g_all, h_all = (math.fsum(x[i] for x in cells.values()) for i in (0, 1))
        g = h = 0.0
        for b, cut in enumerate(cuts[f]):
            x = cells.get(b, (0.0, 0.0))
            g, h = g + x[0], h + x[1]
            if h < 1e-3 or h_all - h < 1e-3:
                continue
            gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            if gain > best:
                best, out = gain, (f, cut, g / (h + RIDGE), (g_all - g) / (h_all - h + RIDGE))
    return out


def judge(pages: DataFrame, rules=RULES, rows: int = FIT_ROWS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row of ``pages(page_id, url, ...)``.

    The verdict is the rule's where one fits, else block from a score of 0.5 on. Null and odd URLs
    have an empty host and path, fit no rule, and are scored by their features like any other.
    Repeated rows and null ids are returned as they are; an empty table gives no rows; other
    columns are ignored.
    """
    judged = with_rule(with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))), rules)
    judged, n, y = with_suffix_counts(judged)
    overall = (y + 1) / (n + 2)
    known = judged.where("rule IS NOT NULL").withColumn("y", (F.col("rule_verdict") == "block").cast("double"))
    share = min(1.0, rows / max(n, 1))
    drawn = known.where(F.pmod(F.xxhash64("url", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    labelled = with_features(drawn, overall, teach=True).select("y", *(f"f_{f}" for f in FEATURES))
    trees, base = train(materialise(labelled, "labelled"))
    scored = with_features(judged, overall)
    score = 1 / (1 + F.exp(-raw_score(trees, base)))
    verdict = F.coalesce("rule_verdict", F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
