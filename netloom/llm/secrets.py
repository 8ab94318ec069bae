"""Secret scans with built-in functions only: fixed patterns and sliding-window entropy.

Base patterns (assign, access, hex) are matched leftmost and non-overlapping per kind; their
places follow from splitting the text at the matches. The method adds spans of kind
``entropy``: candidate strings, runs of at least ``WINDOW`` characters of the base64 and URL
alphabets, get the Shannon entropy of every window of ``WINDOW`` characters. A pass over a
candidate keeps the counts c of the window's characters, a map of at most ``WINDOW`` of them, and
``sum c log2 c``; both change only by the character that comes in and the one that goes out. A
long candidate is passed over in runs of ``RUN`` windows, so that work grows with its length. Windows over the threshold of
their class (hex digits, letters with digits in one case, or both cases) are merged and widened
by a window within the candidate. Base spans, and words that hold a placeholder of the allow list,
are cut out of a candidate first; what remains is a candidate again where it is long enough. Of
these the allow list suppresses UUIDs, runs with letters or digits only, and paths and links of
words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> pattern, group whose length counts, least length. A longer least length inside the
#: pattern finds the same runs as dropping short ones does, where a run can't hold another
#: keyword; ``assign`` has to match first and drop later.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WINDOW = 20
#: Windows of a candidate that one pass takes.
RUN = 2048
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits over a window of 20 (at most 4.32): hex digits, one case with digits, mixed.
THRESHOLDS = {"hex": 3.05, "lower": 3.45, "mixed": 3.65}
#: Words, without separators, that are cut out of candidates.
PLACEHOLDER = r"(?i)[A-Za-z0-9]*(?:example|sample|dummy|placeholder|changeme|xxxxx|00000|12345678|abcdefgh)[A-Za-z0-9]*"
#: Suppressed candidates.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z/_=+-]*$",
    r"^[0-9/_=+-]*$",
)
#: Words and short numbers between separators, as in paths and links, lack all of these.
REQUIRE = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5,}"
KINDS = ("assign", "access", "hex", "entropy")


_NONE = "cast(array() as array<struct<s: bigint, e: bigint>>)"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, text: str = "text") -> str:
    """SQL: array<struct<s, e, m>> of the pattern's matches in a text: code points, end exclusive."""
    p = _lit(pattern)
    return f"""
        if(rlike({text}, {p}),
          aggregate(
            zip_with(
              slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))),
              regexp_extract_all({text}, {p}, 0), (g, m) -> struct(length(g) as gap, m as m)),
            struct(0L as at, cast(array() as array<struct<s: bigint, e: bigint, m: string>>) as out),
            (acc, x) -> struct(
              acc.at + x.gap + length(x.m) as at,
              concat(acc.out, array(struct(acc.at + x.gap as s, acc.at + x.gap + length(x.m) as e, x.m as m))) as out),
            acc -> acc.out),
          cast(array() as array<struct<s: bigint, e: bigint, m: string>>))
        """


def merged(spans: str) -> str:
    """SQL: spans of any order made disjoint and sorted; those that touch or overlap are one."""
    return f"""
      aggregate(array_sort({spans}), {_NONE},
        (a, h) -> if(size(a) > 0 and element_at(a, -1).e >= h.s,
          concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, h.e) as e))),
          concat(a, array(h))))"""


def pieces(candidate: str, cuts: str) -> str:
    """SQL: array<struct<s, e, m>>, what disjoint sorted cuts leave of a candidate struct, where it is
    at least a window long."""
    x = candidate
    return f"""
      transform(
        filter(
          zip_with(concat(array({x}.s), transform({cuts}, b -> b.e)), concat(transform({cuts}, b -> b.s), array({x}.e)), (s, e) -> struct(s as s, e as e)),
          p -> p.e - p.s >= {WINDOW}),
        p -> struct(p.s as s, p.e as e, substring({x}.m, int(p.s - {x}.s + 1), int(p.e - p.s)) as m))"""


def _c_log_c(count: str) -> str:
    return f"if({count} > 1, {count} * log2({count}), 0D)"


def entropy_windows(candidate: str, threshold: str, window: int = WINDOW, run: int = RUN) -> str:
    """SQL: (s, e) of the candidate's stretches of windows, run by run, whose entropy is at least the
    threshold, in order; stretches of neighbouring runs may touch.

    The state holds the window's counts, S = sum c log2 c of them, the stretches that are over and
    the one that goes on; the entropy is log2(window) - S / window.
    """
    w = window
    hit = lambda s: f"round(log2({w}) - ({s}) / {w}, 9) >= th"
    first = f"slice(ch, at + 1, {w})"  # the run's first window
    begin = f"aggregate({first}, cast(map() as map<string, int>), (c, x) -> map_concat(map_filter(c, (k, v) -> k <> x), map(x, coalesce(try_element_at(c, x), 0) + 1)))"
    # one character more, one less, in the counts and in S; a count of 0 goes
    come, go = f"ch[i + {w} - 1]", "ch[i - 1]"
    less = f"coalesce(try_element_at(acc.c, {come}), 0)"
    counts = f"""if({come} = {go}, acc.c,
                   map_concat(
                     map_filter(transform_values(acc.c, (k, v) -> if(k = {go}, v - 1, v)), (k, v) -> v > 0 and k <> {come}),
                     map({come}, {less} + 1)))"""
    out = f"acc.c[{go}]"
    s_next = f"""if({come} = {go}, acc.s,
                   acc.s + ({_c_log_c(f'({less} + 1)')} - {_c_log_c(less)}) - ({_c_log_c(out)} - {_c_log_c(f'({out} - 1)')}))"""
    span = f"struct(cast(i as bigint) as s, cast(i + {w} as bigint) as e)"
    start = f"""transform(array({begin}), c -> aggregate(map_values(c), 0D, (a, n) -> a + {_c_log_c('n')}))[0]"""
    step = f"""
        aggregate(
          if(hi > at, sequence(at + 1, hi), cast(array() as array<int>)),
          named_struct('c', {begin}, 's', s0, 'out', {_NONE},
                       'cur', if({hit('s0')}, named_struct('s', cast(at as bigint), 'e', cast(at + {w} as bigint)), cast(null as struct<s: bigint, e: bigint>))),
          (acc, i) -> transform(array({s_next}), s1 -> named_struct(
            'c', {counts}, 's', s1,
            'out', if({hit('s1')} and acc.cur is not null and acc.cur.e < i, concat(acc.out, array(acc.cur)), acc.out),
            'cur', if({hit('s1')}, if(acc.cur is not null and acc.cur.e >= i, named_struct('s', acc.cur.s, 'e', cast(i + {w} as bigint)), {span}), acc.cur)))[0],
          acc -> if(acc.cur is null, acc.out, concat(acc.out, array(acc.cur))))"""
    # names are bound by transforms over arrays of one: they are computed once
    return f"""
      flatten(transform(array(split({candidate}, '')), ch -> flatten(transform(array({threshold}), th ->
        flatten(transform(sequence(0, length({candidate}) - {w}, {run}), at ->
          flatten(transform(array(cast(least(length({candidate}) - {w}, at + {run} - 1) as int)), hi ->
            flatten(transform(array({start}), s0 -> {step}))))))))))
    """


def joined(spans: str) -> str:
    """SQL: spans in order, of rising ends, with those that touch or overlap made one."""
    return f"""
      flatten(transform(array({spans}), sp -> zip_with(
        filter(sp, (x, i) -> i = 0 or sp[i - 1].e < x.s),
        filter(sp, (x, i) -> i = size(sp) - 1 or sp[i + 1].s > x.e),
        (x, y) -> struct(x.s as s, y.e as e))))
    """


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` as a string (null: empty) and four columns of matches:
    ``assign, access, hex, entropy``, each array<struct<s, e>> in code points, end exclusive.

    Built-in functions only. Overlapping spans of different kinds all stay. Rows are
    independent: repeated rows give repeated results; other columns are kept as they are,
    but one of these four names is replaced.
    """
    span = "struct(x.s as s, x.e as e)"
    df = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumns({k: F.expr(_matches(p)) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))})
    df = df.withColumn(
        "assign",
        F.expr(f"transform(filter(assign, x -> length(regexp_extract(x.m, {_lit(ASSIGN)}, 2)) >= 12), x -> {span})"),
    )
    for kind in ("access", "hex"):
        df = df.withColumn(kind, F.expr(f"transform({kind}, x -> {span})"))
    allowed = " or ".join(f"rlike(x.m, {_lit(p)})" for p in ALLOW)
    df = df.withColumn("entropy", F.expr(_matches(CANDIDATE))).withColumn("__base", F.concat("assign", "access", "hex"))
    # cut base spans and placeholders out of candidates
    words = f"transform({_matches(PLACEHOLDER, 'x.m')}, t -> struct(x.s + t.s as s, x.s + t.e as e))"
    inside = "transform(filter(__base, b -> b.s < x.e and b.e > x.s), b -> struct(greatest(b.s, x.s) as s, least(b.e, x.e) as e))"
    left = f"flatten(transform(entropy, x -> flatten(transform(array({merged(f'concat({inside}, {words})')}), cuts -> {pieces('x', 'cuts')}))))"
    df = df.withColumn("entropy", F.expr(f"if(size(entropy) = 0, entropy, {left})"))
    df = df.withColumn("entropy", F.expr(f"filter(entropy, x -> rlike(x.m, {_lit(REQUIRE)}) and not ({allowed}))"))
    cls = (
        f"if(rlike(x.m, '^[0-9a-fA-F]+$'), {THRESHOLDS['hex']}D, "
        f"if(rlike(x.m, '[a-z]') and rlike(x.m, '[A-Z]'), {THRESHOLDS['mixed']}D, {THRESHOLDS['lower']}D))"
    )
    widened = f"""struct(x.s + greatest(0L, h.s - {WINDOW}) as s, x.s + least(cast(length(x.m) as bigint), h.e + {WINDOW}) as e)"""
    found = joined(f"transform({joined(entropy_windows('x.m', cls))}, h -> {widened})")
    return df.withColumn("entropy", F.expr(f"if(size(entropy) = 0, {_NONE}, flatten(transform(entropy, x -> {found})))")).drop("__base")


def _joined(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans by start, then kind as listed, comma-joined."""
    tagged = [f"transform({k}, x -> struct(x.s as s, {i} as k, x.e as e, '{k}' as name))" for i, k in enumerate(kinds)]
    return F.expr(f"array_join(transform(array_sort(concat({', '.join(tagged)})), x -> concat(x.name, ':', x.s, ':', x.e)), ',')")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs``."""
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's characters replaced by ``mask`` in ``text``, overlapping spans
    by one; texts without a secret, null ones too, stay as they are. Other columns are kept."""
    # the row itself is set aside: its columns may have the names that the spans get
    aside = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text"))
    found = find_secrets(aside)
    spans = F.expr(merged(f"concat({', '.join(KINDS)})"))
    clean = F.expr(
        f"""aggregate(__spans, struct(0L as at, '' as out),
              (a, h) -> struct(h.e as at, concat(a.out, substring(text, int(a.at + 1), int(h.s - a.at)), {_lit(mask)}) as out),
              a -> concat(a.out, substring(text, int(a.at + 1), length(text))))"""
    )
    out = found.withColumn("__spans", spans)
    text = F.when(F.size("__spans") > 0, clean).otherwise(F.col("__row.text"))
    return out.select(*(text.alias(c) if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns))


_ALLOW_SQL = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOW)


def _spans_sql(kind: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
      SELECT r, '{kind}' AS kind, i,
             length(array_to_string(g[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS s,
             ms[i] AS m
      FROM (SELECT r, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS g FROM d), unnest(range(1, len(ms) + 1)) AS u(i)"""


#: The same by brute force: every window's entropy from its counts.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans_sql('assign', ASSIGN)} UNION ALL {_spans_sql('access', ACCESS)} UNION ALL {_spans_sql('hex', HEX)}),
base AS (
  SELECT r, kind, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS k, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e
  FROM found
  WHERE kind <> 'assign' OR length(regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2)) >= 12),
raw AS (SELECT r, i, CAST(s AS BIGINT) AS s, m, CAST(s + length(m) AS BIGINT) AS e FROM ({_spans_sql('entropy', CANDIDATE)})),
words AS (
  SELECT r, i, s + length(array_to_string(g[1:k], '')) + length(array_to_string(ms[1:k - 1], '')) AS s, ms[k] AS w
  FROM (SELECT r, i, s, regexp_extract_all(m, '{PLACEHOLDER}') AS ms, string_split_regex(m, '{PLACEHOLDER}') AS g FROM raw), unnest(range(1, len(ms) + 1)) AS u(k)),
cuts AS (
  SELECT r, i, s, s AS e FROM raw
  UNION ALL SELECT r, i, s, s + length(w) FROM words
  UNION ALL SELECT c.r, c.i, greatest(b.s, c.s), least(b.e, c.e) FROM raw c JOIN base b ON b.r = c.r AND b.s < c.e AND b.e > c.s),
reach AS (SELECT r, i, max(e) OVER w AS s, lead(s) OVER w AS e FROM cuts WINDOW w AS (PARTITION BY r, i ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
left_over AS (SELECT r, i, k.s, coalesce(k.e, c.e) - k.s AS n, substr(c.m, k.s - c.s + 1, coalesce(k.e, c.e) - k.s) AS m FROM reach k JOIN raw c USING (r, i)),
cand AS (
  SELECT r, s AS i, s, m,
         CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {THRESHOLDS['hex']}
              WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN {THRESHOLDS['mixed']} ELSE {THRESHOLDS['lower']} END AS th
  FROM left_over
  WHERE n >= {WINDOW} AND regexp_matches(m, '{REQUIRE}') AND NOT ({_ALLOW_SQL})),
chars AS (
  SELECT r, i, w, substr(substr(m, w, {WINDOW}), j, 1) AS ch
  FROM cand, unnest(range(1, length(m) - {WINDOW} + 2)) AS a(w), unnest(range(1, {WINDOW} + 1)) AS b(j)),
ent AS (
  SELECT r, i, w, round(-sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)), 9) AS h
  FROM (SELECT r, i, w, ch, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL),
wide AS (
  SELECT c.r, c.i, w, c.s + greatest(0, w - 1 - {WINDOW}) AS s, c.s + least(length(m), w - 1 + 2 * {WINDOW}) AS e
  FROM ent JOIN cand c USING (r, i) WHERE h >= th),
begun AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r, i ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM wide),
runs AS (SELECT *, sum(new) OVER (PARTITION BY r, i ORDER BY w ROWS UNBOUNDED PRECEDING) AS run FROM begun),
entropy AS (SELECT r, 'entropy' AS kind, 3 AS k, min(s) AS s, max(e) AS e FROM runs GROUP BY r, i, run),
b AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS j
  FROM base GROUP BY r),
a AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS j FROM (FROM base UNION ALL FROM entropy) GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.j, '')) AS base_sha256, coalesce(a.j, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""
