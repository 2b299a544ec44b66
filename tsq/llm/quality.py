"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a predicate that rejects a document, the base's two among them. The cost (seconds a row) and the selectivity
(share rejected) of each rule are estimated on a bounded sample, one timed pass a rule; the rules then run in order of
rejection per cost, inside one nested CASE, and each computes only the counts that it needs, so a document pays for the
rules up to the first that rejects it. The order never changes a verdict.

Repeated 3-word windows are found in one row: each window's hash and position are packed into a long, the longs
are sorted, and equal neighbours mark repeats; should two different windows share the packed hash bits, or the text
have over 2**24 words, that row is redone on the windows' own text, so the counts are exact.

Defined results: a null or empty text has no words and is rejected by the base; repeated rows and null ids are judged
row by row; an empty table gives no rows; other input columns are kept by :func:`filter_quality` and ignored by
:func:`quality_features`, whatever their names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.llm.common import WORD, read_documents, text_of

POS_BITS = 24
SAMPLE_ROWS = 1000
SAMPLE_SHARE = 16
SAMPLE_CHARS = 200_000


@dataclass(frozen=True)
class Rule:
    """``reject`` is a boolean SQL expression over the text column ``_t`` and the counts of :data:`COUNTS`."""

    name: str
    reject: str


#: The base's rules, then the others.
BASE: tuple[Rule, ...] = (Rule("short", "n_words < 50"), Rule("repeats", "100 * n_repeat_words > 50 * n_words"))
RULES: tuple[Rule, ...] = (
    Rule("symbols", "n_symbols * 10 > n_words"),
    Rule("duplicate_lines", "n_dup_lines * 2 > n_lines"),
    Rule("word_length", "word_chars * 2 < n_words * 5 OR word_chars > n_words * 14"),
    Rule("shouting", r"length(regexp_replace(_t, '[^\\p{Lu}]+', '')) * 2 > word_chars"),
    Rule("exclaiming", r"(length(_t) - length(replace(_t, '!!', ''))) * 5 > n_words * 2"),
)


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _covered(same: str) -> str:
    """Words covered by repeated windows, given the sorted windows ``p`` and the equality of neighbours j and j + 1."""
    hit = f"(j > 0 AND {same.format('j - 1', 'j')}) OR (j < size(p) - 1 AND {same.format('j', 'j + 1')})"
    return f"filter(p, (x, j) -> {hit})"


def repeat_words_sql(words: str) -> str:
    """Number of words in 3-word windows that occur twice or more among the array column ``words``."""
    mask = (1 << POS_BITS) - 1
    packed = f"sort_array(transform(sequence(0, size(w) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & {~mask}L) | i))"
    hits = _covered(f"shiftright(p[{{0}}], {POS_BITS}) = shiftright(p[{{1}}], {POS_BITS})")
    at = f"(CAST(p[{{0}}] & {mask}L AS INT) + {{1}})"
    differ = " OR ".join(f"w[{at.format('j', k)}] <> w[{at.format('j - 1', k)}]" for k in range(3))
    clash = f"exists(transform(p, (x, j) -> j > 0 AND shiftright(x, {POS_BITS}) = shiftright(p[greatest(j - 1, 0)], {POS_BITS}) AND ({differ.replace('j - 1', 'greatest(j - 1, 0)')})), x -> x)"
    count = f"size(array_distinct(flatten(transform(h, x -> sequence(x & {mask}L, (x & {mask}L) + 2)))))"
    window = "concat(w[i], ' ', w[i + 1], ' ', w[i + 2])"
    slow_p = f"sort_array(transform(sequence(0, size(w) - 3), i -> struct({window} AS s, i AS i)))"
    slow_hits = _covered("p[{0}].s = p[{1}].s")
    slow = _let(slow_p, "p", f"size(array_distinct(flatten(transform({slow_hits}, x -> sequence(x.i, x.i + 2)))))")
    fast = _let(
        packed,
        "p",
        _let(hits, "h", f"CASE WHEN size(h) = 0 THEN 0 WHEN {_let('h', 'p', clash)} THEN -1 ELSE {count} END"),
    )
    body = f"CASE WHEN size(w) < 3 THEN 0 WHEN size(w) > {mask} THEN {slow} ELSE {_let(fast, 'c', f'CASE WHEN c >= 0 THEN c ELSE {slow} END')} END"
    return f"CAST({_let(words, 'w', body)} AS BIGINT)"


_WORDS = f"regexp_extract_all(_t, r'{WORD}', 0)"
_LINES = rf"filter(split(_t, '\\n'), q -> q rlike r'{WORD}')"
#: Counts by name as SQL over ``_t``; the lines' ones stand for each other's cost.
COUNTS = {
    "n_words": f"CAST(regexp_count(_t, r'{WORD}') AS BIGINT)",
    "word_chars": r"CAST(length(regexp_replace(_t, r'[\x20\x09-\x0D]+', '')) AS BIGINT)",
    "n_symbols": "CAST(length(regexp_replace(_t, r'[^#*$%&|<>]+', '')) AS BIGINT)",
    "n_lines": f"CAST(size({_LINES}) AS BIGINT)",
    "n_dup_lines": f"CAST({_let(_LINES, 'ls', 'size(ls) - size(array_distinct(ls))')} AS BIGINT)",
    "n_repeat_words": repeat_words_sql(_WORDS),
}


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds all counts and ``base_failed`` to rows with the text column ``_t``; words and lines are split once for them."""
    shared = {
        "n_words": "CAST(size(_w) AS BIGINT)",
        "word_chars": "CAST(length(array_join(_w, '')) AS BIGINT)",
        "n_symbols": COUNTS["n_symbols"],
        "n_lines": "CAST(size(_l) AS BIGINT)",
        "n_dup_lines": "CAST(size(_l) - size(array_distinct(_l)) AS BIGINT)",
        "n_repeat_words": repeat_words_sql("_w"),
    }
    split = docs.withColumns({"_w": F.expr(_WORDS), "_l": F.expr(_LINES)})
    return split.withColumns({k: F.expr(v) for k, v in shared.items()}).withColumn("base_failed", F.expr(" OR ".join(r.reject for r in BASE))).drop("_w", "_l")


def _lazy(body: str) -> str:
    """SQL of ``body`` with its counts worked out where they stand, but for the number of words, which is bound once."""
    names = "|".join(k for k in COUNTS if k != "n_words")
    return _let(COUNTS["n_words"], "n_words", re.sub(rf"\b({names})\b", lambda m: f"({COUNTS[m[1]]})", body))


def order_rules(docs: DataFrame, rules: Sequence[Rule] = BASE + RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejection per cost, measured on at most ``sample_rows`` texts of at most ``SAMPLE_CHARS``.

    The sample holds the first texts whose hash modulo ``SAMPLE_SHARE`` is 0, read from as few partitions as hold them; only
    the order depends on it. A rule's cost is the time of a pass over the sample with it, less that of an empty pass; ties
    keep the given order.
    """
    chosen = (F.length("_t") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("_t"), F.lit(SAMPLE_SHARE)) == 0)
    taken = docs.where(chosen).select("_t").take(sample_rows)
    sample = docs.sparkSession.createDataFrame([(r["_t"],) for r in taken], "_t string").coalesce(1).persist()
    try:
        def timed(expr: str) -> tuple[float, float]:
            began = time.perf_counter()
            share = sample.agg(F.avg(F.expr(f"CAST({expr} AS INT)")).alias("r")).first()["r"] or 0.0
            return time.perf_counter() - began, share

        timed("true")
        floor = min(timed("false")[0] for _ in range(2))
        gain = {}
        for rule in rules:
            cost, share = timed(_lazy(rule.reject))
            gain[rule.name] = share / max(cost - floor, 1e-4)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(rules: Sequence[Rule]) -> str:
    """SQL of the first rule in the given order that rejects, or null; later rules are not evaluated."""
    return "CASE " + " ".join(f"WHEN {r.reject} THEN '{r.name}'" for r in rules) + " END"


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document with the base counts, ``base_failed``, ``rejected_by`` and ``kept``.

    The counts are asked for by row, so the base is judged on them and only the other rules are ordered.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    base = base_counts(own)
    rejected = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.expr(cascade(order_rules(own, rules))))
    return base.withColumn("rejected_by", rejected).withColumn("kept", F.col("rejected_by").isNull()).drop("_t")


def filter_quality(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE + RULES) -> DataFrame:
    """The documents that pass, with all their columns; no rule's counts are worked out before it is its turn."""
    names = docs.columns
    own = docs.select(text_of(text_col).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    ordered = order_rules(own.select("_t"), rules)
    return own.where(F.expr(_lazy(cascade(ordered))).isNull()).select("_row.*")


def op6_quality_rules(spark, sf_dir):
    return quality_features(read_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


FEATURES_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS _t FROM {docs}),
w AS (SELECT rid, regexp_extract_all(_t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(_t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
f AS (SELECT rid, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM w),
b AS (SELECT d.*, n_words, word_chars, n_lines, n_dup_lines,
             CAST(length(regexp_replace(_t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN f USING (rid) LEFT JOIN r USING (rid)),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
v AS (SELECT *, NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines
             OR word_chars * 2 < n_words * 5 OR word_chars > n_words * 14
             OR length(regexp_replace(_t, '[^\p{{Lu}}]+', '', 'g')) * 2 > word_chars
             OR (length(_t) - length(replace(_t, '!!', ''))) * 5 > n_words * 2) AS kept FROM q)
"""
ORACLE = (
    "WITH "
    + FEATURES_SQL.format(docs="documents")
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM v"
)
