"""Personal data and secrets by weak supervision, in DataFrame expressions only.

Candidates are found per kind (email, ip, card, phone, secret) by linear patterns. The base spans are those of the strict
patterns of the first four kinds; wider patterns add candidates: addresses spelled with "at" and "dot", addresses of eight
hexadecimal groups, dotted card numbers and digit runs of a card's length that fail the check, telephone numbers without a
country code, and long runs of mixed letters and digits, which may be secrets. Three labelers vote on each candidate: the
form (the strict pattern with its checks, or a kind's own rule), a gazetteer (top-level domains, card prefixes, address
ranges, area codes, lengths and prefixes of keys) and the words on both sides of the span. Expectation maximisation over the
counts of vote patterns, a bounded table, estimates each labeler's reliability per kind under conditional independence; the
posteriors then train a logistic span classifier on the votes and the span's shape. Candidates that the classifier accepts
are added, base spans always stay.

Patterns are matched on a copy of the text of equal length in which separators inside runs are marked, so every pattern
is a plain run of characters: Java's matcher then neither recurses nor backtracks over long digit or label runs. The
places of matches are added up in blocks, so the work is linear in their number.

Defined results: a null text is empty and has no spans; repeated rows and null ids are judged row by row; an empty table
gives no rows; other columns are ignored by :func:`find_spans` and kept by :func:`mask_text`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.llm.common import read_documents, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("strict", "gazetteer", "context")
ROUNDS = 30
ACCEPT = 0.8
BLOCK = 128
#: Private-use characters: the mark for separators, and what stands for a mark that a text has itself.
_M, _N = "\ue000", "\ue001"

# Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|io|co|info|de|fr|es|uk|eu|us"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|3[47]|6011|65"
KEY_PREFIXES = "AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xox[abp]-|eyJ"
KEY_LENGTHS = (32, 40, 56, 64, 96, 128)
CONTEXT = {
    "email": "e-?mail|contact|write to|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|ipv[46]|address|host|server|login|router|adresse",
    "card": "card|visa|credit|payment|account|mastercard|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|\bfax|contact|dial|anruf|appel|llam",
    "secret": "token|secret|passw|pwd|api|credential|auth|bearer|private|clave",
}
#: Texts without a spelled dot or a bracketed at have no spelled address.
SPELLED = r"(?i:[ )\]]dot[ (\[])|(?i:[\[(]at[\])])"
ASSIGNED = r"(?:token|secret|passw(?:or)?d|pwd|key|credential|auth|bearer)[\x22\x27\]]{0,2} ?[:=]{0,2} ?[\x22\x27]?$"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lit(text: str) -> str:
    return "r'" + text + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL array of (s, e, m) of a pattern's matches: lengths of the pieces between them give the places."""
    p = _lit(pattern)
    kind = "array<struct<s:int,e:int,m:string>>"
    step = (
        "struct(a.pos + length(p[i - 1]) + length(h[i - 1]) AS pos, "
        "concat(a.found, array(struct(a.pos + length(p[i - 1]) AS s, a.pos + length(p[i - 1]) + length(h[i - 1]) AS e, h[i - 1] AS m))) AS found)"
    )
    zero = f"struct(0 AS pos, CAST(array() AS {kind}) AS found)"
    block = f"aggregate(sequence(b * {BLOCK} + 1, least((b + 1) * {BLOCK}, size(h))), {zero}, (a, i) -> {step})"
    moved = "transform(x.found, f -> struct(f.s + a.pos AS s, f.e + a.pos AS e, f.m AS m))"
    joined = (
        f"aggregate(transform(sequence(0, (size(h) - 1) div {BLOCK}), b -> {block}), struct(0 AS pos, CAST(array() AS array<{kind}>) AS found), "
        f"(a, x) -> struct(a.pos + x.pos AS pos, concat(a.found, array({moved})) AS found), a -> flatten(a.found))"
    )
    body = f"CASE WHEN size(h) = 0 THEN CAST(array() AS {kind}) ELSE {_let(f'split({text}, {p}, -1)', 'p', joined)} END"
    return _let(f"regexp_extract_all({text}, {p}, 0)", "h", body)


def _luhn(digits: str) -> str:
    one = f"CAST(substring({digits}, length({digits}) - i, 1) AS INT)"
    twice = f"(2 * {one} - IF({one} > 4, 9, 0))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + IF(i % 2 = 0, {one}, {twice})) % 10 = 0"


def _candidates() -> Column:
    """Array of candidates (s, k, e, base, strict, gaz, ctx, form) of the column ``_t``; k is the kind's number from 0."""
    plain = f"translate(_t, '{_M}', '{_N}')"
    dots = f"regexp_replace(x, {_lit('(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])')}, '{_M}')"
    gaps = f"regexp_replace(x, {_lit('(?<=[0-9])[ -](?=[0-9])')}, '{_M}')"
    none = "CAST(array() AS array<struct<s:int,e:int,m:string>>)"
    local = f"A-Za-z0-9._%+{_M}-"
    email = _matches("y", f"(?:\\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++{_M}[A-Za-z0-9{_M}-]++")
    at, dot = r"(?: ?[\[(](?i:at)[\])] ?| (?i:at) )", r"(?: ?[\[(](?i:dot)[\])] ?| (?i:dot) )"
    spelled = _matches("x", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{at}[A-Za-z0-9-]{{1,63}}(?:(?:{dot}|[.])[A-Za-z0-9-]{{2,63}}){{1,4}}")
    ip = _matches("x", r"(?<![0-9])[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++")
    groups = _matches("x", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
    card = _matches("y", f"[0-9][0-9{_M}]++")
    dotted = _matches("x", r"(?<![0-9./])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./])")
    phone = _matches("x", r"[+][0-9][ ().0-9-]+[0-9]")
    bare = _matches("x", r"(?<![0-9+.()-])(?<![+0-9][ .-])(?:[(][0-9]{3}[)]|[1-9][0-9]{2})[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
    inland = _matches("x", r"(?<![0-9+.()-])(?<![+0-9][ .-])0[0-9]{1,5}[ /.-][0-9]{2,8}(?:[ -][0-9]{2,6}){0,3}(?![0-9.-])")
    secret = _matches("x", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+")
    digits = "regexp_replace(c.m, '[^0-9]+', '')"
    kind = "array<struct<s:int,k:int,e:int,base:boolean,strict:boolean,gaz:boolean,ctx:boolean,form:boolean>>"
    void = f"CAST(array() AS {kind})"

    def shaped(found: str, kind: str, base: str, strict: str, gaz: str, form: str) -> str:
        k = KINDS.index(kind)
        near = "lower(concat(substring(_t, greatest(c.s - 24, 0) + 1, least(c.s, 24)), ' ', substring(_t, c.e + 1, 16)))"
        own = strict if strict != base else "b"
        body = f"struct(c.s AS s, {k} AS k, c.e AS e, b AS base, {own} AS strict, {gaz} AS gaz, {near} rlike {_lit(CONTEXT[kind])} AS ctx, {form} AS form)"
        return f"transform({found}, c -> {_let(base, 'b', body)})"

    octets = r"forall(split(c.m, '[.]'), q -> length(ltrim('0', q)) < 4 AND CAST(concat('0', left(ltrim('0', q), 3)) AS INT) <= 255)"
    luhn, dotted_luhn = (_let(f"translate(c.m, '{x}', '')", "d", _luhn("d")) for x in (_M, "./"))
    lengths = f"length({digits})"
    before = "lower(substring(_t, greatest(c.s - 24, 0) + 1, least(c.s, 24)))"
    parts = [
        f"IF(instr(x, '@') = 0, {void}, {shaped(_let(dots, 'y', email), 'email', 'true', 'true', f'c.m rlike {_lit(f'{_M}(?:{DOMAINS})$')}', 'length(c.m) <= 64')})",
        shaped(
            f"IF(x rlike {_lit(SPELLED)}, {spelled}, {none})",
            "email", "false", f"c.m rlike {_lit(f'{dot}(?:{DOMAINS})$')} OR c.m rlike {_lit('[(](?i:at)[)]')} OR instr(c.m, '[') > 0", f"c.m rlike {_lit(f'(?i)(?:dot[ )\\]]*|[.])(?:{DOMAINS})$')}", "length(c.m) <= 64",
        ),
        shaped(
            f"IF(x rlike {_lit('[0-9][.][0-9]')}, {ip}, {none})",
            "ip", octets, octets, r"NOT c.m rlike '^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]'", r"NOT c.m rlike '(?:^|[.])0[0-9]'",
        ),
        shaped(
            f"IF(x rlike {_lit('[0-9A-Fa-f]:[0-9A-Fa-f:]')}, {groups}, {none})",
            "ip", "false", "(size(split(c.m, ':')) = 8 OR instr(c.m, '::') > 0) AND c.m rlike '[0-9A-Fa-f]{3}'", r"c.m rlike '^(?i:2[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):'", r"c.m rlike '[0-9A-Fa-f]{3}'",
        ),
        shaped(
            f"filter({_let(gaps, 'y', card)}, c -> length(translate(c.m, '{_M}', '')) BETWEEN 14 AND 19)",
            "card", luhn, luhn, f"c.m rlike {_lit(f'^(?:{CARD_PREFIXES})')}", f"length(translate(c.m, '{_M}', '')) IN (15, 16)",
        ),
        shaped(f"IF(x rlike {_lit('[0-9]{4}[./][0-9]{4}')}, {dotted}, {none})", "card", "false", dotted_luhn, f"c.m rlike {_lit(f'^(?:{CARD_PREFIXES})')}", "true"),
        shaped(
            f"IF(instr(x, '+') = 0, {none}, filter({phone}, c -> {lengths} BETWEEN 10 AND 15))",
            "phone", "true", "true", r"c.m rlike '^[+](?:1[ .(-]|[2-9])'", r"c.m rlike '[0-9]{3}[ .-][0-9]{4}$'",
        ),
        shaped(bare, "phone", "false", r"c.m rlike '^[(][0-9]{3}[)]'", r"c.m rlike '^[(]?[2-9]'", r"c.m rlike '[0-9]{3}-[0-9]{4}$'"),
        shaped(f"filter({inland}, c -> {lengths} BETWEEN 9 AND 14)", "phone", "false", f"{lengths} BETWEEN 10 AND 12", r"c.m rlike '^0(?:0[1-9]|[1-9])'", r"c.m rlike '[/ -]'"),
        shaped(
            f"IF(x rlike {_lit('[A-Za-z0-9_+/-]{20}')}, filter({secret}, c -> c.m rlike '[0-9]' AND c.m rlike '[A-Za-z]'), {none})",
            "secret", "false", f"{before} rlike {_lit(ASSIGNED)}",
            f"c.m rlike {_lit(f'^(?:{KEY_PREFIXES})')} OR (length(c.m) IN {KEY_LENGTHS} AND c.m rlike '^[0-9A-Fa-f]+$')", "NOT c.m rlike '[/_-]'",
        ),
    ]
    every = f"concat({', '.join(parts)})"
    return F.expr(f"IF(_t rlike {_lit('[0-9@]|' + SPELLED)}, {_let(plain, 'x', f'sort_array({every})')}, {void})")


def vote_counts(docs: DataFrame, text_col: str = "text") -> list[tuple[int, tuple[bool, ...], bool, int]]:
    """(kind, votes, form, count) of all candidates: at most 80 rows."""
    own = docs.select(text_of(text_col).alias("_t")).select(F.explode(_candidates()).alias("c"))
    rows = own.groupBy("c.k", "c.strict", "c.gaz", "c.ctx", "c.form").count().collect()
    return sorted((r["k"], (r["strict"], r["gaz"], r["ctx"]), r["form"], r["count"]) for r in rows)


def estimate(counts, rounds: int = ROUNDS) -> dict[int, tuple[float, list[tuple[float, float]]]]:
    """Per kind the prior and each labeler's (P(vote | real), P(vote | not)), by EM from trusting the strict pattern."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [(v, n) for k, v, _, n in counts if k == kind]
        prior, rates = 0.5, [(0.95, 0.05), (0.8, 0.3), (0.3, 0.05)]
        for _ in range(rounds if rows else 0):
            real, votes, total = 1.0, [[1.0, 1.0] for _ in LABELERS], 2.0
            for v, n in rows:
                p = posterior(v, prior, rates)
                real, total = real + n * p, total + n
                for j, x in enumerate(v):
                    if x:
                        votes[j][0] += n * p
                        votes[j][1] += n * (1 - p)
            prior = real / total
            rates = [(min(0.99, a / (real + 1)), min(0.95, max(0.01, b / (total - real + 1)))) for a, b in votes]
            rates[0] = (max(rates[0][0], 0.6), min(rates[0][1], 0.2))
        out[kind] = (prior, rates)
    return out


def posterior(votes, prior: float, rates) -> float:
    odds = math.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    for vote, (a, b) in zip(votes, rates, strict=True):
        odds += math.log(a / b) if vote else math.log((1 - a) / (1 - b))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))


def train_classifier(counts, model, steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> dict[int, list[float]]:
    """Logistic weights per kind over (1, strict, gazetteer, context, form), fitted to the posteriors."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [((1.0, *map(float, v), float(f)), n, posterior(v, *model[kind])) for k, v, f, n in counts if k == kind]
        total = sum(n for _, n, _ in rows) or 1
        w = [0.0] * 5
        for _ in range(steps):
            g = [l2 * x for x in w]
            for x, n, y in rows:
                p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                for j in range(5):
                    g[j] += n / total * (p - y) * x[j]
            w = [a - rate * b for a, b in zip(w, g, strict=True)]
        out[kind] = w
    return out


def fit(docs: DataFrame, text_col: str = "text") -> dict[int, list[float]]:
    """The span classifier's weights, from votes over all documents."""
    counts = vote_counts(docs, text_col)
    return train_classifier(counts, estimate(counts))


def _accepted(weights: dict[int, list[float]]) -> Column:
    """The candidates of ``_c`` that are base spans or that the classifier accepts, without repeats."""
    def score(w):
        return " + ".join([f"{w[0]:.12g}D", *[f"{x:.12g}D * CAST(c.{n} AS INT)" for x, n in zip(w[1:], ("strict", "gaz", "ctx", "form"), strict=True)]])

    cases = " ".join(f"WHEN {k} THEN {score(w)}" for k, w in sorted(weights.items()))
    edge = math.log(ACCEPT / (1 - ACCEPT))
    return F.expr(f"filter(_c, c -> c.base OR (CASE c.k {cases} END) >= {edge:.12g}D)")


def _named(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, c -> concat(element_at(array({names}), c.k + 1), ':', c.s, ':', c.e)), ',')"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, list[float]] | None = None) -> DataFrame:
    """By row: ``doc_id, n_email, n_ip, n_card, n_phone`` (base), ``base_sha256``, ``spans``; code points, end exclusive."""
    weights = fit(docs, text_col) if weights is None else weights
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).withColumn("_c", _candidates())
    own = own.withColumn("_a", _accepted(weights)).withColumn("_b", F.expr("filter(_c, c -> c.base)"))
    return own.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(_b, c -> c.k = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(F.expr(_named("_b")), 256).alias("base_sha256"),
        F.expr(_named("_a")).alias("spans"),
    )


def mask_text(docs: DataFrame, text_col: str = "text", weights: dict[int, list[float]] | None = None) -> DataFrame:
    """The documents with every span's text replaced by its kind in brackets; overlapping spans become one."""
    weights = fit(docs, text_col) if weights is None else weights
    names = docs.columns
    own = docs.select(text_of(text_col).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    own = own.withColumn("_c", _candidates()).withColumn("_a", _accepted(weights))
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    reached = f"coalesce(array_max(transform(slice(_a, 1, b * {BLOCK}), c -> c.e)), 0)"
    zero = f"struct({reached} AS at, CAST(array() AS array<string>) AS done)"
    piece = f"IF(c.s >= a.at, array(substring(_t, a.at + 1, c.s - a.at), element_at(array({kinds}), c.k + 1)), CAST(array() AS array<string>))"
    block = f"aggregate(slice(_a, b * {BLOCK} + 1, {BLOCK}), {zero}, (a, c) -> struct(greatest(a.at, c.e) AS at, concat(a.done, {piece}) AS done), a -> array_join(a.done, ''))"
    rest = "substring(_t, array_max(transform(_a, c -> c.e)) + 1, length(_t))"
    masked = f"CASE WHEN size(_a) = 0 THEN _t ELSE concat(array_join(transform(sequence(0, (size(_a) - 1) div {BLOCK}), b -> {block}), ''), {rest}) END"
    own = own.withColumn("_masked", F.expr(masked))
    return own.select(*[F.when(F.col(f"_row.`{c}`").isNull(), F.lit(None)).otherwise(F.col("_masked")).alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in names])


def op8_pii_spans(spark, sf_dir):
    return find_spans(read_documents(spark, sf_dir))
