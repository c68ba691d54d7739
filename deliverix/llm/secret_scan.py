"""Operator 12: secret scan by a trigram inverted index (DataFrame functions only).

* Each rule is a regular expression.  From it a Boolean query of trigrams is
  derived (``trigram_query``): an OR of ANDs that every match satisfies.
* The index holds, for each trigram that a query asks for, the texts that hold
  it (``postings``).  A rule's postings are intersected per text; the texts that
  satisfy its query are its candidates.
* Candidates are fetched and verified by the expression itself; rules without a
  mandatory trigram (a run of hexadecimal digits) scan all texts.
* Pieces between matches and matches are laid one after another; running sums
  of their lengths are the places of the spans, in code points.

Scale: postings are rows (trigram, text's key), written as a table and combined
per text, so that a trigram which a third of all texts hold is no group; texts
are joined with candidates by key, and Spark broadcasts those only when their
measured size allows.  Spans of one text meet in one task, as its matches do.

Null and empty texts have no spans.  Very long texts are scanned whole, in time
linear in their length and matches.  Null and repeated ids: texts are told
apart by id and 128 bits of hash, equal rows are scanned as one and all get its
spans.  An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliverix.llm.shared import NULL_ID, id_key, written


class Rule(NamedTuple):
    """Kind of secret, its expression, the group that is measured and its least length.

    Matches are leftmost and do not overlap; one whose group is too short is
    dropped, after it took its place.  Expressions stay within what Python,
    Java and RE2 read alike: classes of ASCII, no look-around, no back reference.
    """
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The three base kinds.
BASE = (
    Rule("assign", "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),  # a whole run: that of 20 characters or more in all
    Rule("hex", "[0-9a-f]{24,}"),
)
# Published shapes of keys and tokens, and credentials inside addresses.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("address", r"://[A-Za-z0-9._~%+-]+:([^\x00-\x20/@]+)@", 1, 3),
)
RULES = BASE + MORE

#: Strings that an expression is expanded to before it counts as unknown.
EXPANDED = 64
#: Trigrams per 64-bit word of a text's set.
BITS = 62

# A query is a set of clauses, each a set of trigrams that occur together; the empty clause holds for every text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _or(*queries: Query) -> Query:
    clauses = frozenset().union(*queries)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _and(*queries: Query) -> Query:
    return _or(frozenset(frozenset().union(*c) for c in product(*queries)))


def _of_strings(strings: set[str]) -> Query:
    return _or(*(frozenset([frozenset(s[i:i + 3] for i in range(len(s) - 2))]) for s in strings))


def _strings(node: tuple) -> set[str] | None:
    """All strings that a node of an expression matches, in lower case; None if they are many."""
    op, value = node
    if op is C.LITERAL:
        return {chr(value).lower()}
    if op is C.IN and value[0][0] is not C.NEGATE:
        out: set[str] = set()
        for kind, v in value:
            if kind is C.LITERAL:
                out.add(chr(v).lower())
            elif kind is C.RANGE and v[1] - v[0] < EXPANDED:
                out.update(chr(x).lower() for x in range(v[0], v[1] + 1))
            else:
                return None
        return out if len(out) <= EXPANDED // 4 else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] == 1:
        inner = _sequence(value[2])[0]
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    if op is C.SUBPATTERN:
        return _sequence(value[-1])[0]
    if op is C.BRANCH:
        parts = [_sequence(p)[0] for p in value[1]]
        return None if None in parts else set().union(*parts)
    return None


def _query(node: tuple) -> Query:
    """What every match of a node whose strings are many must hold."""
    op, value = node
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
        return _sequence(value[2])[1]
    if op is C.SUBPATTERN:
        return _sequence(value[-1])[1]
    if op is C.BRANCH:
        return _or(*(_sequence(p)[1] for p in value[1]))
    return ANY


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """The strings of a sequence of nodes, if few, and its query."""
    known, query, whole = {""}, ANY, True
    for node in nodes:
        strings = _strings(node)
        if strings is not None and len(known) * len(strings) <= EXPANDED:
            known = {a + b for a in known for b in strings}
            continue
        query = _and(query, _of_strings(known))
        whole = False
        known = strings if strings is not None else {""}
        if strings is None:
            query = _and(query, _query(node))
    return (known if whole else None), _and(query, _of_strings(known))


def trigram_query(pattern: str) -> Query:
    """Clauses of lower-case trigrams, one of which is in every text that the expression matches."""
    return _sequence(_parser.parse(pattern))[1]


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(id_key(F.col(id_col)).alias("doc"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("th2"), text.alias("text"))


KEY = ["doc", "th", "th2"]


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram's number, doc, th, th2) for every text that holds the trigram in either case."""
    low = texts.select(*KEY, F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams))))
    # outer: for a plain explode Spark adds a filter on the array, which pushes all of its terms below the lower-casing
    return low.select(*KEY, held.alias("held")).select(F.explode_outer("held").alias("trigram"), *KEY).where(F.col("trigram").isNotNull())


def candidates(index: DataFrame, trigrams: list[str], queries: dict[int, Query]) -> DataFrame:
    """(doc, th, th2, rules): the texts that satisfy the queries of rules, and the rules' numbers."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % BITS)
    words = range(0, len(trigrams), BITS)
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / BITS) == w // BITS, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w // BITS}") for w in words]
    number = {t: k for k, t in enumerate(trigrams)}

    def holds(clause: frozenset[str]) -> Column:
        want = [0] * len(words)
        for t in clause:
            want[number[t] // BITS] |= 1 << (number[t] % BITS)
        out = F.lit(True)
        for w, bits in enumerate(want):
            if bits:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(bits)) == F.lit(bits))
        return out

    def satisfied(query: Query) -> Column:
        out = F.lit(False)
        for clause in sorted(query, key=sorted):
            out = out | holds(clause)
        return out

    asked = F.array_compact(F.array(*(F.when(satisfied(q), F.lit(r)) for r, q in queries.items())))
    return index.groupBy(*KEY).agg(*masks).select(*KEY, asked.alias("rules")).where(F.size("rules") > 0)


def _laid_out(number: int, rule: Rule, text: Column) -> Column:
    """Of one text's matches, in order: (rule, gap before the match, its length, length of the measured group)."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    out = F.zip_with(F.split(text, rule.pattern, -1), found, lambda gap, x: F.struct(
        F.lit(number).alias("rule"), F.length(gap).alias("gap"), F.length(x).alias("length"), F.length(x).alias("measured")))
    if rule.group:
        out = F.zip_with(out, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda z, y: F.struct(
            z["rule"].alias("rule"), z["gap"].alias("gap"), z["length"].alias("length"), F.length(y).alias("measured")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), out).otherwise(
        F.array().cast("array<struct<rule:int,gap:int,length:int,measured:int>>"))


def _found(texts: DataFrame, rules: dict[int, Rule], asked: Column | None) -> DataFrame:
    """All matches of the rules in the texts, a row each; ``asked``: numbers of the rules to verify in a row."""
    text = F.col("text")
    parts = []
    for k, rule in rules.items():
        part = _laid_out(k, rule, text)
        parts.append(part if asked is None else F.when(F.array_contains(asked, F.lit(k)), part).otherwise(
            F.array().cast("array<struct<rule:int,gap:int,length:int,measured:int>>")))
    return (texts.select(*KEY, F.posexplode(F.concat(*parts)).alias("pos", "m")).select(*KEY, "pos", "m.*")
            .where(F.col("length").isNotNull()))  # the piece after the last match has none


def find_spans(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, th2, spans) of the texts with secrets; spans: structs (start, rule's number, kind, end) by start, then rule."""
    texts = _keyed(documents, id_col, text_col)
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    found = []
    if indexed:
        trigrams = sorted({t for q in indexed.values() for c in q for t in c})
        asked = written(candidates(written(postings(texts, trigrams), "postings"), trigrams, indexed), "candidates")
        found.append(_found(texts.join(asked, KEY), {k: rules[k] for k in indexed}, F.col("rules")))
    if len(indexed) < len(rules):
        found.append(_found(texts, {k: r for k, r in enumerate(rules) if k not in indexed}, None))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    every = every.groupBy(*KEY, "rule", "pos").agg(*(F.any_value(c).alias(c) for c in ("gap", "length", "measured")))  # equal rows once
    laid = Window.partitionBy(*KEY, "rule").orderBy("pos")
    every = every.withColumn("end", F.sum((F.col("gap") + F.col("length")).cast("long")).over(laid))
    least = F.array(*(F.lit(r.least) for r in rules))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    kept = every.where(F.col("measured") >= F.get(least, F.col("rule")))
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "rule", F.get(kinds, F.col("rule")).alias("kind"), "end")
    return kept.groupBy(*KEY).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: id and spans, an array of structs (start, rule, kind, end); code points, end exclusive."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = _keyed(documents, id_col, text_col).select(*KEY)
    out = rows.join(find_spans(documents, rules, id_col, text_col), KEY, "left")
    return out.select(F.nullif("doc", F.lit(NULL_ID)).cast(kind).alias(id_col), F.coalesce(
        "spans", F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint>>")).alias("spans"))


def query(documents: DataFrame) -> DataFrame:
    spans = F.col("spans")
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["rule"] < len(BASE))

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rule"] == k)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return secrets(documents).select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
                                     F.array_join(F.transform(spans, label), ",").alias("spans"))


def _sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT rid, {k} AS rule, '{r.kind}' AS kind, sum(length(z) + length(x)) OVER (PARTITION BY rid ORDER BY i) AS e, length(x) AS n, length(y) AS measured, {r.least} AS least
  FROM (SELECT rid, unnest(range(len(m))) AS i, unnest(m) AS x, unnest(g) AS y, unnest(p[1:len(m)]) AS z FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, regexp_split_to_array(t, '{pattern}') AS p
    FROM d WHERE regexp_matches(t, '{pattern}')))""")
    counts = ", ".join(f"count(*) FILTER (WHERE rule = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT rid, rule, e - n AS s, kind || ':' || CAST(CAST(e - n AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS label FROM found WHERE measured >= least),
per AS (SELECT rid, {counts}, string_agg(label, ',' ORDER BY s, rule) FILTER (WHERE rule < {len(BASE)}) AS base, string_agg(label, ',' ORDER BY s, rule) AS spans
        FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""


SQL = _sql()
