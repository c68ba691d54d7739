"""Operator 6: quality rules from a threshold table (DataFrame functions only).

Each measure is an expression over the text; the table of thresholds is
compiled into one projection.  No shuffle, no user function.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import SPACE, words_of

WINDOW = 5


class Rule(NamedTuple):
    """A measure and the closed range of values that pass."""
    measure: str
    low: float | None
    high: float | None


# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for as with be by on an at this are from or was which but not have "
    "der die das und in zu den mit von für ist im ein eine auf sich nicht auch dem des es sie an "
    "le la les de des et un une en du que est pour qui dans par sur au ce pas plus avec "
    "el los las y que del se por con para su al lo como más una o"
)

#: Production thresholds: lengths, symbol ratios, stop words, line ratios.
RULES = (
    Rule("n_words", 10, 1_000_000),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_word_ratio", None, 0.1),
    Rule("upper_ratio", None, 0.3),
    Rule("stop_words", 2, None),
    Rule("stop_word_ratio", 0.05, None),
    Rule("dup_line_ratio", None, 0.3),
    Rule("pipe_line_ratio", None, 0.3),
)


def _grams(words: Column) -> Column:
    """Hash and position of each window of WINDOW words, in hash order; null if there is none."""
    n = F.size(words)
    grams = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(WINDOW)]).alias("h"), i.alias("i"))))
    return F.array_sort(grams)


def _covered(grams: Column) -> Column:
    """Positions, ascending, of grams equal to a neighbour in hash order; then the words that they cover."""
    twice = F.filter(grams, lambda g, k: ((k > 0) & (F.get(grams, k - 1)["h"] == g["h"])) | (
        F.coalesce(F.get(grams, k + 1)["h"] == g["h"], F.lit(False))))
    return F.array_sort(F.transform(twice, lambda g: g["i"]))


def _cover_size(at: Column) -> Column:
    steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")


def measure(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every text, one row per row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (all long) and the ratios that RULES names (0 for a text without words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = documents.select(F.col(id_col).alias("id"), text.alias("text"), words_of(text).alias("words"),
                         F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.withColumn("grams", _grams(F.col("words")))
    d = d.withColumn("at", _covered(F.col("grams")))
    stop_words = sorted(set(STOP_WORDS.split()))
    d = d.withColumn("stops", F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(stop_words)))
    d = d.select(
        "id", "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_cover_size(F.col("at")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.contains(" | "))).alias("n_pipe_lines"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_upper"),
        F.size(F.array_distinct("stops")).alias("stop_words"),
        F.size("stops").alias("n_stop"))

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return d.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stop_words",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_word_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_stop", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_pipe_lines", "n_lines").alias("pipe_line_ratio"),
    ).withColumnRenamed("id", id_col)


def compile_rules(rules=RULES) -> Column:
    """True where every measure is inside its rule's range."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (F.col(r.measure) >= r.low)
        if r.high is not None:
            out = out & (F.col(r.measure) <= r.high)
    return out


def apply_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measures plus base_failed (under 10 words, or over 20 % of the words in repeated windows) and
    kept (false if base_failed, else whether all rules hold).

    A null, empty or wordless text has no words and is base_failed.  Very long texts
    are measured whole.  Rows are judged each for itself: repeated rows and ids,
    null ids and ties change nothing, an empty table gives an empty one, other columns
    are not looked at."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(documents, id_col, text_col).withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & compile_rules(rules))


def query(documents: DataFrame) -> DataFrame:
    return apply_rules(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT rn, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
  FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT rn, sum(least(5, coalesce(nxt, i + 5) - i))::BIGINT AS n_repeat_words
            FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM twice) GROUP BY rn),
m AS (
  SELECT d.rn, doc_id, w, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains(string_split('{" ".join(sorted(set(STOP_WORDS.split())))}', ' '), x)) AS stops,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (rn)),
f AS (
  SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 10 AND 1000000
       AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1
       AND coalesce(n_upper / nullif(word_chars, 0), 0) <= 0.3
       AND len(list_distinct(stops)) >= 2 AND len(stops) / n_words >= 0.05
       AND n_dup_lines / len(ls) <= 0.3
       AND len(list_filter(ls, lambda x: contains(x, ' | '))) / len(ls) <= 0.3 AS kept
FROM f
"""
