"""Operator 1: line removal by site-relative frequency (DataFrame functions only).

The pages of a site are grouped, the number of pages that hold a line is
divided by the site's number of pages, and lines above a ratio go.

Scale: a page counts a line once (``array_distinct``), so counting is one
map-side-combined ``count`` per (site, line hash) whatever the site's share
of the rows.  A site has at most (mean distinct lines per page / ratio) lines
above the ratio, which bounds the array that is joined to its pages; that
array comes from a written table, so both join sides are shuffled and
adaptive execution can split a hot site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import SPACE, written

MAX_RATIO = 0.01
MIN_PAGES = 4


#: Lines of a page, and boilerplate lines of a site, up to which one is searched in the other.
FEW = 64


def host_of(url: Column) -> Column:
    """The host of an address, in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)), F.lit(""))


def _keys(lines: Column) -> Column:
    """128-bit keys of lines, trimmed; lines without a word have none."""
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, rf"^{SPACE}|{SPACE}$", ""))
    return F.transform(
        F.filter(trimmed, lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))


def _key(line: Column) -> Column:
    x = F.regexp_replace(line, rf"^{SPACE}|{SPACE}$", "")
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))


def boilerplate_lines(pages: DataFrame, site: Column, text: Column,
                      max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per site with the keys of its boilerplate lines: (site, keys)."""
    p = pages.select(site.alias("site"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    totals = p.groupBy("site").agg(F.count(F.lit(1)).alias("n_site"))
    counts = (p.select("site", F.explode(F.array_distinct(_keys(F.col("lines")))).alias("k"))
              .groupBy("site", "k.a", "k.b").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_pages))
    c, t = counts.alias("c"), totals.alias("t")
    return (c.join(t, F.col("c.site").eqNullSafe(F.col("t.site")))
            .where(F.col("n") > F.lit(max_ratio) * F.col("n_site"))
            .groupBy(F.col("c.site").alias("site"))
            .agg(F.collect_list(F.struct("a", "b")).alias("keys")))


def dedup_lines(pages: DataFrame, id_col: str = "doc_id", site: Column | None = None,
                text: Column | None = None, max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """Remove each site's boilerplate lines.

    A line is compared without white space at its ends.  It goes from every
    page of the site if at least ``min_pages`` pages of the site and more than
    ``max_ratio`` of them hold it; a page that repeats a line counts once.
    Lines without a word always stay.  Repeated rows count as pages of their
    own.  A null site is a site; a null text is an empty one (one empty line).
    Very long pages are taken whole, in time that grows with their lines; an
    empty table gives an empty one.  ``site`` may be any expression, such as the
    host of an address (:func:`host_of`).

    Returns (id, site, n_lines, n_dropped, text): lines that stay, joined by
    one newline; other columns of ``pages`` do not matter.
    """
    site = F.col("source") if site is None else site
    text = F.col("text") if text is None else text
    p = pages.select(F.col(id_col).alias("id"), site.alias("site"), F.coalesce(text, F.lit("")).alias("text"))
    found = written(boilerplate_lines(p, F.col("site"), F.col("text"), max_ratio, min_pages), "boilerplate")
    p, b = p.alias("p"), found.alias("b")
    rows = p.join(b, F.col("p.site").eqNullSafe(F.col("b.site")), "left").select(
        "id", F.col("p.site").alias("site"), "text", "keys")
    # lines are compared with a page's hits one by one, unless both are many
    many = F.coalesce(F.size("keys") > FEW, F.lit(False)) & (F.regexp_count("text", F.lit("\n")) >= FEW)
    out = _in_row(rows.where(~many))
    if not found.where(F.size("keys") > FEW).isEmpty():
        out = out.unionByName(_by_line(rows.where(many).drop("keys"), found))
    return out.withColumnRenamed("id", id_col)


def _in_row(rows: DataFrame) -> DataFrame:
    lines = F.split("text", "\n")
    rows = rows.select("id", "site", lines.alias("lines"),
                       F.when(F.col("keys").isNotNull(), F.array_intersect(_keys(lines), F.col("keys"))).alias("hits"))
    hits = F.col("hits")
    kept = F.when(hits.isNull() | (F.size(hits) == 0), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(hits, _key(x))))
    return rows.select("id", "site", F.size("lines").cast("long").alias("n_lines"), "lines", kept.alias("kept")).select(
        "id", "site", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def _by_line(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The same for pages of many lines on sites of much boilerplate: lines are rows and join the site's keys."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "long-pages")
    lines = rows.select("row", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("k", _key(F.col("line")))
    keys = found.select("site", F.explode("keys").alias("k"))
    x, y = lines.alias("x"), keys.alias("y")
    kept = x.join(y, F.col("x.site").eqNullSafe(F.col("y.site")) & (F.col("x.k") == F.col("y.k")), "left_anti")
    kept = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("kept"))  # lines of one page
    n_lines = (F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    return rows.select("row", "id", "site", n_lines.alias("n_lines")).join(kept, "row", "left").select(
        "id", "site", "n_lines", (F.col("n_lines") - F.coalesce(F.size("kept"), F.lit(0))).alias("n_dropped"),
        F.coalesce(F.array_join("kept.line", "\n"), F.lit("")).alias("text"))


def query(documents: DataFrame) -> DataFrame:
    """Digest of every document: counts and the sha256 of the text that stays."""
    return dedup_lines(documents).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (
  SELECT rn, doc_id, source, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
  FROM (SELECT rn, doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT row_number() OVER () AS rn, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
t AS (SELECT source, count(*) AS n_site FROM documents GROUP BY source),
bad AS (
  SELECT c.source, c.k FROM (SELECT source, k, count(DISTINCT rn) AS n FROM l WHERE k <> '' GROUP BY source, k) c
  JOIN t ON t.source IS NOT DISTINCT FROM c.source WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * n_site)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad ON bad.k = l.k AND bad.source IS NOT DISTINCT FROM l.source
GROUP BY rn, doc_id
"""
