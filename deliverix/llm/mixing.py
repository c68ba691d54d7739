"""Operator 5: mixing sources to target weights (Efraimidis-Spirakis sampling).

Each source gets a word budget; whole epochs of it are taken first, and what
is left of the budget is filled by the documents with the smallest
exponential keys, -ln(u) / quality weight, in key order.

Scale: a source's documents are never sorted in one task.  Keys are cut into
bins at quantiles of the source's own keys (a mergeable sketch); bin sums are
prefix-summed per source, and the bin in which the budget ends is cut again
until it holds at most ``BIN_DOCS`` documents, which are then sorted.  The result
does not depend on the bins.  Tables of one row per source are joined as Spark
sees fit by their size: a source may be a host.  Rows equal in id and text
share a key and so a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliverix.llm.shared import word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
BIN_DOCS = 2000
#: Bins that a source's keys are cut into at once.
BINS = 64


def quality_weight(text: Column) -> Column:
    """Quality weight of a text in 0.05..1: the share of its characters that are not symbols or capitals."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(t, "#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(plain.cast("double"), F.length(t).cast("double")), F.lit(0.05)))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the id, the text and the seed only (52 bits of an md5)."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"#{seed}#"), F.md5(F.coalesce(text, F.lit(""))))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2 ** 52)


def _with_source(rows: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per``, a table of one row per source."""
    r, p = rows.alias("r"), per.alias("p")
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")), how).select("r.*", *[F.col(f"p.{c}") for c in per.columns if c != "source"])


def last_bins(docs: DataFrame, plan: DataFrame, bin_docs: int = BIN_DOCS) -> DataFrame:
    """Per source with a rest of its budget: the keys (low, high] in which it ends, the words before them, and their documents."""
    docs = docs.where("size > 0")
    at = _with_source(docs, plan.where("rest > 0").select("source", "rest")).groupBy("source").agg(F.first("rest").alias("rest"), F.count(F.lit(1)).alias("n"))
    at = written(at.select("source", "rest", F.lit(-1.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("before"), "n",
                           F.lit(False).alias("done")), "mix-cut")
    while True:
        wide = at.where((F.col("n") > bin_docs) & ~F.col("done"))
        if wide.isEmpty():
            return at
        inside = _with_source(docs, wide).where((F.col("key") > F.col("low")) & (F.col("key") <= F.col("high")))
        cuts = inside.groupBy("source").agg(F.percentile_approx("key", [k / BINS for k in range(1, BINS)], 10_000).alias("cuts"))
        inside = _with_source(inside, written(cuts, "mix-quantiles"))
        inside = inside.withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("key"))))
        bins = inside.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("m"),
                                                   *[F.first(c).alias(c) for c in ("rest", "low", "high", "before", "n", "cuts")])
        up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("first", F.col("before") + F.coalesce(F.sum("words").over(up_to), F.lit(0)))
        new = bins.where((F.col("first") < F.col("rest")) & (F.col("first") + F.col("words") >= F.col("rest"))).select(
            "source", "rest", F.when(F.col("bin") > 0, F.get("cuts", F.col("bin") - 1)).otherwise(F.col("low")).alias("low"),
            F.coalesce(F.get("cuts", F.col("bin")), F.col("high")).alias("high"), F.col("first").alias("before"), F.col("m").alias("n"),
            (F.col("m") == F.col("n")).alias("done"))  # one key: no cut can divide it
        at = written(at.where((F.col("n") <= bin_docs) | F.col("done")).unionByName(new), "mix-cut")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_EPOCHS) -> DataFrame:
    """Targets by source from (source, source_size): adds target.

    Sources by code point, null last, weigh ``weights``, repeating.  They
    share ``share`` of all words; what exceeds ``cap`` times a source's size
    is dealt again by weight to the others.  Closed form of that: sources
    ordered by cap / weight are full up to the first whose part of what is
    left fits; from there on each gets its part.  One row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * float(cap)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * float(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    final = F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull().alias("z"), "source", "level"))).over(Window.partitionBy())
    return s.withColumn("first_open", final).select(
        "source", "source_size",
        F.when(F.col("first_open").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("first_open.level") * F.col("w"))).alias("target"))


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source",
        size: Column | None = None, weight: Column | None = None, weights=WEIGHTS,
        share: float = SHARE, cap: float = MAX_EPOCHS, seed: str = SEED, tag: Column | None = None,
        text: Column | None = None, bin_docs: int = BIN_DOCS) -> DataFrame:
    """How often the mix takes each document.

    Returns (id, size, source, source_size, target, epochs, picked, taken, tag):
    ``epochs`` complete passes over the source, ``picked`` if the fractional
    pass takes the document too, ``taken`` = size * (epochs + picked).  The
    fractional pass takes documents in key order while more than half of the
    document fits, so a source misses its target by half of one document at
    most.  A null source is a source, a null id counts as no digits, a null text
    has size 0, documents of size 0 are never picked; a very long text is
    one document of its size; ties of the key go by id; rows that repeat an id
    and a text have one key and are taken in one unspecified order, each counted;
    an empty table gives an empty one; other columns do not matter.  The result is
    a function of the rows alone.  ``tag`` is carried along.
    """
    text = F.col("text") if text is None else text
    size = word_count(text) if size is None else size
    weight = quality_weight(text) if weight is None else weight
    tag = F.lit(None).cast("long") if tag is None else tag
    docs = documents.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), tag.alias("tag"),
        (-F.log(uniform(F.col(id_col), text, seed)) / weight).alias("key"))
    docs = written(docs, "mix-sizes")
    sizes = written(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    targets = source_targets(sizes, weights, share, cap)
    plan = targets.select(
        "source", "source_size", "target",
        F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long").alias("epochs"),
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = written(plan, "mix-plan")
    last = last_bins(docs, plan, bin_docs).select("source", "low", "high", "before")
    plan = written(_with_source(plan, last, "left"), "mix-ends")
    docs = _with_source(docs, plan)
    on_edge = F.coalesce((F.col("size") > 0) & (F.col("key") > F.col("low")) & (F.col("key") <= F.col("high")), F.lit(False))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = docs.where(on_edge).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("picked", F.col("at") + F.col("size") / 2.0 <= F.col("rest"))
    sure = docs.where(~on_edge).withColumn("picked", F.coalesce((F.col("size") > 0) & (F.col("key") <= F.col("low")), F.lit(False)))
    both = sure.unionByName(edge.drop("at"))
    return both.select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "epochs", "picked",
        (F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))).alias("taken"), "tag")


def mixed(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``documents`` (all its columns) as often as the mix takes it.

    Rows whose id, source and text no other row has meet their decision by those;
    rows that repeat them are numbered and matched with their decisions one by one.
    """
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    choice = mix(documents, id_col, source_col, word_count(F.col(text_col)), quality_weight(F.col(text_col)), tag=tag, text=F.col(text_col), **options)
    times = (F.col("epochs") + F.col("picked").cast("long")).cast("int")
    key = ["_id", "_source", "_tag"]
    choice = written(choice.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col("tag").alias("_tag"), times.alias("_times")), "mix-times")
    same = choice.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("_times").alias("_times"))
    single, repeated = same.where("_n = 1").drop("_n"), same.where("_n > 1").select(*key)

    def on(left: list[str], right: DataFrame) -> Column:
        out = F.lit(True)
        for a, b in zip(left, key):
            out = out & F.col(a).eqNullSafe(right[b])
        return out

    mine = [id_col, source_col, "_t"]
    rows = documents.withColumn("_t", tag)
    once = rows.join(single, on(mine, single)).select(*documents.columns, "_times")
    out = once
    if not repeated.isEmpty():
        several = rows.join(repeated, on(mine, repeated), "left_semi")
        several = several.withColumn("_r", F.row_number().over(Window.partitionBy(*mine).orderBy(F.lit(1))))
        numbered = choice.join(repeated.withColumnsRenamed({k: f"{k}2" for k in key}), F.lit(True) & F.col("_id").eqNullSafe(F.col("_id2"))
                               & F.col("_source").eqNullSafe(F.col("_source2")) & (F.col("_tag") == F.col("_tag2")), "left_semi")
        numbered = numbered.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy("_times")))
        out = once.unionByName(several.join(numbered, on(mine, numbered) & (F.col("_r") == F.col("_row"))).select(*documents.columns, "_times"))
    return out.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*documents.columns)


def query(documents: DataFrame) -> DataFrame:
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         greatest(0.05, coalesce(length(translate(coalesce(text, ''), '#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))::DOUBLE
                                 / nullif(length(coalesce(text, '')), 0)::DOUBLE, 0.05)) AS weight,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#{SEED}#' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
q AS (SELECT *, source_size::DOUBLE * 2.0 AS cap, source_size::DOUBLE * 2.0 / w AS ratio,
             sum(source_size) OVER ()::DOUBLE * 1.5 AS total FROM r),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT source, source_size,
             least(cap, w * (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target FROM v),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)::DOUBLE), 0)::BIGINT AS epochs, d.source, -ln(u) / weight AS key
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k)
SELECT doc_id, size, source_size, target,
       (size * (epochs + (size > 0 AND used + size / 2.0 <= target - epochs * source_size)::INT))::BIGINT AS taken
FROM a
"""
