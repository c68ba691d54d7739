"""Records of CSV files whose quoted fields hold line breaks, read by many tasks.

A reader that must know whether a line break stands inside quotes has to start
at the beginning of its file, so ``multiLine`` gives each file to one task.
Here files are read line by line in byte ranges, as any text file is, and the
quote state is carried across lines and ranges as a parallel prefix:

1. Each line is a function of the state before it (outside or inside quotes)
   to the state after it, found by two expressions over the line alone.  There are four such
   functions: keep, flip, always outside, always inside.
2. Functions compose.  Inside a range the state before a line follows from the
   last line that always gives the same state and the flips since then: running
   windows over the range's lines, once for each state that the range might start in.
3. One row per range (the state after it and its record starts for both cases) is
   scanned per file the same way and gives every range's start state, and the record
   that lines before the range's first record start belong to.
4. Lines that are records by themselves go on as they are; only the lines of the others
   are grouped by record and joined.

Step 2 works on narrow rows (no text); the text is shuffled once, by range.  A
range is at most ``spark.sql.files.maxPartitionBytes`` long, whatever the file.
Ranges are cut by Spark when a scan is planned; a scan that was cut differently from
the one before (executors came or went) is an error here, never a wrong record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Identifies a byte range of a file.
RANGE = ["file", "block", "length"]
#: Lines that one record may have; longer ones (an unclosed quote) come back line by line.
MAX_LINES = 100_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (line feeds end them, carriage returns stay) with their byte range and an order inside it."""
    return ranged(spark.read.option("lineSep", "\n").text(path))


def ranged(lines: DataFrame) -> DataFrame:
    """``lines`` of a text scan (batch or stream) with the columns file, block, length."""
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("_metadata.file_block_length").alias("length"))


def ends_inside(value: Column, delimiter: str = ",", quote: str = '"') -> tuple[Column, Column]:
    """Whether a line that starts outside, and one that starts inside quotes, ends inside quotes.

    Quotes open a field only as its first character and are doubled inside one;
    elsewhere they are plain characters.  All repetitions are possessive, so that
    long lines neither backtrack nor need stack.
    """
    q, d = re.escape(quote), re.escape(delimiter)
    body = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"  # of a quoted field, up to the quote that closes it
    fields = f"(?:(?:{q}{body}{q}[^{d}]*+|(?!{q})[^{d}]*+){d})*+"
    has_quote = F.contains(value, F.lit(quote))
    outside = F.when(has_quote, F.regexp_like(value, F.lit(f"\\A{fields}{q}{body}\\z"))).otherwise(F.lit(False))
    inside = F.when(has_quote, F.regexp_like(value, F.lit(f"\\A{body}(?:{q}[^{d}]*+{d}{fields}{q}{body})?+\\z"))).otherwise(F.lit(True))
    return outside, inside


def states_before(rows: DataFrame, group: list[str], order: list[str], outside: str, inside: str) -> DataFrame:
    """Adds ``_from_out`` and ``_from_in``: whether the state before a row is inside quotes, if its group starts outside or inside.

    ``outside`` and ``inside`` name the row's function: the state after it for either state before it.
    """
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = upto.rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col(outside) & ~F.col(inside)).cast("int")
    rows = rows.withColumn("_flips", F.sum(flip).over(upto))
    fixed = F.when(F.col(outside) == F.col(inside), F.struct(F.col(outside).cast("int").alias("state"), F.col("_flips").alias("flips")))
    rows = rows.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(prior)).withColumn(
        "_before", F.coalesce(F.last("_flips").over(prior), F.lit(0)))

    def state(start: int) -> Column:
        return F.when(F.col("_fixed").isNull(), F.col("_before") + start).otherwise(
            F.col("_fixed.state") + F.col("_before") - F.col("_fixed.flips")) % 2 == 1

    return rows.withColumns({"_from_out": state(0), "_from_in": state(1)}).drop("_flips", "_fixed", "_before")


def after(before: Column, outside: Column, inside: Column) -> Column:
    return F.when(before, inside).otherwise(outside)


def ranges(lines: DataFrame, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """One row per byte range: whether it starts inside quotes, and the last record start before it (owner)."""
    outside, inside = ends_inside(F.col("value"), delimiter, quote)
    rows = lines.select(*RANGE, F.monotonically_increasing_id().alias("pos"), outside.alias("out"), inside.alias("in"))
    rows = states_before(rows, RANGE, ["pos"], "out", "in")
    last = F.struct("pos", after(F.col("_from_out"), F.col("out"), F.col("in")).alias("out"), after(F.col("_from_in"), F.col("out"), F.col("in")).alias("in"))
    per = rows.groupBy(*RANGE).agg(F.max(last).alias("last"), F.count_if(~F.col("_from_out")).alias("starts_out"), F.count_if(~F.col("_from_in")).alias("starts_in"))
    per = per.select(*RANGE, F.col("last.out").alias("out"), F.col("last.in").alias("in"), "starts_out", "starts_in")
    per = states_before(per, ["file"], ["block"], "out", "in").withColumnRenamed("_from_out", "start")  # a file starts outside
    starts = F.when(F.col("start"), F.col("starts_in")).otherwise(F.col("starts_out"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(starts > 0, F.struct("block", starts.alias("record"))), ignorenulls=True).over(before)
    return per.select(*RANGE, "start", owner.alias("owner"))


def records(lines: DataFrame, delimiter: str = ",", quote: str = '"', header: bool = True, max_lines: int = MAX_LINES) -> DataFrame:
    """Whole records (value), without the header of each file and without blank ones.

    The lines of a record of more than ``max_lines`` come back each for itself.
    """
    outside, inside = ends_inside(F.col("value"), delimiter, quote)
    known = ranges(lines, delimiter, quote)
    rows = lines.withColumn("pos", F.monotonically_increasing_id())
    rows = rows.join(known, RANGE, "left").withColumns({"out": outside, "in": inside})
    rows = states_before(rows, RANGE, ["pos"], "out", "in")
    started = F.when(F.col("start").isNotNull(), F.col("start")).otherwise(F.raise_error(F.lit(
        "the files were cut into other ranges in the second scan: run the ingest again")).cast("boolean"))
    rows = rows.withColumn("before", F.when(started, F.col("_from_in")).otherwise(F.col("_from_out")))
    rows = rows.withColumn("number", F.count_if(~F.col("before")).over(Window.partitionBy(*RANGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("whole", ~F.col("before") & ~after(F.col("before"), F.col("out"), F.col("in")))
    rows = rows.withColumn("key", F.when(F.col("number") > 0, F.struct("block", F.col("number").alias("record"))).otherwise(F.col("owner")))
    if header:
        rows = rows.where((F.col("key.block") > 0) | (F.col("key.record") > 1))
    single = rows.where("whole").select("value")
    parts = rows.where(~F.col("whole")).select("file", "key", "block", "pos", "value")
    parts = parts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file", "key")))
    alone = F.when(F.col("n") > max_lines, F.struct("block", "pos"))
    joined = (parts.groupBy("file", "key", alone.alias("alone"))
              .agg(F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).alias("lines"))
              .select(F.array_join(F.col("lines.value"), "\n").alias("value")))
    every = single.unionByName(joined)
    return every.select(F.regexp_replace("value", "\r\\z", "").alias("value")).where(F.trim("value") != "")


def parsed(records_: DataFrame, schema: StructType, options: dict[str, str]) -> DataFrame:
    """Records as columns of ``schema``, parsed by Spark's CSV parser."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records_.select(F.from_csv("value", ddl, options).alias("row")).select("row.*")
