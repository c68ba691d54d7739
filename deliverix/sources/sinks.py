"""Sinks -- KPI frames to CSV/Parquet, the validation report to text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_frame(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_frames(frames: dict[str, DataFrame], out_dir: str, fmt: str = "csv", parallel: int = 4) -> None:
    """Write independent frames as concurrent Spark jobs (one thread each, bounded).

    Overwrite mode makes every write idempotent, so a retried write after a
    failure leaves the same files.
    """
    if parallel <= 1:
        for name, df in frames.items():
            write_frame(df, f"{out_dir}/{name}", fmt)
        return
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        futures = [pool.submit(write_frame, df, f"{out_dir}/{name}", fmt) for name, df in frames.items()]
        for f in futures:
            f.result()


def _table_lines(part: int, title: str, table: DataFrame, columns: list[str], order: list) -> DataFrame:
    """A small table (one row per status or score) as text lines: blank, title, header, right-aligned rows."""
    text = [F.col(c).cast("string") for c in columns]
    if "pct" in columns:
        text[columns.index("pct")] = F.format_number("pct", 2)
    rows = table.select(F.row_number().over(Window.orderBy(*order)).alias("pos"),
                        *[t.alias(c) for t, c in zip(text, columns)])
    wide = [F.greatest(F.lit(len(c)), F.max(F.length(c)).over(Window.partitionBy())) for c in columns]
    rows = rows.select("pos", *[F.struct(F.col(c).alias("text"), w.alias("wide")).alias(c) for c, w in zip(columns, wide)])

    def line(values: list[F.Column]) -> F.Column:
        return F.concat_ws(" ", *[F.lpad(F.coalesce(v, F.lit("")), F.col(f"{c}.wide"), F.lit(" "))
                                  for v, c in zip(values, columns)])

    body = rows.select((F.col("pos") + 2).alias("pos"), line([F.col(f"{c}.text") for c in columns]).alias("value"))
    header = rows.where("pos = 1").select(F.lit(2).alias("pos"), line([F.lit(c) for c in columns]).alias("value"))
    top = table.sparkSession.createDataFrame([(0, ""), (1, title)], "pos int, value string")
    return top.unionByName(header).unionByName(body).select(F.lit(part).alias("part"), "pos", "value")


def validation_report(validation: DataFrame, statuses: DataFrame, reviews: DataFrame) -> DataFrame:
    """The text report as lines (part, pos, value): checks, status and review score distribution."""
    def number(name: str) -> F.Column:
        return F.max(F.when(F.col("check") == name, F.col("value_num")))

    def text(name: str) -> F.Column:
        return F.max(F.when(F.col("check") == name, F.col("value_text")))

    def whole(name: str) -> F.Column:
        return number(name).cast("bigint").cast("string")

    # The wording of the reference's report.
    lines = [
        [F.lit("Null order IDs: "), whole("null_order_ids")],
        [F.lit("Order date coverage: "), text("date_coverage_min"), F.lit(" to "), text("date_coverage_max")],
        [F.lit("Items without order record: "), whole("items_without_order")],
        [F.lit("orders_clean rows: "), F.format_number(number("orders_clean_rows"), 0)],
        [F.lit("orders_clean date range: "), text("orders_clean_date_min"), F.lit(" to "), text("orders_clean_date_max")],
        [F.lit("orders_clean retained: "), number("orders_clean_retention_pct").cast("string"), F.lit("% of original orders")],
    ]
    parts = F.array(*[F.concat(*[F.coalesce(p, F.lit("None")) for p in line]) for line in lines])
    checks = validation.agg(parts.alias("lines")).select(F.posexplode("lines").alias("pos", "value"))
    checks = checks.select(F.lit(0).alias("part"), "pos", "value")
    status = _table_lines(1, "Order status distribution:", statuses, ["order_status", "cnt", "pct"],
                          [F.desc("cnt"), F.col("order_status")])
    scores = _table_lines(2, "Review score distribution:", reviews, ["review_score", "cnt"], [F.col("review_score")])
    return checks.unionByName(status).unionByName(scores)


def write_report(report: DataFrame, out_dir: str, name: str = "schema_validation") -> None:
    """Write the lines (a few dozen) of :func:`validation_report` in order, as one text file."""
    (report.repartition(1).sortWithinPartitions("part", "pos").select("value")
     .write.mode("overwrite").text(f"{out_dir}/{name}"))


def read_back_counts(spark: SparkSession, out_dir: str, names: list[str], fmt: str = "csv",
                     text_reports: tuple[str, ...] = ()) -> DataFrame:
    """Manifest of what was written: (table_name, rows) read back from storage."""
    parts = []
    for name in names:
        reader = spark.read.option("header", True).csv if fmt == "csv" else spark.read.format(fmt).load
        parts.append(reader(f"{out_dir}/{name}").agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(name).alias("table_name"), "rows"))
    for name in text_reports:
        parts.append(spark.read.text(f"{out_dir}/{name}").agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(name).alias("table_name"), "rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_exported(spark: SparkSession, out_dir: str, name: str, schema, fmt: str = "csv") -> DataFrame:
    """Read an exported frame back with its schema (timestamps parsed, no
    inference pass) -- how the report views load the exported files."""
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True)
                .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSS]")
                .option("mode", "FAILFAST").csv(f"{out_dir}/{name}"))
    return spark.read.schema(schema).format(fmt).load(f"{out_dir}/{name}")
