"""Raw CSV exports -> typed Parquet tables, bad rows quarantined.

The reference loads with automatic detection and silently drops rows that do
not parse.  Here a bounded sample gives the dialect and the header
(:mod:`csv_sniff`), which are held against the table's fixed schema; rows are
parsed in PERMISSIVE mode with a corrupt-record column and written once, good
and bad ones apart by a partition column, while an observation counts them.
Files whose quoted fields hold line breaks are read by many tasks
(:mod:`csv_records`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from deliverix.sources.csv_records import parsed, read_lines, records
from deliverix.sources.csv_sniff import Sample, SchemaDifference, compare, file_schema, sniff
from deliverix.sources.schemas import RAW_FILES
from deliverix.sources.tables import MarketTables

CORRUPT = "_corrupt_record"
#: Partition column of an ingested table: good, bad, or hot (good lines of an order too large for one bucket).
STATE = "ingest_state"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists (file or folder); resolving a reader lists the
    path without running a job and fails with PATH_NOT_FOUND otherwise."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException:
        return False


def resolve_inputs(spark: SparkSession, data_dir: str, files: dict | None = None) -> dict[str, str]:
    """Path of every input; raises listing all missing tables (completeness check)."""
    files = files or RAW_FILES
    found, missing = {}, []
    for table, (names, _schema) in files.items():
        names = (names,) if isinstance(names, str) else names
        for name in names:
            path = f"{data_dir.rstrip('/')}/{name}"
            if path_exists(spark, path):
                found[table] = path
                break
        else:
            missing.append(f"{table} ({' | '.join(names)})")
    if missing:
        raise FileNotFoundError("missing input files: " + ", ".join(missing))
    return found


def with_corrupt(schema: StructType) -> StructType:
    return StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])


def parse_options(delimiter: str = ",", quote: str = '"') -> dict[str, str]:
    return {"sep": delimiter, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
            "timestampNTZFormat": TIMESTAMP_FORMAT}


def read_csv_permissive(spark: SparkSession, path: str, schema: StructType, multiline: bool = False, sample: Sample | None = None) -> DataFrame:
    """All rows of the files at ``path`` with the columns of ``schema`` and the corrupt-record column.

    With a ``sample`` its dialect and the order of its header hold.  ``multiline``:
    quoted fields may hold line breaks (kept as they are in the file).
    """
    own = schema if sample is None else file_schema(sample, schema)
    options = parse_options() if sample is None else parse_options(sample.delimiter, sample.quote)
    if multiline:
        rows = parsed(records(read_lines(spark, path), options["sep"], options["quote"]), with_corrupt(own), options | {"multiLine": "true"})
    else:
        rows = spark.read.schema(with_corrupt(own)).options(**options).option("header", True).csv(path)
    return rows if own is schema else rows.select(*schema.names, CORRUPT)


@dataclass(frozen=True)
class IngestResult:
    tables: dict[str, DataFrame]
    counts: DataFrame  # table_name, good_rows, bad_rows
    hot_items: DataFrame | None = None  # lines of hot orders, as files to be split anywhere
    bucketed_items: DataFrame | None = None  # the other lines, by bucket


# tables keyed by order: written bucketed by order_id when bucketing is asked for
ORDER_KEYED = ("orders", "items", "reviews")


def detect(spark: SparkSession, path: str, schema: StructType) -> Sample | None:
    """The sample of ``path``; raises if columns of ``schema`` are renamed, missing or of another type in it.

    Other orders and more columns are no error: the header's order is read.
    """
    sample = sniff(spark, path)
    wrong = [] if sample is None else [d for d in compare(sample, schema) if d.kind not in ("reordered", "extra")]
    if wrong:
        raise SchemaDifference(path, wrong)
    return sample


def hot_keys(rows: DataFrame, key: str, buckets: int, most: int = 10_000) -> list[str]:
    """Keys with more rows than an average bucket has (fewer than ``buckets`` of them, and no more than ``most``).

    One pass with a sketch of the most frequent keys, which tasks merge; its counts
    are off by a small share of a bucket at most.  Only ``key`` is parsed.
    """
    k = min(buckets, most)
    kept = min(1_000_000, 16 * max(buckets, 64))
    row = rows.where(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k", F.col(key), F.lit(k), F.lit(kept)).alias("top")).first()
    return [t.item for t in row.top if t["count"] * buckets > row.n]


def _ingest_one(spark: SparkSession, table: str, path: str, schema: StructType, out_dir: str,
                multiline: bool, buckets: int | None = None, table_prefix: str = "deliverix") -> tuple[DataFrame, int, int, tuple | None]:
    """The good rows of the written table, the numbers of good and bad rows, and its (hot, bucketed) parts if it has hot keys."""
    rows = read_csv_permissive(spark, path, schema, multiline, detect(spark, path, schema))
    bucketed = buckets and table in ORDER_KEYED
    hot = hot_keys(rows, "order_id", buckets) if bucketed and table == "items" else []
    good = F.col(CORRUPT).isNull()
    counted = Observation(f"ingest {table}")
    rows = rows.withColumn(STATE, F.when(~good, "bad").when(F.col("order_id").isin(hot), "hot").otherwise("good") if hot
                           else F.when(good, "good").otherwise("bad"))
    rows = rows.observe(counted, F.count_if(good).alias("good_rows"), F.count_if(~good).alias("bad_rows"))
    target = f"{out_dir}/{table}"
    if bucketed:
        # co-located by order: later joins on order_id between these tables
        # read matching buckets instead of shuffling the line table
        (rows.write.mode("overwrite").partitionBy(STATE).bucketBy(buckets, "order_id").sortBy("order_id")
         .option("path", target).saveAsTable(f"{table_prefix}_{table}"))
        written = spark.table(f"{table_prefix}_{table}")
    else:
        rows.write.mode("overwrite").partitionBy(STATE).parquet(target)
        written = spark.read.schema(rows.schema).parquet(target)
    (written.where(F.col(STATE) == "bad").drop(STATE)  # reads the partition of bad rows only
     .write.mode("overwrite").parquet(f"{out_dir}/_quarantine/{table}"))
    counts = counted.get
    every, parts = good_rows(written), None
    if hot:
        # read as plain files, not by bucket: one bucket of them would be one task
        apart = spark.read.schema(rows.schema).parquet(target).where(F.col(STATE) == "hot").drop(STATE, CORRUPT)
        rest = written.where(F.col(STATE) == "good").drop(STATE, CORRUPT)
        every, parts = rest.unionByName(apart), (apart, rest)
    return every, counts["good_rows"], counts["bad_rows"], parts


def good_rows(written: DataFrame) -> DataFrame:
    """The rows of an ingested table that parsed, without the columns of the ingest."""
    return written.where(F.col(STATE) != "bad").drop(STATE, CORRUPT)


def ingest_csv(spark: SparkSession, data_dir: str, out_dir: str, files: dict | None = None,
               multiline_tables: tuple[str, ...] = ("reviews",), parallel: int = 4,
               order_buckets: int | None = None, table_prefix: str = "deliverix") -> IngestResult:
    """Parse and write every raw CSV once to ``out_dir/<table>``, good and bad rows in partitions
    of their own (bad ones also in ``out_dir/_quarantine/<table>``); return the good rows as tables
    and the counts per table.

    Tables are independent, so up to ``parallel`` of them are ingested as
    concurrent Spark jobs; overwrite mode keeps every step idempotent.  With
    ``order_buckets``, orders, items and reviews are saved as catalog tables
    bucketed (and sorted) by order_id, so the order-line join is co-located.
    Lines of orders that are larger than an average bucket go to a partition of
    their own, which joins take apart from the buckets.
    """
    from concurrent.futures import ThreadPoolExecutor
    files = files or RAW_FILES
    paths = resolve_inputs(spark, data_dir, files)
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        futures = {table: pool.submit(_ingest_one, spark, table, path, files[table][1], out_dir,
                                      table in multiline_tables, order_buckets, table_prefix)
                   for table, path in paths.items()}
        done = {table: f.result() for table, f in futures.items()}
    counts = spark.createDataFrame([(table, good, bad) for table, (_, good, bad, _) in done.items()], "table_name string, good_rows long, bad_rows long")
    hot, bucketed = (done["items"][3] if "items" in done else None) or (None, None)
    return IngestResult(tables={table: d[0] for table, d in done.items()}, counts=counts, hot_items=hot, bucketed_items=bucketed)


def market_tables(result: IngestResult) -> MarketTables:
    t = result.tables
    return MarketTables(orders=t["orders"], customers=t["customers"], items=t["items"],
                        products=t["products"], translations=t["translations"], sellers=t["sellers"],
                        reviews=t["reviews"], geo=t.get("geo"), hot_items=result.hot_items, bucketed_items=result.bucketed_items,
                        regions=t["customers"].select(F.col("customer_state").alias("region_code")).distinct())


def export_raw_csv(tables: MarketTables, geo: DataFrame | None, out_dir: str, files: dict | None = None) -> dict[str, str]:
    """Write canonical tables as raw exports: every column of the raw schema in
    order (absent ones empty), values as text, one folder per file name."""
    from concurrent.futures import ThreadPoolExecutor
    files = files or RAW_FILES
    frames = tables.as_dict() | ({} if geo is None else {"geo": geo})

    def write(table: str) -> str:
        names, schema = files[table]
        names = (names,) if isinstance(names, str) else names
        df = frames[table]
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast("string").alias(f.name)
                for f in schema.fields]
        path = f"{out_dir.rstrip('/')}/{names[0]}"
        (df.select(*cols).write.mode("overwrite").option("header", True)
         .option("timestampFormat", TIMESTAMP_FORMAT).csv(path))
        return path

    with ThreadPoolExecutor(max_workers=4) as pool:
        futures = {table: pool.submit(write, table) for table in files if table in frames}
        return {table: f.result() for table, f in futures.items()}
