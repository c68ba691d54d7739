"""Published versions of the exported tables, and the report views over them.

Overwriting a folder in place leaves readers without files while it is written,
and with half of them if the write fails.  Here each export goes to a
numbered folder of its own; then one row per table (folder, format, schema, row count)
is committed as the manifest of that version in one task and one file, which
appears by one rename.  Readers follow the newest manifest, so a failed
export is never seen and the version before stays as it is.

    <out>/versions/<number>/<table>/...     data, never changed after its manifest
    <out>/manifest/version=<number>/...     one file
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deliverix.operators import views
from deliverix.operators.summary import TEXT_METRICS
from deliverix.params import DEFAULT, Params
from deliverix.sources.csv_ingest import path_exists
from deliverix.sources.sinks import read_exported

MANIFEST = "table_name string, path string, format string, schema string, rows long"


def _manifests(spark: SparkSession, out_dir: str) -> DataFrame | None:
    path = f"{out_dir.rstrip('/')}/manifest"
    if not path_exists(spark, path):
        return None
    return spark.read.schema(f"{MANIFEST}, version long").json(path)


def newest_version(spark: SparkSession, out_dir: str) -> int:
    """The newest committed version, 0 before the first."""
    rows = _manifests(spark, out_dir)
    return 0 if rows is None else rows.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def publish(spark: SparkSession, out_dir: str, write: Callable[[str], DataFrame], schemas: dict[str, StructType], fmt: str = "csv") -> int:
    """Let ``write`` fill the folder of the next version, then commit its manifest; returns the version.

    ``write`` gets the folder and returns (table_name, rows) as read back from
    it.  If it raises, nothing was published; the next attempt writes the same folder
    anew.  The manifest's folder must not exist yet, so of two writers of one version one fails.
    """
    number = newest_version(spark, out_dir) + 1
    folder = f"{out_dir.rstrip('/')}/versions/{number:08d}"
    rows = {r.table_name: r.rows for r in write(folder).collect()}  # one row per table
    missing = set(schemas) - set(rows)
    if missing:
        raise RuntimeError(f"not written: {', '.join(sorted(missing))}")
    entries = [(name, f"{folder}/{name}", fmt, schema.json(), rows[name]) for name, schema in schemas.items()]
    (spark.createDataFrame(entries, MANIFEST).coalesce(1)
     .write.mode("errorifexists").json(f"{out_dir.rstrip('/')}/manifest/version={number}"))
    return number


class Published:
    """The newest (or a given) version of a published export and the views J46-J52 over it.

    Frames belong to one version and stay valid until :meth:`refresh` finds a
    newer one; the folder of an older version is not touched by newer exports.
    """

    def __init__(self, spark: SparkSession, out_dir: str, version: int | None = None, params: Params = DEFAULT):
        self.spark, self.out_dir, self.params = spark, out_dir, params
        self.version = newest_version(spark, out_dir) if version is None else version
        self._load()

    def _load(self) -> None:
        manifests = _manifests(self.spark, self.out_dir)
        rows = [] if manifests is None else manifests.where(F.col("version") == self.version).collect()  # one row per table
        if not rows:
            raise FileNotFoundError(f"{self.out_dir} has no version {self.version}")
        self._entries = {r.table_name: r for r in rows}
        self._frames: dict[str, DataFrame] = {}

    def refresh(self) -> bool:
        """Follow a newer version if there is one; True if there was."""
        newest = newest_version(self.spark, self.out_dir)
        if newest == self.version:
            return False
        self.version = newest
        self.__dict__.pop("metrics", None)
        self._load()
        return True

    @property
    def rows(self) -> dict[str, int]:
        """Row counts as they were read back when the version was written."""
        return {name: r.rows for name, r in self._entries.items()}

    def frame(self, name: str) -> DataFrame:
        """An exported table with the schema it was written with."""
        if name not in self._frames:
            entry = self._entries[name]
            folder, table = entry.path.rsplit("/", 1)
            import json
            self._frames[name] = read_exported(self.spark, folder, table, StructType.fromJson(json.loads(entry.schema)), entry.format)
        return self._frames[name]

    @cached_property
    def metrics(self) -> DataFrame:
        """The summary's text values as numbers and texts again."""
        text = F.col("metric").isin(sorted(TEXT_METRICS))
        return self.frame("kpi_summary").select("metric", F.when(~text, F.col("value").cast("double")).alias("value_num"),
                                                F.when(text, F.col("value")).alias("value_text"))

    def kpi_cards(self) -> DataFrame:
        return views.kpi_cards(self.metrics, self.frame("validation"))

    def filter_domains(self) -> DataFrame:
        return views.filter_domains(self.frame("seller"), self.frame("sla_state"), self.frame("lead_category"), self.params)

    def view_categories(self, categories=None) -> DataFrame:
        return views.view_categories(self.frame("lead_category"), categories, self.params)

    def view_sellers(self, min_orders=None, n: int = 20) -> DataFrame:
        return views.view_sellers(self.frame("seller"), min_orders, n, self.params)

    def view_states(self, states=None) -> DataFrame:
        return views.view_states(self.frame("sla_state"), states)

    def view_corridors(self, n: int = 20) -> DataFrame:
        return views.view_corridors(self.frame("corridors"), n)

    def view_velocity(self, n: int = 30) -> DataFrame:
        return views.view_velocity(self.frame("velocity"), n)
