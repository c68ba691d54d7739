"""Operator 7: benchmark decontamination with a broadcast set of test n-grams.

Windows of ``WINDOW`` normalised words of every benchmark item form a hash
set; document windows are looked up in it, hits are verified word for word,
and the hit words (or whole documents) can be removed.

Scale: the documents are scanned once without a shuffle.  The set is broadcast
only while the benchmark has at most ``MAX_BROADCAST_WINDOWS`` windows (a
counted bound, about 200 MB in a worker); beyond it the windows are dealt
into that many-window parts by hash, each part is a broadcast of its own, and
the hits of the parts are merged per document (parts only add scans).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import Prefix, Words, text_slices, written

WINDOW = 10
MAX_BROADCAST_WINDOWS = 1_000_000

#: Bytes of words after lower-casing A-Z: 0-9, a-z and everything outside ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
#: The same as a Java pattern over the lower-cased text.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """(words, size, items): each distinct window, its words joined by a space, and the sorted ids of its items."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    return (w.select("item", "size", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("words"))
            .groupBy("words", "size").agg(F.array_sort(F.collect_set("item")).alias("items")))


class WindowSet:
    """Windows by size: sorted hashes, and the words of each to verify a hit."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.items: dict[bytes, list[str]] = {}
        by_size: dict[int, list[bytes]] = {}
        for words, size, items in rows:
            key = words.encode()
            self.items[key] = list(items)
            by_size.setdefault(size, []).append(key)
        self.hashes = {}
        for size, keys in by_size.items():
            w = Words(pa.array([k.decode() for k in keys], pa.string()), WORD_BYTES)
            self.hashes[size] = np.unique(Prefix(w.hash).ranges(w.at[:-1], w.at[1:]))

    def hits(self, w: Words) -> list[tuple[int, int, bytes]]:
        """Verified hits in a slice of texts: (first word, words, window)."""
        out = []
        prefix = Prefix(w.hash)
        for size, known in self.hashes.items():
            at = w.windows(size)
            h = prefix.ranges(at, at + size)
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in at[known[k] == h].tolist():
                key = b" ".join(w.word(j) for j in range(i, i + size))
                if key in self.items:
                    out.append((i, size, key))
        return out


def _scan(found: WindowSet):
    schema = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = found.value
        for b in text_slices(batches, "text"):
            w = Words(b.column("text"), WORD_BYTES, lower=True)
            hit: list[set[int]] = [set() for _ in range(b.num_rows)]
            items: list[set[str]] = [set() for _ in range(b.num_rows)]
            for i, size, key in windows.hits(w):
                d = int(np.searchsorted(w.at, i, side="right")) - 1
                hit[d].update(range(i - int(w.at[d]), i - int(w.at[d]) + size))
                items[d].update(windows.items[key])
            yield pa.record_batch([
                *[b.column(c) for c in b.schema.names if c != "text"], pa.array(w.counts, pa.int64()),
                pa.array([sorted(x) for x in hit], pa.list_(pa.int32())),
                pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=[*[c for c in b.schema.names if c != "text"], "n_words", "hit", "items"])
    return run, schema


def scan(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
         max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``documents``: id, n_words, hit (positions of hit words, ascending), items (ids as strings, sorted).

    Null or wordless texts have no words and no hits, an empty benchmark hits
    nothing, an item of fewer words than a window is one window, repeated
    items hit together, a null item id counts for no item name but its words
    are hit; repeated document rows are scanned each; very long texts are scanned
    whole; an empty table gives an empty one; other columns are not looked at.
    """
    spark = documents.sparkSession
    windows = written(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    n = windows.count()
    parts = max(1, -(-n // max_broadcast))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if parts > 1:
        docs = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = docs.schema["id"].dataType.simpleString()
    out = None
    for part in range(parts):
        rows = [tuple(r) for r in windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part).collect()]  # max_broadcast rows or so
        run, _ = _scan(spark.sparkContext.broadcast(WindowSet(rows)))
        key = "key bigint, " if parts > 1 else ""
        one = docs.mapInArrow(run, f"id {kind}, {key}n_words bigint, hit array<int>, items array<string>")
        out = one if out is None else out.unionByName(one)
    if parts > 1:  # rows that repeat an id and a text have equal hits: one of them stands for each
        rows = docs.groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies"))
        out = out.groupBy("id", "key").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("hit"))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        a, b = out.alias("a"), rows.alias("b")
        out = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key"))).select(
            "a.id", "n_words", F.array_distinct("hit").alias("hit"), "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
    return out.withColumnRenamed("id", id_col)


def _clean(found: WindowSet, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = found.value
        for b in text_slices(batches, text_col):
            w = Words(b.column(text_col), WORD_BYTES, lower=True)
            at = [i for i, _, _ in windows.hits(w)]
            clean = np.ones(b.num_rows, bool)
            clean[np.searchsorted(w.at, np.array(at, np.int64), side="right") - 1] = False
            yield b.filter(pa.array(clean))
    return run


def clean_documents(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Documents without any hit: the rows that hold no benchmark window (all their columns).

    Rows are judged by their own text, whatever their ids: other rows of a
    null or repeated id stay.  Parts of a large benchmark are scans one after
    another, each of the rows that the one before left.
    """
    spark = documents.sparkSession
    windows = written(benchmark_windows(benchmark, window=WINDOW), "windows")
    parts = max(1, -(-windows.count() // max_broadcast))
    docs = documents
    for part in range(parts):
        rows = [tuple(r) for r in windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part).collect()]  # max_broadcast rows or so
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(WindowSet(rows)), text_col), documents.schema)
        if part < parts - 1:
            docs = written(docs, "clean-part")
    return docs


def _mark(found: WindowSet, text_col: str):
    """Adds the positions of hit words to those of the column _hit, row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = found.value
        for b in text_slices(batches, text_col):
            w = Words(b.column(text_col), WORD_BYTES, lower=True)
            hit = [set(h or ()) for h in b.column("_hit").to_pylist()]
            for at, size, _ in windows.hits(w):
                row = int(np.searchsorted(w.at, at, side="right")) - 1
                hit[row].update(range(at - int(w.at[row]), at - int(w.at[row]) + size))
            yield b.set_column(b.schema.get_field_index("_hit"), "_hit", pa.array([sorted(h) for h in hit], pa.list_(pa.int32())))
    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, _hit) to (id, text): the words, lower-cased, at other positions."""
    for b in text_slices(batches, "text"):
        w = Words(b.column("text"), WORD_BYTES, lower=True)
        gone = np.zeros(len(w), bool)
        hits = b.column("_hit")
        gone[hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.at[:-1], np.diff(hits.offsets.to_numpy()))] = True
        kept = [b" ".join([w.word(i) for i in range(x, y) if not gone[i]]) for x, y in zip(w.at[:-1].tolist(), w.at[1:].tolist())]
        yield pa.record_batch([b.column("id"), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "text"])


def cut_spans(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """(id, text) of every row: the normalised words that no window hits, joined by one space.

    Rows are cut by their own text, whatever their ids.  Null, empty and wordless
    texts give an empty one; hits of all parts of a large benchmark are judged on the input.
    """
    spark = documents.sparkSession
    windows = written(benchmark_windows(benchmark, window=WINDOW), "windows")
    parts = max(1, -(-windows.count() // max_broadcast))
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                            F.array().cast("array<int>").alias("_hit"))
    kind = docs.schema["id"].dataType.simpleString()
    for part in range(parts):
        rows = [tuple(r) for r in windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part).collect()]  # max_broadcast rows or so
        docs = docs.mapInArrow(_mark(spark.sparkContext.broadcast(WindowSet(rows)), "text"), f"id {kind}, text string, _hit array<int>")
        if part < parts - 1:
            docs = written(docs, "cut-part")
    return docs.mapInArrow(_without, f"id {kind}, text string").withColumnsRenamed({"id": id_col, "text": text_col})


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(documents, benchmark).select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


SQL = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win
       FROM (SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM iw),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') AS w FROM documents),
dw AS (SELECT rn, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win
       FROM (SELECT rn, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT dw.rn, dw.p, dw.k, item FROM dw JOIN iw USING (k, win)),
words AS (SELECT rn, count(*) AS n_hit FROM (SELECT DISTINCT rn, unnest(range(p, p + k)) AS q FROM hit) GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rn, item FROM hit) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rn) LEFT JOIN items USING (rn)
"""
