"""Operator 13: centroid clustering by Orchard search, exact in integers.

Components are scaled to integers; distances, sums and means are exact, so that
results do not depend on partitioning.  Each round:

* every centroid has a list of the others by distance; a vector starts at a
  centroid, walks its list, and on meeting a closer centroid jumps to that one's
  list; centroids met before are marked; it stops at the first neighbour strictly
  beyond twice the vector's distance (the triangle inequality: none further on
  can be closer or equally close), so that ties still go to the smaller number;
* each task sums its vectors per centroid and the sums are added by Spark; the
  driver gets one row per centroid and makes the new ones.

Scale: vectors are written once as packed integers and read in every round, so
a lost executor costs its tasks of one round; nothing of a vector is shuffled in
the rounds, a task sends one row per centroid.  Centroids and lists (k and the
number of components are parameters) are the only things that tasks are given.

Null arrays, other lengths, null or non-finite components leave a vector out.
Null ids hash as no digits.  Rows that repeat an id are vectors of their own;
equal vectors go to one cluster.  With fewer vectors than centroids each vector starts
one; without vectors the result is empty.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deliverix.llm.shared import written

DIM = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SALT = "2:"
#: Scaled components must stay below this, so that squared distances of up to 256 components fit in 64 bits.
LIMIT = 2 ** 26
CHUNK = 4096


def scaled(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``dim`` finite components, and those as integers floor(scale * x)."""
    keep = np.flatnonzero(pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), dim).to_numpy(zero_copy_only=False))
    values = pc.list_flatten(vectors.take(pa.array(keep, pa.int64()))).cast(pa.float64())
    x = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(x).all(1)
    x = x[finite]
    if len(x) and np.abs(x).max() >= LIMIT / scale:
        raise ValueError(f"a component of {np.abs(x).max()} is too large for exact distances: below {LIMIT // scale} expected")
    return keep[finite], np.floor(x * scale).astype(np.int32)


def _pack(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = scaled(b.column("vector"), dim, scale)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, "<i4"))])
            yield pa.record_batch([b.column("id").take(pa.array(rows, pa.int64())), packed.cast(pa.binary())], names=["id", "q"])
    return run


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    column = column.cast(pa.large_binary())  # of its own offset, not that of a slice it is made from
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = memoryview(data)[off[0]:off[-1]] if len(column) else b""
    return np.frombuffer(raw, "<i4").reshape(-1, dim).astype(np.int64)


class Orchard:
    """Centroids with, for each, the others in order of their distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = c = np.asarray(centroids, np.int64)
        between = np.array([((c - one) ** 2).sum(1) for one in c]).reshape(len(c), len(c))
        np.fill_diagonal(between, -1)
        self.near = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.far = np.take_along_axis(between, self.near, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (the smaller number of equally near ones) and squared distance of each vector, and the distances computed."""
        n, k = len(x), len(self.centroids)
        at = np.zeros(n, np.int64) if start is None else start.astype(np.int64)
        best = ((x - self.centroids[at]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), at] = True
        place = np.zeros(n, np.int64)
        computed = n
        left = np.arange(n) if k > 1 else np.zeros(0, np.int64)
        while len(left):
            c = at[left]
            go = self.far[c, place[left]] <= 4 * best[left]
            left = left[go]
            other = self.near[c[go], place[left]]
            place[left] += 1
            new = ~seen[left, other]
            rows, other = left[new], other[new]
            seen[rows, other] = True
            d = ((x[rows] - self.centroids[other]) ** 2).sum(1)
            computed += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (other < at[rows]))
            rows, other = rows[better], other[better]
            best[rows], at[rows], place[rows] = d[better], other, 0  # jump to the list of the closer one
            left = left[place[left] < k - 1]
        return at, best, computed


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            yield b.slice(at, CHUNK)


def _sums(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(np.array(centroids, np.int64))
        total, count = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for b in _chunks(batches):
            x = unpacked(b.column("q"), dim)
            at, _, _ = search.nearest(x)
            order = np.argsort(at, kind="stable")
            own, first = np.unique(at[order], return_index=True)
            total[own] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(at, minlength=len(centroids))
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(dim))],
                              names=["cluster", "n", *(f"s{i}" for i in range(dim))])
    return run


def _assign(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(np.array(centroids, np.int64))
        for b in _chunks(batches):
            at, d, _ = search.nearest(unpacked(b.column("q"), dim))
            yield pa.record_batch([b.column("id"), pa.array(at.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])
    return run


def first_centroids(vectors: DataFrame, clusters: int, salt: str, dim: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in that order; of equal ids by their components."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()
    return [np.frombuffer(r.q, "<i4").tolist() for r in rows]


def fit(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, dim: int = DIM) -> list[list[int]]:
    """The centroids after ``rounds`` rounds: the floors of the means of their vectors; those without vectors stay."""
    columns = ["n", *(f"s{i}" for i in range(dim))]
    schema = "cluster int, " + ", ".join(f"{c} long" for c in columns)
    for _ in range(rounds):
        sums = vectors.select("q").mapInArrow(_sums(centroids, dim), schema)
        centroids = [*centroids]
        for r in sums.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in columns)).collect():
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    return centroids


def clusters(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
             dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """One row per kept vector (id, cluster, distance), as a written table, and the centroids."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    packed = written(rows.mapInArrow(_pack(dim, scale), f"id {kind}, q binary"), "vectors")
    centroids = fit(packed, first_centroids(packed, k, salt, dim), rounds, dim)
    if not centroids:
        return packed.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    return written(packed.mapInArrow(_assign(centroids, dim), f"id {kind}, cluster int, distance long"), "clusters"), centroids


def query(embeddings: DataFrame) -> DataFrame:
    rows, centroids = clusters(embeddings)
    spark = embeddings.sparkSession
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row per cluster
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy())).join(named, "cluster")
    return rows.join(F.broadcast(per), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds one after another; a centroid is a row (number, components as a list)."""
    nearest = """
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.rid, k.c, list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {k} AS k)
  GROUP BY rid"""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
    SELECT sha256('{SALT}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT {CLUSTERS}))"""]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(k=f'k{i}')})")
        parts.append(f"""k{i + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.q, k.q) AS q FROM k{i} AS k LEFT JOIN (
    SELECT c, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS q FROM (
      SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
      FROM (SELECT a.c, generate_subscripts(v.q, 1) AS i, unnest(v.q) AS x FROM a{i} AS a JOIN v USING (rid))
      GROUP BY c, i)
    GROUP BY c) AS m USING (c))""")
    last = f"k{ROUNDS}"
    parts.append(f"a AS MATERIALIZED ({nearest.format(k=last)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a JOIN v USING (rid) JOIN {last} AS k USING (c)
"""


SQL = _sql()
