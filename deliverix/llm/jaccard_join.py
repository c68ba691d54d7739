"""Operator 4: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of ``SHINGLE``-word shingles; pairs of a Jaccard similarity
of ``THRESHOLD`` or more are links.

1. Documents with equal sets are one class; its smallest id stands for it.
2. MinHash values in ``BANDS`` bands of ``ROWS`` give buckets, the smallest
   member being a bucket's hub; members are joined to one hub and hubs that
   share a member to each other (never members to members), and the
   components of that graph hold every pair that shares a bucket.  A pair at
   the threshold shares none with probability (1 - 0.8^6)^48 = 5e-7.
3. Components are compared in blocks of bounded size, each pair of blocks in a
   task of its own.  MinHash values are compared ``STEP`` at a time; a pair is
   dropped once the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below ``TOLERANCE``; the rest are verified exactly.
4. A task gives link counts per class and a spanning forest of its links, not
   the links; the components of the forests are the classes of near duplicates.

Scale: exact copies never meet each other; buckets cost one row per document
and band; hot components are split in blocks whose rows are bounded by count
and by shingles; nothing of a group is collected beyond two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.llm.components import connected_components, star_edges
from deliverix.llm.shared import NULL_ID, Prefix, Words, expand, id_key, mix, signed, text_slices, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 48
ROWS = 6
COMPARED = 128
STEP = 32
TOLERANCE = 1e-9
#: Classes per block: the most, the fewest, and the blocks that a component has before they grow.
BLOCK = 1024
LEAST_BLOCK = 128
BLOCKS = 16
BLOCK_SHINGLES = 2_000_000
SEED = 20


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, text after text, and their numbers.

    A text of fewer words, but not none, is one shingle.
    """
    w = Words(texts)
    n = w.counts
    k = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    at = expand(w.at[:-1], k)
    h = Prefix(mix(w.hash, 11)).ranges(at, np.minimum(at + size, np.repeat(w.at[1:], k)), 12)
    doc = np.repeat(np.arange(len(n)), k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(n))


def minhashes(sets: np.ndarray, n: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """``count`` MinHash values of each set (rows); sets must not be empty."""
    at = np.cumsum(n) - n
    out = np.empty((len(n), count), np.uint64)
    for i, a in enumerate(np.random.default_rng(SEED).integers(0, 2 ** 63, count, np.uint64) * np.uint64(2) + np.uint64(1)):
        np.minimum.reduceat(sets * a, at, out=out[:, i])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, text) to the set's key (two hashes), size, bands and compared MinHash values; wordless texts have size 0."""
    for b in text_slices(batches, "text"):
        sets, n = shingle_sets(b.column("text"))
        some = np.flatnonzero(n)
        m = minhashes(sets, n[some]) if len(some) else np.zeros((0, BANDS * ROWS), np.uint64)
        bands = np.zeros((len(some), BANDS), np.uint64)
        for r in range(ROWS):
            bands = mix(bands ^ m[:, r::ROWS][:, :BANDS], r)
        bands = mix(bands ^ np.arange(BANDS, dtype=np.uint64)[None, :], ROWS)
        values = (mix(m[:, :COMPARED], 1) & np.uint64(0xFFFF)).astype("<u2")
        p = Prefix(sets)
        end = np.cumsum(n)
        full = np.full(b.num_rows, None, object)
        lists, sigs = full.copy(), full.copy()
        for k, i in enumerate(some.tolist()):
            lists[i], sigs[i] = signed(np.ascontiguousarray(bands[k])), values[k].tobytes()
        yield pa.record_batch([
            b.column("doc"), b.column("th"), pa.array(signed(p.ranges(end - n, end, 1))), pa.array(signed(p.ranges(end - n, end, 2))),
            pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["doc", "th", "a", "b", "size", "bands", "sig"])


def least_matches(threshold: float, tolerance: float, compared: int = COMPARED, step: int = STEP) -> list[int]:
    """For each number of values compared, the least number of equal ones with which a pair goes on.

    With m of n equal and a uniform prior the similarity is Beta(m + 1, n - m
    + 1); that it reaches t has the probability that a binomial (n + 1, t) is at most m.
    """
    out = []
    for n in range(step, compared + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def likely_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float,
                 least: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that survive the length filter and every step of the pruning."""
    left, right = [], []
    for at in range(0, len(a), 128):
        part = slice(at, min(at + 128, len(a)))
        short, long_ = np.minimum(na[part, None], nb[None, :]), np.maximum(na[part, None], nb[None, :])
        ok = short >= threshold * long_ - 1e-9
        if same:
            ok &= np.arange(part.start, part.stop)[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(ok)
        i += at
        m = np.zeros(len(i), np.int64)
        for k, bound in enumerate(least):
            s = slice(k * STEP, (k + 1) * STEP)
            for c in range(0, len(i), 100_000):
                m[c:c + 100_000] += (a[i[c:c + 100_000], s] == b[j[c:c + 100_000], s]).sum(1)
            go = m >= bound
            i, j, m = i[go], j[go], m[go]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j, pair by pair."""
    if len(i) <= 3000:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    rows, cols = np.unique(i), np.unique(j)
    used = np.unique(np.concatenate([rows, cols]))
    doc = np.repeat(used, [len(sets[x]) for x in used])
    _, code, times = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True, return_counts=True)
    shared = times[code] > 1  # other shingles are in no intersection
    doc = doc[shared]
    code = np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    doc, code = doc[order], code[order]
    place = np.full(len(sets), -1)
    out = np.zeros((len(rows), len(cols)), np.float32)
    width = 2048
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, (at, at + width))
        x = []
        for side in (rows, cols):
            place[:] = -1
            place[side] = np.arange(len(side))
            d, c = place[doc[lo:hi]], code[lo:hi] - at
            matrix = np.zeros((len(side), width), np.float32)
            matrix[d[d >= 0], c[d >= 0]] = 1
            x.append(matrix)
        out += x[0] @ x[1].T
    return out[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with n nodes and the edges (i, j)."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        r, s = root(x), root(y)
        if r != s:
            parent[r] = s
            out.append((x, y))
    return out


def _verify(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        node = group.column("node").to_numpy()
        _, one = np.unique(node, return_index=True)  # rows that repeat an id and a text come once each
        group = group.take(pa.array(one))
        node, block = group.column("node").to_numpy(), group.column("block").to_numpy()
        copies = group.column("copies").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
        n = np.array([len(x) for x in sets])
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(node), COMPARED)
        x, y = np.flatnonzero(block == first), np.flatnonzero(block == second)
        i, j = likely_pairs(sig[x], sig[y], n[x], n[y], threshold, least, first == second) if len(x) and len(y) else (x[:0], y[:0])
        i, j = x[i], y[j]
        both = common(sets, i, j) if len(i) else np.zeros(0, np.int64)
        link = both >= threshold * (n[i] + n[j] - both) - 1e-9
        i, j = i[link], j[link]
        links = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
        some = np.flatnonzero(links)
        edges = forest(len(node), i, j)
        u = np.array([node[e[0]] for e in edges], np.int64)
        v = np.array([node[e[1]] for e in edges], np.int64)
        return pa.table({
            "node": np.concatenate([node[some], u]), "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(u), np.int64)]),
            "other": pa.array([None] * len(some) + v.tolist(), pa.int64())})
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its sorted shingle hashes."""
    for b in text_slices(batches, "text"):
        sets, n = shingle_sets(b.column("text"))
        end = np.cumsum(n)
        names = [c for c in b.schema.names if c != "text"]
        yield pa.record_batch([*[b.column(c) for c in names], pa.array([sets[e - k:e].tobytes() for e, k in zip(end.tolist(), n.tolist())], pa.binary())],
                              names=[*names, "set"])


def _linked(documents: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Tables of all rows (doc, th, a, b, size, ...) and of all sets of shingles: a, b, size, copies, links, label
    (the same for sets that links connect) and rep, the smallest (doc, th) of the set's rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(id_key(F.col(id_col)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed_ = written(docs.mapInArrow(_sign, "doc long, th long, a long, b long, size long, bands array<long>, sig binary"), "signatures")
    classes = (signed_.where("size > 0").groupBy("a", "b", "size")
               .agg(F.min(F.struct("doc", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"),
                    F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig")))  # functions of the set
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = written(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub"), "buckets")
    groups = connected_components(star_edges(buckets.join(hubs, "bucket"), "node", "hub"))
    members = groups.join(classes.select("node", "size", "copies", "sig", "rep.doc", "rep.th"), "node")
    members = written(members, "members")
    n = F.count(F.lit(1))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(min(LEAST_BLOCK, BLOCK)), F.ceil(n / BLOCKS)))
    weights = members.groupBy("label").agg(
        F.greatest(F.ceil(n / block), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    members = members.join(written(weights, "blocks"), "label").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = docs.join(members, ["doc", "th"]).select("node", "label", "copies", "sig", "block", "blocks", "text").mapInArrow(
        _sets, "node long, label long, copies long, sig binary, block int, blocks int, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sets.select("*", other.alias("other")).select(
        "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "sig", "block", "set")
    found = written(pairs.groupBy("label", "i", "j").applyInArrow(
        _verify(threshold, tolerance), "node long, links long, other long"), "links")
    linked = connected_components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select("node", "a", "b", "size", "copies", "rep")
    nodes = nodes.join(linked, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return signed_, written(nodes, "nodes")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``documents``: id, class_id, n_links, n_copies.

    class_id: the smallest id (null is the smallest) among the documents that
    links connect; n_links: other documents of a similarity of ``threshold`` or
    more, those with an equal set of shingles (n_copies) included.  Texts
    without words have no links and a class of their own.  Rows that repeat an
    id count as documents of their own.  A very long text is one set of shingles,
    compared in a block of its own size; an empty table gives an empty one; other
    columns, whatever their names, are not looked at.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    signed_, nodes = _linked(documents, id_col, text_col, threshold, tolerance)
    least = nodes.groupBy("label").agg(F.min("rep.doc").alias("class"))
    info = written(nodes.join(least, "label").select("a", "b", "size", "class", "copies", F.coalesce("links", F.lit(0)).alias("links")), "class-info")
    rows = signed_.select("doc", "a", "b", "size").join(info, ["a", "b", "size"], "left")
    own = F.coalesce(F.col("class"), F.col("doc"))
    return rows.select(
        F.nullif("doc", F.lit(NULL_ID)).cast(kind).alias(id_col), F.nullif(own, F.lit(NULL_ID)).cast(kind).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"))


def keep_representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` (all columns) that stand for their class: of each class one row.

    It is the row with the class's smallest id (null is the smallest), among
    those the one with the smallest hash of its text; among rows equal in both,
    any.  An id may stand for several classes by rows of its own.  Texts
    without words are each a class, so all of them stay, null ones included.  An
    empty table stays empty.
    """
    signed_, nodes = _linked(documents, id_col, text_col, THRESHOLD, TOLERANCE)
    least = nodes.groupBy("label").agg(F.min("rep").alias("rep")).select("rep.doc", "rep.th")
    rows = signed_.groupBy("doc", "th").agg(F.any_value("size").alias("size"), F.count(F.lit(1)).alias("n"))
    empty = rows.where("size = 0").select("doc", "th", F.lit(1).alias("n"))
    kept = rows.where("size > 0").join(least, ["doc", "th"], "left_semi").select("doc", "th", "n").unionByName(empty)
    kept = written(kept, "kept-rows")
    same = ((id_key(documents[id_col]) == kept["doc"])
            & (F.xxhash64(F.coalesce(documents[text_col].cast("string"), F.lit(""))) == kept["th"]))
    single = documents.join(kept.where("n = 1"), same, "left_semi")
    several = kept.where("n > 1")
    if several.isEmpty():
        return single
    repeated = documents.withColumns({"_doc": id_key(F.col(id_col)), "_th": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    repeated = repeated.join(several.select(F.col("doc").alias("_doc"), F.col("th").alias("_th")), ["_doc", "_th"], "left_semi")
    return single.unionByName(repeated.dropDuplicates(["_doc", "_th"]).select(*documents.columns))


def query(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)
