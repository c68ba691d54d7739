"""Helpers shared by the operators: scratch tables, hashed words of Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.session import ensure_checkpoint_dir

#: Java pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Java pattern of a run of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null id inside joins and orderings: before every other id.
NULL_ID = -(2 ** 63)
#: Text handed to numpy at once; a single longer document is taken whole.
SLICE_BYTES = 1 << 20
#: Bytes of words hashed at once, so that the arrays of 64-bit values stay in a core's cache.
HASH_BYTES = 1 << 15
#: Counts that a task holds to put equal ones together, and rows of them handed to Spark at once.
HELD, HANDED = 1 << 20, 1 << 17
#: Whether Spark removes a query's shuffle files as soon as the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    Once it is written, the shuffle files it came from go; the session's own setting holds for all other queries.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array (none for null)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % folds


def id_key(doc_id: Column) -> Column:
    """The id as a non-null long."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


# --- numpy side -----------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_POW["p"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POW[key] = np.cumprod(step, dtype=np.uint64)
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((0xD1B54A32D192ED03 * (seed + 1)) & _MASK)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Hashes of any ranges of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        p, self._inv = powers(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[:-1], out=self._sum[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inv[start], seed)


SPACE_BYTES = np.ones(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = False


class Words:
    """Words of several texts: byte ranges, hashes, and each text's range of words.

    ``is_word`` says which bytes belong to words; words end with their text.
    """

    def __init__(self, texts: pa.Array, is_word: np.ndarray = SPACE_BYTES, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, off, data = texts.buffers()
        off = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.raw, n = raw, len(raw)
        m = is_word[raw]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        edge = off[:-1][(off[:-1] > 0) & (off[:-1] < n)]
        first[edge], last[edge - 1] = m[edge], m[edge - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text t: self.at[t] .. self.at[t + 1]
        self.at = np.searchsorted(self.start, off).astype(np.int64)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = np.empty(len(self), np.uint64)
            cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.raw), HASH_BYTES)), len(self))).tolist()
            for a, b in zip(cuts, cuts[1:]):  # a word's hash does not depend on its place
                at = self.start[a]
                values = self.raw[at:self.end[b - 1]].astype(np.uint64) + np.uint64(1)
                self._hash[a:b] = Prefix(values).ranges(self.start[a:b] - at, self.end[a:b] - at)
        return self._hash

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words that stay in one text."""
        n = np.maximum(self.counts - size + 1, 0)
        return expand(self.at[:-1], n)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]].tobytes()


def expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] values), start[1], ... as one array."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(n) - n
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, n)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right"))
            end = max(at + 1, end)
            yield batch.slice(at, end - at)
            at = end


def summed(parts: Iterator[tuple[np.ndarray, pa.RecordBatch]], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Batches of counts (the last column) with the 64-bit keys of their rows: rows of one key as one row, as far as
    about ``held`` rows reach."""
    keys, batches, size = [], [], 0

    def merged() -> tuple[np.ndarray, pa.RecordBatch]:
        rows = pa.concat_batches(batches)
        key, first, code = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.bincount(code, weights=rows.columns[-1].to_numpy(), minlength=len(key)).astype(np.int64)
        take = pa.array(first)
        return key, pa.record_batch([*[c.take(take) for c in rows.columns[:-1]], pa.array(n)], names=rows.schema.names)

    def handed(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, HANDED):
            yield rows.slice(at, HANDED)

    for key, batch in parts:
        keys.append(key)
        batches.append(batch)
        size += len(key)
        if size >= held:
            key, batch = merged()
            keys, batches, size = [key], [batch], len(key)
            if 2 * size > held:
                yield from handed(batch)
                keys, batches, size = [], [], 0
    if size:
        yield from handed(merged()[1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
