"""Operator 8: supervised subword embeddings as a quality classifier.

A document is the mean of learned vectors of its hashed words and character
n-grams; a softmax over two classes follows; numpy stochastic gradient descent
trains vectors and output together.

Scale: features are made where the rows are.  The model is trained on the
driver from at most ``SAMPLE`` labelled documents, chosen by the smallest hash
of their id (a documented bound: about 40 MB of feature counts); all other
documents are only scored, in one scan without a shuffle.  Since the output is
linear in the mean vector, scoring needs one number per bucket, so the
broadcast model is ``BUCKETS`` floats whatever the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import Prefix, Words, expand, fold_of, mix, text_slices

BUCKETS = 1 << 16
DIM = 8
GRAMS = (2, 3, 4)
SAMPLE = 4000
EPOCHS = 4
MIN_STEPS = 600
RATE = 0.5
BATCH = 64
SEED = 7
CUT = 0.3
#: Text whose features are made at once: about 300 bytes of arrays per byte.
SLICE = 1 << 19


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, text after text, and the number of features of each text.

    Features: every word; every run of 2 to 4 bytes inside a word with
    its borders (a border byte before and after it); upper and lower case
    differ.  Word pairs: two neighbours; a word that repeats the one before it
    is written as one ditto mark, whatever the word.
    """
    w = Words(texts)
    mask = np.uint64(BUCKETS - 1)
    counts = w.counts.copy()
    groups = [((mix(w.hash, 1) & mask).astype(np.int32), w.at)]
    i = w.windows(2)
    pair = mix(w.hash[i], 5) ^ mix(w.hash[i + 1], 6)
    pair[w.hash[i] == w.hash[i + 1]] = 1
    k = np.maximum(counts - 1, 0)
    groups.append(((mix(pair, 7) & mask).astype(np.int32), np.concatenate([[0], np.cumsum(k)])))
    counts = counts + k
    # words with one border byte on either side, one after another
    size = w.end - w.start + 2
    ends = np.cumsum(size)
    padded = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    padded[expand(ends - size + 1, size - 2)] = w.raw[expand(w.start, size - 2)]
    prefix = Prefix(padded.astype(np.uint64) + np.uint64(1))
    for n in GRAMS:
        k = np.maximum(size - n + 1, 0)
        at = expand(ends - size, k)
        first = np.concatenate([[0], np.cumsum(k)])[w.at]
        groups.append(((prefix.ranges(at, at + n, n) & mask).astype(np.int32), first))
        counts = counts + np.diff(first)
    out = np.empty(int(counts.sum()), np.int32)
    begin = np.cumsum(counts) - counts
    for values, first in groups:
        k = np.diff(first)
        out[expand(begin, k)] = values
        begin = begin + k
    return out, counts


class Model:
    """One weight per bucket, a bias, and the share of label 1 in training."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1; a text without features gets that of the bias alone."""
        f, n = features(texts)
        total = np.concatenate([[0.0], np.cumsum(self.weight[f], dtype=np.float64)])
        at = np.concatenate([[0], np.cumsum(n)])
        z = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, dim: int = DIM,
          rate: float = RATE, seed: int = SEED) -> Model:
    """Fit bucket vectors and softmax output by SGD on (buckets, counts, label 0/1).

    The classes weigh equally in the loss while training; the bias is then
    set back to the classes' true shares.  No rows: every score is 0.5.
    """
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    labels = np.array([r[2] for r in rows])
    share = np.bincount(labels, minlength=2) / len(rows)
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)[labels].astype(np.float32)
    epochs = max(epochs, -(-MIN_STEPS * BATCH // len(rows)))  # small samples are passed more often
    steps, done = epochs * -(-len(rows) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), BATCH):
            part = order[k:k + BATCH]
            idx = np.concatenate([rows[i][0] for i in part])
            cnt = np.concatenate([rows[i][1] / rows[i][1].sum() for i in part]).astype(np.float32)
            lens = np.array([len(rows[i][0]) for i in part])
            at = np.cumsum(lens) - lens
            hidden = np.add.reduceat(vectors[idx] * cnt[:, None], at)
            logit = hidden @ output + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= weight[part][:, None]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            back = p @ output.T
            output -= step * (hidden.T @ p) / np.float32(8)
            bias -= step * p.mean(0)
            grad = np.repeat(back, lens, axis=0) * (cnt * step)[:, None]
            np.add.at(vectors, idx, -grad * np.float32(8))
    if share.min() > 0:
        bias = bias + np.log(share / 0.5).astype(np.float32)
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def packed(counts: np.ndarray) -> bytes:
    """Counts at one byte each, or at four if one of them needs more."""
    return counts.astype("<u4" if len(counts) and counts.max() > 255 else "u1").tobytes()


def unpacked(counts: pa.Buffer, n: int) -> np.ndarray:
    """The ``n`` counts of ``packed``, over the same memory."""
    return np.frombuffer(counts, "u1" if counts.size == n else "<u4") if n else np.zeros(0, np.uint8)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, "text", SLICE):
        f, n = features(b.column("text"))
        at = np.concatenate([[0], np.cumsum(n)])
        each = [np.unique(f[at[i]:at[i + 1]], return_counts=True) for i in range(b.num_rows)]
        yield pa.record_batch([
            b.column("label"), b.column("place"),
            pa.array([x[0].astype("<u2").tobytes() for x in each], pa.binary()),
            pa.array([packed(x[1]) for x in each], pa.binary())], names=["label", "place", "buckets", "counts"])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on labelled documents: those with the ``sample`` smallest id hashes.

    Null ids, null labels and ids without a document are not used.  An id with
    several labels counts with the smallest, one with several texts with that of
    the smallest hash, so that at most ``sample`` rows reach the driver however
    often an id repeats.  A null text has no features and is not learnt from, a very long one
    is taken whole.  No labels or no documents: every score is 0.5.  Other columns
    are not looked at.
    """
    place = F.xxhash64(F.col(id_col), F.lit(SEED))
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), place.alias("place"))
              .groupBy("id", "place").agg(F.min("label").alias("label")).orderBy("place", "id").limit(sample))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = (docs.join(F.broadcast(chosen), "id")  # at most ``sample`` rows of three numbers
            .groupBy("id", "label", "place").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("first"))  # one text of each id
            .select("first.text", "label", "place")
            .mapInArrow(_count_features, "label int, place long, buckets binary, counts binary").toArrow())
    # nothing is copied on the driver: the arrays are views of the Arrow table, ordered by place and, where places are equal, by content
    place, label = rows.column("place").to_pylist(), rows.column("label").to_pylist()
    buckets, counts = [[x.as_buffer() for x in rows.column(c)] for c in ("buckets", "counts")]
    times = Counter(place)
    order = sorted(range(len(place)), key=lambda i: (place[i], buckets[i].to_pybytes(), counts[i].to_pybytes(), label[i]) if times[place[i]] > 1 else (place[i],))
    views = [(np.frombuffer(buckets[i], "<u2"), unpacked(counts[i], buckets[i].size // 2), int(label[i] > 0)) for i in order]
    return train(views)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null or empty texts get the score of the bias alone.

    Each row is scored by its own whole text: repeated rows and ids get equal
    scores for equal texts, an empty table an empty result; other columns do not matter.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", SLICE):
            yield pa.record_batch([b.column("id"), pa.array(shared.value.score(b.column("text")), pa.float64())], names=["id", "score"])

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(documents: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows (all their columns) whose score reaches ``cut``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            parts = text_slices([pa.record_batch([b.column(at)], names=["text"])], "text", SLICE)
            s = np.concatenate([shared.value.score(p.column(0)) for p in parts]) if b.num_rows else np.zeros(0)
            yield b.filter(pc.greater_equal(pa.array(s), cut))

    return documents.mapInArrow(run, documents.schema)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    model = fit(documents, labels.where(~held))
    return score(documents, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
