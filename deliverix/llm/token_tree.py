"""Contexts of tokens for operator 10: a probabilistic suffix tree over up to two tokens.

* A context is what stands before a token: the last 1 to ``DEPTH`` tokens, the
  text's beginning being one.  Candidates are those that occur ``MIN_COUNT`` times
  or more in the training texts; a longer one's suffixes occur as often at least.
* Its next symbols are the words that occur ``MIN_COUNT`` times or more in the
  training texts and the end, as far as they follow it ``MIN_PAIR`` times or more;
  everything else is told by its suffix.
* It is retained if the next symbols diverge from its suffix's (n * KL over its
  symbols and the rest at least ``min_divergence``), or if a longer one is.
* p(x | context) = (n(x) + r p(x | suffix)) / (n + PRIOR), with r the rest of n and
  PRIOR; it adds up to one if the suffix's does.  A token is scored from the longest
  retained suffix of what precedes it.

All bounds are fixed counts: contexts and symbols grow with the corpus, nothing
is cut to a size.  Runs of tokens are 64-bit keys, built from the left, so that
the key of a context and the token behind it is the key of that longer run.

Scale: each length is one pass over the training texts.  A task looks candidates up in
bitmaps of fixed size (a false hit only costs a row, counts decide later), sums
equal (context, symbol) rows, and the shuffle brings the sums together; the counts of
contexts are those of the shorter runs, so rare symbols need not be sent.  The
tree is tables; its most frequent contexts, a fixed number of entries, are broadcast
for scoring, tokens in others are looked up by parts (module ``cold_scores``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import Words, mix, signed, summed, text_slices, written

DEPTH = 2
MIN_COUNT = 256
MIN_PAIR = 16
PRIOR = 4.0
#: Entries that are broadcast for scoring, those of the most frequent contexts; tokens in other contexts are looked up by parts.
HOT = 1 << 20
BEGIN, END = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
#: Text whose runs are counted at once: about 150 bytes of arrays per byte.
SLICE = 1 << 21
#: Longs of a bitmap, of ``BITS`` bits each (2 MB).
LONGS, BITS = 1 << 18, 62


def find(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in the sorted ``known``, and whether they are there."""
    at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
    return at, known[at] == x if len(known) else np.zeros(len(x), bool)


class Index:
    """Sorted keys, found by their leading bits: keys are hashes, so a few stand behind each."""

    def __init__(self, keys: np.ndarray):
        keys = keys.view(np.uint64)
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.uint64(0))
        bits = max(1, min(24, len(keys).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.first = np.full((1 << bits) + 1, len(keys), np.int32)
        self.first[:-1] = np.searchsorted(keys[self.order], np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key its place in the given order, and whether it is there."""
        lead = (x >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        has = (at < end) & (self.keys[at] == x)
        left = np.flatnonzero(~has & (at + 1 < end))
        while len(left):
            at[left] += 1
            found = self.keys[at[left]] == x[left]
            has[left[found]] = True
            left = left[~found]
            left = left[at[left] + 1 < end[left]]
        place = np.zeros(len(x), np.int64)
        place[has] = self.order[at[has]]
        return place, has


def run_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Key of a run of tokens from that of all but the last and the last."""
    return mix(before ^ mix(token, 61), 62)


def runs(w: Words) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of all tokens of all texts, ends included: the text, the token, and for each length the context's key, whether
    there is one, and the key of context and token."""
    texts = len(w.at) - 1
    doc = np.repeat(np.arange(texts), w.counts + 1)
    token = np.full(len(doc), END)
    token[np.arange(len(w)) + np.repeat(np.arange(texts), w.counts)] = w.hash
    place = np.arange(len(doc)) - np.repeat(w.at[:-1] + np.arange(texts), w.counts + 1)
    key, contexts, there, keys = token, [], [], []
    for d in range(1, DEPTH + 1):
        before = np.concatenate([np.zeros(1, np.uint64), key[:-1]])
        if d == 1:
            before[place == 0] = BEGIN
        key = run_key(before, token)
        contexts.append(before)
        there.append(place >= d - 1)
        keys.append(key)
    return doc, token, contexts, there, keys


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key`` modulo the size of the map: LONGS rows at most come to the driver."""
    at = F.pmod("key", F.lit(LONGS * BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % BITS).cast("int"))
    rows = keys.select(F.floor(at / BITS).alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(LONGS, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("b").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = np.mod(signed(key), LONGS * BITS)
    return (bits[at // BITS] >> (at % BITS)) & 1 == 1


def whole(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``limit`` bytes."""
    kept, size = [], 0
    for b in batches:
        kept.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.concat_batches(kept)
            kept, size = [], 0
    if kept:
        yield pa.concat_batches(kept)


def _count(shared, d: int):
    """Training texts to (ctx, x, n): how often symbols that may be frequent follow contexts of ``d`` tokens that may be."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        words, contexts = shared.value
        for b in text_slices(whole(batches), "text", SLICE):
            _, token, before, there, _ = runs(Words(b.column("text"), lower=True))
            use = there[d - 1] & ((token == END) | in_bitmap(words, token)) & ((before[d - 1] == BEGIN) | in_bitmap(contexts, before[d - 1]))
            ctx, x = before[d - 1][use], token[use]
            key, first, n = np.unique(run_key(ctx, x), return_index=True, return_counts=True)
            yield key, pa.record_batch([pa.array(signed(ctx[first])), pa.array(signed(x[first])), pa.array(n)], names=["ctx", "x", "n"])
    return lambda batches: summed(counts(batches))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ctx, up, x, n, ...) with the keys of context and symbol, and of suffix and symbol (of the symbol, for the shortest)."""
    for b in batches:
        x = b.column("x").to_numpy().view(np.uint64)
        up = b.column("up").to_numpy().view(np.uint64)
        key = run_key(b.column("ctx").to_numpy().view(np.uint64), x)
        down = np.where(up == 0, x, run_key(up, x))
        yield pa.record_batch([pa.array(signed(key)), pa.array(signed(down)), *b.columns], names=["key", "down", *b.schema.names])


ENTRY = "key long, down long, ctx long, up long, x long, n long, total long, root double"


@dataclass
class TokenTree:
    """Tables of the retained contexts (ctx, up, level, total, back, entries) and of their entries (key, ctx, total, gain)."""

    contexts: DataFrame
    entries: DataFrame

    def hot(self, limit: int) -> HotTree:
        """The contexts of the highest counts with ``limit`` entries or fewer, and a bitmap of the others."""
        least, n = None, 0
        for b in sorted(self.contexts.groupBy(_size().alias("size")).agg(F.sum(F.col("entries") + 1).alias("n")).collect(), reverse=True):  # some hundred rows
            n += b["n"]
            if n > limit:
                break
            least = b["size"]
        c = self.contexts.where(_is_hot(least)).select("ctx", "back").orderBy("ctx").toArrow()
        e = self.entries.where(_is_hot(least)).select("key", "gain").orderBy("key").toArrow()
        rest = self.contexts.where(~_is_hot(least)).select(F.col("ctx").alias("key"))
        return HotTree(c.column("ctx").to_numpy(), c.column("back").to_numpy(), e.column("key").to_numpy(), e.column("gain").to_numpy(), bitmap(rest), least)

    def places(self, least: int | None) -> DataFrame:
        """(ctx, place, back) of the contexts that are not broadcast; place: the shortest of its suffixes, or itself, that is not."""
        cold = self.contexts.where(~_is_hot(least))
        out, shorter = None, None
        for d in range(1, DEPTH + 1):  # a suffix occurs as often at least: none is broadcast whose suffix is not
            here = cold.where(F.col("level") == d)
            if shorter is None:
                here = here.select("ctx", F.col("ctx").alias("place"), "back")
            else:
                upper = shorter.select(F.col("ctx").alias("up"), F.col("place").alias("up_place"))
                here = here.join(upper, "up", "left").select("ctx", F.coalesce("up_place", "ctx").alias("place"), "back")
            shorter = here
            out = here if out is None else out.unionByName(here)
        return written(out, "context-places")


def _size() -> Column:
    return F.floor(F.log2("total") * 16).cast("int")


def _is_hot(least: int | None) -> Column:
    """Whether a context, or an entry's, is broadcast."""
    return F.lit(False) if least is None else _size() >= least


@dataclass
class HotTree:
    ctx: np.ndarray
    back: np.ndarray
    key: np.ndarray
    gain: np.ndarray
    others: np.ndarray
    least: int | None

    @property
    def some_cold(self) -> bool:
        return bool(self.others.any())

    @cached_property
    def indexes(self) -> tuple[Index, Index]:
        """Made where they are used: they are larger than what is sent."""
        return Index(self.ctx), Index(self.key)

    def gains(self, w: Words) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """What contexts add to the root's log10 probability of each text.

        Tokens whose next longer context is not here are left out of the sums: for each number of
        contexts found, such tokens, what they gain so far, their longer contexts (0: none) and their texts."""
        doc, token, before, there, keys = runs(w)
        contexts, known_runs = self.indexes
        gain = np.zeros(len(doc))
        level = np.zeros(len(doc), np.int32)
        for d in range(1, DEPTH + 1):  # from the shortest up; a retained context's suffixes are retained
            open_ = np.flatnonzero(there[d - 1] & (level == d - 1))
            k, has = contexts.find(before[d - 1][open_])
            open_, k = open_[has], k[has]
            level[open_] = d
            e, known = known_runs.find(keys[d - 1][open_])
            gain[open_] = np.where(known, self.gain[e] if len(self.gain) else 0.0, self.back[k] + gain[open_])
        cold, rest = np.zeros(len(doc), bool), []
        if self.some_cold:
            other = [there[d] & in_bitmap(self.others, before[d]) for d in range(DEPTH)]
            for d in range(DEPTH):
                rows = np.flatnonzero((level == d) & other[d])
                cold[rows] = True
                rest.append([token[rows], gain[rows], *[np.where(other[k][rows], before[k][rows], np.uint64(0)) for k in range(d, DEPTH)], doc[rows]])
        return np.bincount(doc[~cold], weights=gain[~cold], minlength=len(w.at) - 1), rest


def grow(train: DataFrame, words: DataFrame, ends: int, end: float, min_divergence: float, min_count: int = MIN_COUNT, min_pair: int = MIN_PAIR) -> TokenTree:
    """The tree of the training texts; ``words``: (key, c, log_p) of the vocabulary; ``ends`` texts, of probability ``end`` at the root."""
    spark = train.sparkSession
    common = written(words.where(F.col("c") >= min_count).select("key", "c", F.col("log_p").cast("double").alias("log_p")), "common-words")
    begin, last = int(signed(np.array([BEGIN]))[0]), int(signed(np.array([END]))[0])
    symbols = common.select(F.col("key").alias("x"), F.pow(F.lit(10.0), "log_p").alias("root")).unionByName(
        spark.range(1).select(F.lit(last).alias("x"), F.lit(float(end)).alias("root")))
    first = spark.range(1 if ends >= min_count else 0).select(F.lit(begin).alias("ctx"), F.lit(0).cast("long").alias("up"), F.lit(ends).cast("long").alias("total"))
    contexts = common.select(F.col("key").alias("ctx"), F.lit(0).cast("long").alias("up"), F.col("c").alias("total")).unionByName(first)
    words_bits = bitmap(common)
    levels, shorter = [], None
    for d in range(1, DEPTH + 1):
        shared = spark.sparkContext.broadcast((words_bits, bitmap(contexts.select(F.col("ctx").alias("key")))))
        counts = train.mapInArrow(_count(shared, d), "ctx long, x long, n long").groupBy("ctx", "x").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pair)
        counts = counts.join(contexts, "ctx").join(symbols, "x").select("ctx", "up", "x", "n", "total", "root")
        entries = written(counts.mapInArrow(_keyed, ENTRY), f"runs-{d}")
        # q: what the suffix says, as counted; p: smoothed, later
        if shorter is None:
            entries = entries.withColumn("q", F.col("root"))
        else:
            s = shorter.select(F.col("key").alias("down"), (F.col("n") / F.col("total")).alias("q"))
            entries = entries.join(s, "down")
        levels.append(entries)
        shorter = written(entries, f"entries-{d}")
        levels[-1] = shorter
        contexts = written(shorter.where((F.col("n") >= min_count) & (F.col("x") != last))
                           .select(F.col("key").alias("ctx"), F.col("down").alias("up"), F.col("n").alias("total")), f"contexts-{d + 1}")
    kept = []
    above = None
    for entries in reversed(levels):  # the longest first: what is kept keeps its suffixes
        gain = F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))
        c = entries.groupBy("ctx").agg(F.any_value("up").alias("up"), F.any_value("total").alias("total"), F.sum("n").alias("in_entries"),
                                       F.sum("q").alias("q"), F.sum(gain).alias("divergence"), F.count(F.lit(1)).alias("entries"))
        rest = F.col("total") - F.col("in_entries")
        other = F.when(rest > 0, rest * F.log(rest / F.col("total") / F.greatest(F.lit(1.0) - F.col("q"), F.lit(1e-12)))).otherwise(0.0)
        keep = F.col("divergence") + other >= min_divergence
        if above is not None:
            needed = above.select(F.col("up").alias("ctx")).distinct().withColumn("needed", F.lit(True))
            c = c.join(needed, "ctx", "left")
            keep = keep | F.coalesce("needed", F.lit(False))
        c = c.where(keep).select("ctx", "up", "total", "entries", (rest + PRIOR).alias("rest"))
        above = written(c.withColumn("back", F.log10(F.col("rest") / (F.col("total") + PRIOR))), "kept-contexts")
        kept.append(above)
    kept.reverse()
    scored, upper = [], None
    for entries, c in zip(levels, kept):
        e = entries.select("key", "down", "ctx", "n", "root", "x").join(c.select("ctx", "total", "rest"), "ctx")
        if upper is None:
            e = e.withColumn("below", F.col("root"))
        else:
            e = e.join(upper.select(F.col("key").alias("down"), F.col("p").alias("below")), "down")
        e = e.withColumn("p", (F.col("n") + F.col("rest") * F.col("below")) / (F.col("total") + PRIOR))
        upper = written(e.select("key", "ctx", "total", "p", F.log10(F.col("p") / F.col("root")).alias("gain")), "token-entries")
        scored.append(upper.select("key", "ctx", "total", "gain"))
    kept = [c.select("ctx", "up", F.lit(d).alias("level"), "total", "back", "entries") for d, c in enumerate(kept, 1)]
    every, contexts = scored[0], kept[0]
    for e, c in zip(scored[1:], kept[1:]):
        every, contexts = every.unionByName(e), contexts.unionByName(c)
    return TokenTree(contexts, every)
