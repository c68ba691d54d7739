"""Scores of what is not broadcast, for operator 10: words and contexts of tokens meet the model's tables by parts.

The model (words, retained contexts, their entries) is dealt into ``parts`` by bits of
keys: a word by its own key, a context and its entries by the shortest of its suffixes that is
not broadcast (``place``), so that a token needs one part only.  A task that reads texts numbers those
of a block, and sends each part what it has to look up for that block: packed columns of a few bytes a
token, not a row.  A part is looked up at one place, texts' sums go back to their block, and
become one row per text there.

* A block is the texts whose lookups are about ``HELD`` in one task, 65,536 texts at most.
* Columns of a message are one behind the other in ``data``, ``n`` values each (``COLUMNS``).
* ``check`` is a checksum of a block's lookups and of those answered: a block that does not
  get exactly its own back (a task run again met its texts in another order) is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import Words, signed, text_slices, written
from deliverix.llm.token_tree import DEPTH, HotTree, Index, TokenTree, run_key

#: Rows of the model in a part, and tokens of the training texts per part, about.
PART_ROWS, PART_TOKENS = 1 << 17, 1 << 22
#: Lookups of a block, and lookups answered at once.
HELD, ANSWERED = 1 << 18, 1 << 17
#: Texts of a block at most: their numbers are 16 bits.
TEXTS_OF_BLOCK = 1 << 16
#: With contexts that are not broadcast, texts are scored in so many rounds, so that a round's messages are so much smaller.
ROUNDS = 4
#: Kinds of messages, in the order in which a part reads them; a token behind ``level`` broadcast contexts is of kind TOKEN + level.
MODEL, TOKEN, WORD, TEXTS = 0, 1, DEPTH + 1, DEPTH + 2

COLUMNS = {
    MODEL: (np.int64, np.float64, np.int64, np.int8),  # key, value, count, table (0 contexts, 1 entries, 2 words)
    **{TOKEN + level: (np.uint64, np.float64, *[np.uint64] * (DEPTH - level), np.uint16) for level in range(DEPTH)},  # token, gain, contexts, text
    WORD: (np.uint64, np.uint32, np.uint16),  # key, occurrences, text
    TEXTS: (np.int64, np.int64, np.int64, np.float64, np.float64),  # doc, n, known, logs, log_p
}
MESSAGE = "part int, block long, kind int, n int, check long, data binary"
SCORES = "doc long, n long, known long, logs double, log_p double"


def _packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpacked(kind: int, n: int, data: pa.Buffer) -> list[np.ndarray]:
    out, at = [], 0
    for dtype in COLUMNS[kind]:
        out.append(np.frombuffer(data, dtype, n, at))
        at += n * np.dtype(dtype).itemsize
    return out


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    part, block, kind, n, check, data = zip(*rows)
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(n, pa.int32()),
                            pa.array(check, pa.int64()), pa.array(data, pa.binary())], names=["part", "block", "kind", "n", "check", "data"])


def _checks(kind: int, columns: list[np.ndarray]) -> np.ndarray:
    return columns[0] * (columns[-1].astype(np.uint64) * np.uint64(2) + np.uint64(1)) + np.uint64(kind)


def parts_of(rows: int, tokens: int) -> int:
    """How many parts there are: a power of two."""
    return 1 << max(rows // PART_ROWS, tokens // PART_TOKENS).bit_length()


def _pack_model(rows: pa.Table) -> pa.Table:
    """The model's rows of one part as one message."""
    part = rows.column("part")[0].as_py()
    columns = [rows.column(c).to_numpy().astype(t) for c, t in zip(("key", "value", "c", "kind"), COLUMNS[MODEL])]
    return pa.Table.from_batches([_messages([(part, -1, MODEL, rows.num_rows, 0, _packed(columns))])])


def model_parts(tree: TokenTree, words: DataFrame, tokens: int, hot_least: int | None) -> tuple[DataFrame, int]:
    """The model as messages to its parts, and the number of parts; ``words``: (key, c, log_p)."""
    places = tree.places(hot_least)
    none = F.lit(0).cast("long")
    tables = (places.select("place", F.col("ctx").alias("key"), F.col("back").alias("value"), none.alias("c"), F.lit(0).alias("kind"))
              .unionByName(tree.entries.join(places.select("ctx", "place"), "ctx").select("place", "key", F.col("gain").alias("value"), none.alias("c"), F.lit(1).alias("kind")))
              .unionByName(words.select(F.col("key").alias("place"), "key", F.col("log_p").alias("value"), "c", F.lit(2).alias("kind"))))
    rows = written(tables, "model-rows")
    parts = parts_of(rows.count(), tokens)
    part = F.col("place").bitwiseAND(parts - 1).cast("int")
    return written(rows.select(part.alias("part"), "key", "value", "c", "kind").groupBy("part").applyInArrow(_pack_model, MESSAGE), "model-parts"), parts


class _Block:
    """Texts of a task and what is to be looked up for them."""

    def __init__(self, number: int):
        self.number, self.texts, self.size, self.sums = number, 0, 0, []
        self.lookups: dict[int, list] = {}

    def add(self, sums: list[np.ndarray], lookups: dict[int, list[np.ndarray]]) -> None:
        """``lookups``: by kind the places and the columns, the last one being the text."""
        for kind, columns in lookups.items():
            if len(columns[0]):
                self.lookups.setdefault(kind, []).append([*columns[:-1], (columns[-1] + self.texts).astype(np.uint16)])
                self.size += len(columns[0])
        self.sums.append(sums)
        self.texts += len(sums[0])

    def messages(self, parts: int) -> pa.RecordBatch:
        rows, check = [], np.zeros(1, np.uint64)
        for kind, held in self.lookups.items():
            place, *columns = [np.concatenate(x) for x in zip(*held)]
            check += _checks(kind, columns).sum(dtype=np.uint64)
            part = (place & np.uint64(parts - 1)).astype(np.uint32)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            columns = [c[order] for c in columns]
            found, first = np.unique(part[order], return_index=True)
            for p, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                rows.append((p, self.number, kind, b - a, 0, _packed([c[a:b] for c in columns])))
        sums = _packed([np.concatenate(x).astype(t) for x, t in zip(zip(*self.sums), COLUMNS[TEXTS])])
        rows.append(((self.number + (self.number >> 32)) & (parts - 1), self.number, TEXTS, self.texts, int(signed(check)[0]), sums))
        return _messages(rows)


def ask(model, parts: int, held: int = HELD) -> callable:
    """(doc, text) to messages: the texts' sums over frequent words and broadcast contexts, and to each part what it has to look up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, tree = model.value
        logs, known = np.log10(frequent.c + 0.5), (frequent.c > 0).astype(np.float64)
        block = _Block(TaskContext.get().partitionId() << 32)
        for b in (s.slice(at, TEXTS_OF_BLOCK) for s in text_slices(batches, "text") for at in range(0, s.num_rows, TEXTS_OF_BLOCK)):
            if block.texts and (block.size >= held or block.texts + b.num_rows > TEXTS_OF_BLOCK):
                yield block.messages(parts)
                block = _Block(block.number + 1)
            w, rows = Words(b.column("text"), lower=True), b.num_rows
            k, hot = frequent.index.find(w.hash)
            gain, lookups = tree.gains(w)
            doc = np.repeat(np.arange(rows), w.counts)
            hot_doc, k = doc[hot], k[hot]

            def total(x: np.ndarray) -> np.ndarray:
                return np.bincount(hot_doc, weights=x[k], minlength=rows) if len(x) else np.zeros(rows)

            doc, h = doc[~hot], w.hash[~hot]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(h))).astype(np.uint32)
            block.add([b.column("doc").to_numpy(), w.counts, total(known), total(logs), total(frequent.log_p) + gain],
                      {TOKEN + level: [c[2], *c] for level, c in enumerate(lookups)} | {WORD: [h[first], h[first], tf, doc[first]]})
        if block.texts:
            yield block.messages(parts)
    return run


@dataclass
class _Part:
    """One part of the model."""

    indexes: list[Index]
    values: list[np.ndarray]
    c: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, value: np.ndarray, c: np.ndarray, kind: np.ndarray) -> _Part:
        at = [kind == k for k in range(3)]
        return cls([Index(key[a]) for a in at], [np.append(value[a], 0.0) for a in at], np.append(c[at[2]], 0))

    def find(self, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, has = self.indexes[k].find(key)
        place[~has] = len(self.values[k]) - 1
        return place, has

    def gains(self, token: np.ndarray, gain: np.ndarray, *contexts: np.ndarray) -> np.ndarray:
        """From the shortest context up: each tells its entries and leaves the others to its suffix."""
        for c in contexts[:-1]:
            at, retained = self.find(0, c)
            e, known = self.find(1, run_key(c, token))
            gain = np.where(retained, np.where(known, self.values[1][e], self.values[0][at] + gain), gain)
        return gain

    def words(self, key: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, _ = self.find(2, key)
        c = self.c[at]
        return np.where(c > 0, tf, 0), tf * np.log10(c + 0.5), tf * self.values[2][at]


def _answers(part: int, model: _Part, kind: int, blocks: list[int], sizes: list[int], datas: list[pa.Buffer]) -> pa.RecordBatch:
    """Messages of one kind to one part, answered with sums by text."""
    columns = [np.concatenate(x) for x in zip(*[_unpacked(kind, n, d) for n, d in zip(sizes, datas)])]
    no = columns[-1].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    width = np.maximum.reduceat(no, first) + 1
    base = np.cumsum(width) - width
    at = no + np.repeat(base, sizes)
    sums = [np.bincount(at, weights=x, minlength=int(width.sum())) for x in (model.words(*columns[:-1]) if kind == WORD else (model.gains(*columns),))]
    checks = signed(np.add.reduceat(_checks(kind, columns), first))
    return _messages([(part, block, kind, n, check, _packed([s[a:a + n] for s in sums]))
                      for block, a, n, check in zip(blocks, base.tolist(), width.tolist(), checks.tolist())])


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages ordered by part and kind to messages for blocks; the sums of texts pass through."""
    empty = _Part.of(*[np.zeros(0, t) for t in COLUMNS[MODEL]])
    part, model, now, held, size = None, empty, None, [], 0
    for b in batches:
        data = b.column("data")
        for i, (p, block, kind, n, check) in enumerate(zip(*[b.column(c).to_pylist() for c in ("part", "block", "kind", "n", "check")])):
            if held and ((p, kind) != now or size >= ANSWERED):
                yield _answers(part, model, now[1], *zip(*held))
                held, size = [], 0
            if p != part:
                part, model = p, empty
            now, d = (p, kind), data[i].as_buffer()
            if kind == MODEL:
                model = _Part.of(*_unpacked(MODEL, n, d))
            elif kind == TEXTS:
                yield _messages([(p, block, kind, n, check, d.to_pybytes())])
            else:
                held.append((block, n, d))
                size += n
    if held:
        yield _answers(part, model, now[1], *zip(*held))


def _texts(rows: pa.Table) -> pa.Table:
    """All messages to one block to (doc, n, known, logs, log_p) of each of its texts."""
    rows = rows.combine_chunks().to_batches()[0]
    data, texts, check, answers = rows.column("data"), None, 0, []
    for i, (kind, n, c) in enumerate(zip(*[rows.column(x).to_pylist() for x in ("kind", "n", "check")])):
        if kind == TEXTS:
            texts, check = _unpacked(TEXTS, n, data[i].as_buffer()), check - c
        else:
            answers.append((kind, n, data[i].as_buffer()))
            check += c
    if texts is None or check % (1 << 64):
        raise RuntimeError("a block of texts did not get the answers to its own lookups: the documents were not read in the same order again")
    doc, count, known, logs, log_p = [x.copy() for x in texts]
    for kind, n, d in answers:
        sums = np.frombuffer(d, np.float64).reshape(-1, n)
        if kind == WORD:
            known[:n] += sums[0].astype(np.int64)
            logs[:n] += sums[1]
        log_p[:n] += sums[-1]
    return pa.table({"doc": doc, "n": count, "known": known, "logs": logs, "log_p": log_p})


def sums_of_texts(docs: DataFrame, model, hot: HotTree, tree: TokenTree, words: DataFrame, tokens: int) -> DataFrame:
    """(doc, text) to (doc, n, known, logs, log_p) of each row: its words, those known, and sums over words and tokens.

    ``model``: the frequent words and ``hot``, broadcast; ``words``: (key, c, log_p) of all words; ``tokens``: how many were learnt from.
    """
    messages, parts = model_parts(tree, words, tokens, hot.least)
    rounds = ROUNDS if hot.some_cold else 1
    out = None
    for r in range(rounds):
        asked = docs.where(F.pmod(F.xxhash64("doc", "text"), F.lit(rounds)) == r).mapInArrow(ask(model, parts), MESSAGE)
        answered = asked.unionByName(messages).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(answer, MESSAGE)
        sums = written(answered.groupBy("block").applyInArrow(_texts, SCORES), "document-sums")
        out = sums if out is None else out.unionByName(sums)
    return out
