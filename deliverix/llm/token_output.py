"""Operator 2: token ids as length-delimited binary records with an offset index.

Record: length of the payload (unsigned 64 bit) | masked crc32 of those eight
bytes (unsigned 32 bit) | payload | masked crc32 of the payload | one byte 0x0A.
Payload: id (signed 64 bit) | flags (one byte: bytes per token, plus 128 if the
id is null) | token ids.  All integers are little-endian.  A mask rotates the
checksum by 15 bits and adds a constant, so that checksums of data that hold
checksums stay useful.

Shards are files ``part-*`` in id order; the index is a Parquet table next to
them (shard, id, seq, offset, length, n_tokens, ids_crc32), made from the shards
as read back, so a reader can fetch records in any order and check them.
Spark's own file writer and its commit protocol write the shards: a lost
executor's half-written files are never seen, and any file system that Spark
knows will do.  The closing 0x0A is that writer's line end.

Scale: one range shuffle by id and text hash; no row limit per document; each file holds at
most ``RECORDS_PER_FILE`` records.  Position sums need one row per shard.
"""

from __future__ import annotations

import codecs
import ctypes
import gc
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deliverix.llm.shared import expand, scratch_path, text_slices

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
RECORDS_PER_FILE = 4000
MASK = 0xA282EAD8
#: Pre-tokens whose ids are kept, and distinct pieces that are encoded at once.
CACHE, PIECES = 300_000, 1 << 13
#: Pre-tokens that the library sees as one.
TOGETHER = 8
#: Text whose pieces are made distinct at once, and texts that are put together at once.
SLICE, TEXTS = 1 << 21, 64

# A space between two characters that are no white space always starts a token of this tokenizer, so
# texts may be cut there.  Pieces are cut further here if all their characters are of a range whose
# classes are the same in every Unicode version; texts with other pieces, or with the string of an added
# token, are encoded as a whole.
_PLAIN = r"\A[!-~¡-ɏ](?:[\n!-~¡-ɏ]*[!-~¡-ɏ])?\z"  # Arrow's regular expressions
# The byte-level pre-tokenizer's pattern, with its letters and numbers in that range,
# and its characters for the 256 bytes; a byte 0, which is outside the range, stands between pre-tokens.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_CHARS = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))
_APART = " " + _BYTE_CHARS[1:]
_SPACE = _BYTE_CHARS[32]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def masked(crc: int) -> int:
    return ((((crc >> 15) | (crc << 17)) & 0xFFFFFFFF) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record without its closing 0x0A."""
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(zlib.crc32(size)).to_bytes(4, "little"), payload, masked(zlib.crc32(payload)).to_bytes(4, "little")))


def frames(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of every record of a shard; ValueError for a damaged one."""
    at, view = 0, memoryview(data)
    while at < len(data):
        size = view[at:at + 8]
        if len(size) < 8 or int.from_bytes(view[at + 8:at + 12], "little") != masked(zlib.crc32(size)):
            raise ValueError(f"damaged length at byte {at}")
        n = int.from_bytes(size, "little")
        payload = view[at + 12:at + 12 + n]
        if len(payload) < n or int.from_bytes(view[at + 12 + n:at + 16 + n], "little") != masked(zlib.crc32(payload)):
            raise ValueError(f"damaged record at byte {at}")
        if view[at + 16 + n:at + 17 + n] != b"\n":
            raise ValueError(f"no record end at byte {at + 16 + n}")
        yield at, payload
        at += n + 17


class Encoder:
    """Whole texts to token ids: the distinct pieces between spaces are cut into pre-tokens, and new
    pre-tokens are encoded together; their ids are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._t = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self._t.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._split = re.compile(_PATTERN).findall
        spec = json.loads(self._t.to_str())
        model = spec["model"]
        self._added = [x["content"] for x in spec["added_tokens"]]  # cut out of a text before anything else
        # the short way below holds for a plain byte-level tokenizer only
        self._byte_level = (spec["normalizer"] is None and model["type"] == "BPE" and spec["pre_tokenizer"]
                            == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
                            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
                            and all(c in model["vocab"] for c in _BYTE_CHARS))
        if self._byte_level:
            self._words = Tokenizer(self._t.model)  # the same model, on bytes shown as characters with spaces between pre-tokens
            self._words.pre_tokenizer = WhitespaceSplit()
            self._size = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # bytes by token id
            for token, i in model["vocab"].items():
                self._size[i] = len(token)
        self._rows: dict[str, int] = defaultdict(count().__next__)  # by pre-token: its place in the arrays below
        self._spaced = np.zeros(0, bool)  # does it start with a space?
        self._uses = np.zeros(0, np.int64)
        self._end = np.zeros(1, np.int64)  # the ids of row r are those from _end[r] to _end[r + 1]
        self._ids = np.zeros(0, self.type)

    def forget(self, kept: int) -> None:
        """Give memory back: keep the most used pre-tokens, whose uses count half from now on."""
        if len(self._rows) <= kept:
            return
        keep = np.sort(np.argsort(-self._uses, kind="stable")[:kept])
        rows = list(self._rows)
        self._rows = defaultdict(count(len(keep)).__next__, zip(map(rows.__getitem__, keep.tolist()), range(len(keep))))
        n = np.diff(self._end)[keep]
        self._ids = self._ids[expand(self._end[keep], n)]
        self._end = np.append(0, n.cumsum())
        self._spaced, self._uses = self._spaced[keep], self._uses[keep] // 2

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self._t.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Keep the ids of the last rows' pre-tokens: encoded in one call, told apart by their bytes.

        Those with a space before them are run together where possible: if no token reaches over an end,
        none was ever merged over it, and the ids are those of the pre-tokens for themselves."""
        shown = codecs.charmap_decode("\0".join(new).encode(), "strict", _APART)[0].split(" ")
        sizes = np.fromiter(map(len, shown), np.int64, len(new)).cumsum()
        for together in (TOGETHER, 1):
            text = "".join([x if i % together and x[0] == _SPACE else f" {x}" for i, x in enumerate(shown)])
            ids = np.array(self._words.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            ends = self._size[ids].cumsum()
            end = np.minimum(np.searchsorted(ends, sizes), len(ids) - 1)
            if ends[-1] == sizes[-1] and (ends[end] == sizes).all():
                break
        else:
            raise ValueError("a token reaches over two pre-tokens")
        self._uses = np.append(self._uses, np.zeros(len(new), np.int64))
        self._spaced = np.append(self._spaced, [x[0] == " " for x in new])
        self._end = np.append(self._end, len(self._ids) + end + 1)
        self._ids = np.append(self._ids, ids)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of plain pieces that have a space before them, and all their ids."""
        numbers, ids = [np.zeros(0, np.int64)], [np.zeros(0, self.type)]
        for i in range(0, len(pieces), PIECES):
            part = pieces.slice(i, PIECES)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            found = self._split(f" {joined}")
            row = np.fromiter(map(self._rows.__getitem__, found), np.int64, len(found))  # a new one gets the next row
            if len(self._rows) > len(self._spaced):
                self._learn([*islice(reversed(self._rows), len(self._rows) - len(self._spaced))][::-1])
            self._uses += np.bincount(row, minlength=len(self._uses))
            start = self._end[row]
            n = self._end[row + 1] - start
            numbers.append(np.add.reduceat(n, np.flatnonzero(self._spaced[row])))
            ids.append(self._ids[expand(start, n)])
            if len(self._rows) > CACHE:
                self.forget(CACHE // 2)
        return np.concatenate(numbers), np.concatenate(ids)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self._byte_level:
            return self._whole(texts.to_pylist())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        piece, at = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(piece, _PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        number = np.zeros(len(piece), np.int64)
        number[is_plain], ids = self._pieces(piece.filter(plain))
        per_text = cut.value_lengths().to_numpy()
        last = np.cumsum(per_text) - 1
        first = last + 1 - per_text
        whole = np.logical_or.reduceat(~is_plain[at], first)
        for x in self._added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        heads = self._whole(piece.take(at[first]).to_pylist())  # no space before them
        start = np.cumsum(number) - number
        short = []
        for i in range(0, len(texts), TEXTS):
            begin, to = first[i:i + TEXTS] - first[i], last[i:i + TEXTS] - first[i]
            part = at[first[i]:first[i] + to[-1] + 1]
            n = number[part]
            n[begin] = 0  # the heads
            rest = ids[expand(start[part], n)].tobytes()
            end = (np.cumsum(n)[to] * self.type.itemsize).tolist()
            short += [head + rest[j:k] for head, j, k in zip(heads[i:i + TEXTS], [0, *end], end)]
        long = iter(self._whole(texts.filter(pa.array(whole)).to_pylist()))
        return [next(long) if w else x for w, x in zip(whole.tolist(), short)]


def give_back() -> None:
    """Hand freed memory to the system: the worker process lives on, beside others of its executor."""
    gc.collect()  # batches that the ended task's cycles of objects still hold
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker process's only encoder: a function of a module, so that tasks get it by name and no copy of the dict."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        end = b"" if end_id is None else np.array([end_id], encoder.type).tobytes()
        for b in text_slices(batches, "text", SLICE):
            ids = b.column("id").to_pylist()
            out = []
            for i, tokens in zip(ids, encoder.encode(pc.fill_null(b.column("text"), ""))):
                head = (0 if i is None else i).to_bytes(8, "little", signed=True) + bytes([encoder.type.itemsize + 128 * (i is None)])
                out.append(frame(head + tokens + end))
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
        encoder.forget(0)
        give_back()
    return run


def write_tokens(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, end_id: int | None = END_ID) -> None:
    """Encode every text and write shards under ``path``/records and the offset index under ``path``/index.

    Records come in ascending id order (null first; rows that repeat an id in
    the order of their texts' hashes, each written).  A null or empty text is a record of the end id
    alone.  An empty table gives an empty index.  ``id_col`` is a long.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the text's hash splits rows of one id, or of none, over several ranges
    docs = docs.withColumn("th", F.xxhash64("text")).repartitionByRange("id", "th").sortWithinPartitions("id", "th").drop("th")
    records = docs.mapInArrow(_encode(tokenizer or tokenizer_path(), end_id), "record binary")
    (records.select(F.col("record").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", RECORDS_PER_FILE).text(f"{path}/records"))
    spark = documents.sparkSession
    read_records(spark, path).write.parquet(f"{path}/index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):
            rows = []
            for at, payload in frames(data.as_buffer()):
                flags = payload[8]
                ids = np.frombuffer(payload[9:], f"<u{flags & 127}")
                rows.append((None if flags & 128 else int.from_bytes(payload[:8], "little", signed=True),
                             len(rows), at, len(payload) + 17, len(ids), zlib.crc32(ids.astype("<u4"))))
            columns = list(zip(*rows)) or [()] * 6
            shard = os.path.basename(path)
            yield pa.record_batch([pa.array([shard] * len(rows), pa.string()), *[pa.array(c, pa.int64()) for c in columns]],
                                  names=["shard", "id", "seq", "offset", "length", "n_tokens", "ids_crc32"])
    give_back()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, read from the shards: shard, id, seq (place in the shard), offset, length, n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")
    return files.mapInArrow(_read, "shard string, id long, seq long, offset long, length long, n_tokens long, ids_crc32 long")


def shard_place(shard: Column) -> Column:
    """Place of a shard by its file's numbers: of the partition, and of the file in it (their digits are padded, but may be more)."""
    number = lambda pattern: F.regexp_extract(shard, pattern, 1).cast("long")
    return F.struct(number(r"^part-(\d+)").alias("partition"), number(r"-c(\d+)[^-]*$").alias("file"))


def read_tokens(data: bytes, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """The id and token ids of the record that the index places at ``offset`` of a shard."""
    payload = next(frames(memoryview(data)[offset:offset + length]))[1]
    ids = np.frombuffer(payload[9:], f"<u{payload[8] & 127}")
    return None if payload[8] & 128 else int.from_bytes(payload[:8], "little", signed=True), ids


def query(documents: DataFrame) -> DataFrame:
    """Write, then read the files back: each document's place in the token stream, length and checksum."""
    spark = documents.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(documents, path)
    records = spark.read.parquet(f"{path}/index")  # what the one pass over the shards found
    shards = records.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(shard_place(F.col("shard"))).rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # RECORDS_PER_FILE rows
    return records.join(shards, "shard").select(
        F.col("id").alias("doc_id"), (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens", "ids_crc32")
