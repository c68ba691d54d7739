"""Operator 11: fill-in-middle transformation with a sparse index of multi-byte characters.

A text is cut at two places into prefix, middle and suffix, which are written
in another order behind sentinels, so that a model learns to fill the middle.

* Cuts are drawn in units (tokens of letters, or code points) from the hash of
  the row's id, so that reruns and other partitionings give the same output.
* Texts are handled as UTF-8 bytes.  ``Exceptions`` records only the multi-byte
  characters of a buffer, by position and excess bytes; ``searchsorted`` over
  them converts code-point cuts to byte cuts and back, and between them a
  position is its own plus a constant.  A wholly ASCII buffer has an empty index.
* ``restored`` rebuilds the text from output and form alone.

Scale: one narrow pass without a shuffle; a task holds a slice of about 1 MB of
text (one text, if that is longer) and its output.  Nothing is broadcast.

Null and empty texts are plain and empty.  A null id hashes as no digits.  Texts
that hold a sentinel stay plain, whole.  Rows that repeat an id are cut alike,
each by its own length.  Very long texts are cut whole.  An empty table gives
an empty one; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Share of texts, in hundredths, that stay plain, and of the others that are written suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SALT = "1:"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Exceptions:
    """The multi-byte characters of a UTF-8 buffer: where they stand and how many bytes beyond one they take."""

    def __init__(self, raw: np.ndarray):
        self.byte = np.flatnonzero(raw >= 0xC0)
        first = raw[self.byte]
        extra = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        #: excess[i]: bytes beyond one of the first i exceptions
        self.excess = np.zeros(len(extra) + 1, np.int64)
        np.cumsum(extra, out=self.excess[1:])
        self.char = self.byte - self.excess[:-1]

    def to_char(self, byte: np.ndarray) -> np.ndarray:
        """Code points before the byte offsets (of character starts, or the end)."""
        return byte - self.excess[np.searchsorted(self.byte, byte)]

    def to_byte(self, char: np.ndarray) -> np.ndarray:
        """Byte offsets of the code points."""
        return char + self.excess[np.searchsorted(self.char, char)]


def token_starts(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Byte offsets of the tokens (runs of ASCII letters, other code points alone); ``start``: where texts begin."""
    letter = _LETTER[raw]
    inside = np.zeros(len(raw), bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[start[start < len(raw)]] = False
    return np.flatnonzero(~inside & ((raw & 0xC0) != 0x80))


def cuts(raw: np.ndarray, off: np.ndarray, low: np.ndarray, high: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Of texts raw[off[t]:off[t + 1]]: their numbers of units, byte offsets and code points of two cuts each.

    ``low`` and ``high`` are drawn numbers, taken modulo the units and one.
    """
    index = Exceptions(raw)
    chars = index.to_char(off)
    if unit == "token":
        tokens = token_starts(raw, off[:-1])
        at = np.searchsorted(tokens, off)
    else:
        tokens, at = None, chars
    n = np.diff(at)
    x, y = (at[:-1] + h % (n + 1) for h in (low, high))
    x, y = np.minimum(x, y), np.maximum(x, y)
    if tokens is None:
        x_char, y_char = x, y
        x, y = index.to_byte(x), index.to_byte(y)
    else:  # the unit after a text's last is where the text ends
        tokens = np.append(tokens, len(raw))
        x, y = (np.minimum(tokens[c], off[1:]) for c in (x, y))
        x_char, y_char = index.to_char(x), index.to_char(y)
    return n, x, y, x_char - chars[:-1], y_char - x_char


def _draw(ids: pa.Array, salt: str) -> np.ndarray:
    """The first four 32-bit numbers of the hash of each id."""
    out = b"".join(hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).digest()[:16] for i in ids.to_pylist())
    return np.frombuffer(out, ">u4").reshape(-1, 4).astype(np.int64)


def _transform(unit: str, plain: int, suffix_first: int, salt: str):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p_mark, s_mark, m_mark = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            texts = pc.fill_null(b.column("text"), "").cast(pa.large_string())
            _, off, data = texts.buffers()
            off = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1]
            whole = memoryview(data)[off[0]:off[-1]] if data is not None else memoryview(b"")
            off = off - off[0]
            h = _draw(b.column("id"), salt)
            n, x, y, prefix, middle = cuts(np.frombuffer(whole, np.uint8), off, h[:, 0], h[:, 1], unit)
            marked = any(m in bytes(whole) for m in marks)
            forms, outputs = [], []
            for k in range(len(texts)):
                text = bytes(whole[off[k]:off[k + 1]])
                if not text or h[k, 2] % 100 >= 100 - plain or (marked and any(m in text for m in marks)):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                i, j = int(x[k] - off[k]), int(y[k] - off[k])
                if h[k, 3] % 100 < suffix_first:
                    forms.append("spm")
                    outputs.append(b"".join([s_mark, text[j:], p_mark, text[:i], m_mark, text[i:j]]))
                else:
                    forms.append("psm")
                    outputs.append(b"".join([p_mark, text[:i], s_mark, text[j:], m_mark, text[i:j]]))
            is_plain = np.array([f == "plain" for f in forms], bool)
            yield pa.record_batch([
                b.column("id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=is_plain),
                pa.array(middle, pa.int64(), mask=is_plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token",
                   plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, salt: str = SALT) -> DataFrame:
    """One row per row of ``documents``: id, n (units), form, prefix_chars, middle_chars, output.

    ``unit``: "token" cuts between tokens, "char" between code points.  ``plain``
    of a hundred texts stay as they are, ``suffix_first`` of a hundred others have
    the form spm (suffix, prefix, middle), the rest psm (prefix, suffix, middle).
    ``salt`` is hashed before the id: another salt gives other cuts.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unit is {unit!r}: token or char")
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_transform(unit, plain, suffix_first, salt),
                          f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def query(documents: DataFrame) -> DataFrame:
    return fill_in_middle(documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= {100 - PLAIN} THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
