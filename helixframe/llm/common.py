"""Shared helpers of the training-data operators: tables, scratch space, and array kernels over raw text.

The kernels work on the byte buffer of a whole Arrow string column at once (numpy, no per-word Python
objects).  A *word* is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.store import numbered, scratch, written

__all__ = ["numbered", "scratch", "written"]

WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id inside operators: it sorts after every real id.
NULL_ID = (1 << 63) - 1
#: Text bytes handled by the kernels at once; one longer document is handled alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(df: DataFrame, rows_each: int, rows: int | None = None) -> int:
    """Partitions that hold ``rows_each`` rows each."""
    n = df.count() if rows is None else rows
    return max(1, -(-n // rows_each))


# ---------------------------------------------------------------- array kernels

_IS_WORD = np.ones(256, np.uint8)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a run of texts: byte positions, 64-bit hashes, and where each text's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False, inside: np.ndarray = _IS_WORD):
        texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        n = len(texts)
        _, off, data = texts.buffers()
        self.off = np.frombuffer(off, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        first = int(self.off[0])
        self.off = self.off - first
        size = int(self.off[-1])
        self.data = np.frombuffer(data, np.uint8, size, first) if size else np.zeros(0, np.uint8)
        self.lower = lower
        word = np.zeros(size + 2, np.uint8)
        word[1:-1] = inside[self.data]
        begin = word[1:-1] & (1 - word[:-2])
        finish = word[1:-1] & (1 - word[2:])
        edge = self.off[:-1][self.off[:-1] < size]
        begin[edge] = word[1:-1][edge]
        last = self.off[1:][self.off[1:] > 0] - 1
        finish[last] = word[1:-1][last]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        #: doc k has words at[k] .. at[k + 1]
        self.at = np.searchsorted(self.start, self.off)
        self.at[-1] = len(self.start)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes (after A-Z is lower-cased, if asked for); the lanes are independent of each other.

        The state is scrambled after each eight bytes, so it isn't linear in them and no pattern of letters cancels out.
        """
        data = np.concatenate([LOWER[self.data] if self.lower else self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
        size = self.end - self.start
        h = mix((size.astype(np.uint64) + np.uint64(lane << 32)) * _MULT)
        live = np.flatnonzero(size <= _LONG_WORD)
        at, left = self.start[live], size[live]
        while len(live):
            h[live] = mix((h[live] ^ (eight[at] & _TAIL[np.minimum(left, 8)])) * _MULT)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > _LONG_WORD).tolist():
            h[k] = xxhash.xxh3_64_intdigest(data[self.start[k] : self.end[k]], lane)
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of h[i : i + k] for each i; the last k - 1 are left out.  Spans of doubling length are joined, each join scrambled."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, width, span = None, 0, 1
    while True:
        if k & span:
            out, width = (h if out is None else _joined(out, h[width:])), width + span
        if 2 * span > k:
            return mix(out + np.uint64(k))
        h, span = _joined(h, h[span:]), 2 * span


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return mix(a[:n] * _MULT + b[:n])


def chunks(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has at most CHUNK_BYTES of text, or one row; null texts become empty."""
    most = most or CHUNK_BYTES
    at = batch.schema.get_field_index(column)
    text = batch.column(at).cast(pa.large_string()).fill_null("")
    batch = batch.set_column(at, column, text)
    if not len(text):
        return
    size = np.diff(np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8))
    begin, held = 0, 0
    for k, s in enumerate(size.tolist()):
        if held and held + s > most:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += s
    yield batch.slice(begin)


def row_chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``chunks`` of a batch whose rows are packed into a struct ``row``: columns row and text (taken from the struct)."""
    rows = batch.column("row")
    text = rows.field(rows.type.get_field_index("text"))
    yield from chunks(pa.RecordBatch.from_arrays([rows, text], ["row", "text"]))


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as int64, NULL_ID for null."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ragged(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values[at[k] : at[k + 1]] as the k-th list."""
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))
