"""Exact deduplication over a cuckoo-filter index of live digests.

A bucket of the index holds the digests that begin alike: a cuckoo filter (16-bit fingerprints, four slots) and, beside it, the stored
content.  A filter miss proves a digest new, so it is compared with nothing.  A hit is verified against the stored
SHA-256 digests, so false positives never merge texts.  An insertion that finds no place doubles the filter and refills it from the stored
keys.  Deleting the last live row of a digest takes its fingerprint out again.

``exact_dedup`` hashes each text once, writes the digests, and combines them inside each task before the one exchange to the buckets, so a text that
a third of all rows share reaches its bucket once for each task and batch.  A bucket answers for repeated digests only; what it doesn't name is unique.

``StoredIndex`` is the same index kept as tables: one row for each live digest and id, and one filter for each bucket.  Insertions, deletions and lookups
read the filters, and of the content only the digests that hit.  The id that stays is the largest live one, found anew after each change.

Edge cases: null text is the empty text; of equal texts the largest id stays, null ids sort
lowest; rows that repeat an id and text are kept together; deleting what isn't there changes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import mix, parts_for, written

SLOTS = 4
MAX_KICKS = 64
#: Distinct digests of a bucket.
ROWS_EACH = 100_000
_LOWEST = -(1 << 63)


class CuckooFilter:
    """Fingerprints of 64-bit keys; insertion, lookup and deletion are vectorised over the keys."""

    def __init__(self, capacity: int = 64):
        buckets = 1 << max(3, int(capacity / (SLOTS * 0.85)).bit_length())
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, data: bytes | None) -> CuckooFilter:
        out = cls()
        if data:
            out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        print_ = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (mix(keys) & mask).astype(np.int64)
        return print_, one, self.other(one, print_)

    def other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self.places(keys)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False on overflow; the table is then no longer complete and must be refilled from stored keys."""
        f, a, b = self.places(keys)
        f, a, b, _ = self._settle(f, a, b, a)
        f, a, b, _ = self._settle(f, a, b, b)
        at, kicks = a, 0
        while len(f):
            kicks += 1
            if kicks > MAX_KICKS:
                return False
            # one newcomer for each bucket takes a slot; what stood there moves to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = (kicks + one) % SLOTS
            out = self.table[at[one], slot].copy()
            self.table[at[one], slot] = f[one]
            late = np.ones(len(f), bool)
            late[one] = False
            moved = self.other(at[one], out)
            f, at = np.concatenate([out, f[late]]), np.concatenate([moved, at[late]])
            f, _, _, left = self._settle(f, at, at, at)
            at = at[left]
        return True

    def refill(self, stored: np.ndarray) -> None:
        """Grow until all stored keys have a place."""
        size = max(self.table.size, len(stored))
        while True:
            size *= 2
            self.table = CuckooFilter(size).table
            if self.insert(stored):
                return

    def _settle(self, f, a, b, at):
        """Put what fits into free slots of `at`; returns what is left and a mask of it."""
        left = np.ones(len(f), bool)
        for s in range(SLOTS):
            todo = np.flatnonzero(left)
            todo = todo[self.table[at[todo], s] == 0]
            _, one = np.unique(at[todo], return_index=True)
            take = todo[one]
            self.table[at[take], s] = f[take]
            left[take] = False
        return f[left], a[left], b[left], left

    def delete(self, keys: np.ndarray) -> None:
        """Take one copy of each key's fingerprint out; only keys that were inserted may be deleted."""
        for f, a, b in zip(*self.places(keys), strict=True):
            for at in (a, b):
                hit = np.flatnonzero(self.table[at] == f)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break


def _digests_of(column: pa.Array) -> np.ndarray:
    """Digests as rows of four big-endian 64-bit numbers."""
    data = column.cast(pa.binary(32))
    return np.frombuffer(data.buffers()[1], ">u8", 4 * len(data), 32 * data.offset).astype(np.uint64).reshape(-1, 4)


def _bytes_of(digests: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(digests.astype(">u8")).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(digests), [None, pa.py_buffer(data)]).cast(pa.binary())


def _grouped(digests: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal digests as one: (digests, largest id, rows).  All 256 bits are compared."""
    order = np.lexsort(digests.T[::-1])
    d = digests[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]).any(1)
    at = np.flatnonzero(first)
    if not len(at):
        return digests, ids, rows
    return d[at], np.maximum.reduceat(ids[order], at), np.add.reduceat(rows[order], at)


class DigestBucket:
    """One bucket while it is built: the filter, the stored digests, and which keys were hit."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.digests, self.ids, self.rows = np.zeros((0, 4), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.keys: list[np.ndarray] = []
        self.hit: list[np.ndarray] = []

    def add(self, digests: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        part = _grouped(digests, ids, rows)
        keys, n = np.unique(part[0][:, 0], return_counts=True)
        again = self.filter.contains(keys)
        self.hit += [keys[again | (n > 1)], part[0][part[2] > 1, 0]]
        self.parts.append(part)
        self.keys.append(keys[~again])
        if not self.filter.insert(keys[~again]):
            self.filter.refill(np.concatenate(self.keys))

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests of more than one row: those that hit, verified against the stored ones."""
        hit = np.unique(np.concatenate([*self.hit, np.zeros(0, np.uint64)]))
        some = [[x[np.isin(d[:, 0], hit)] for x in (d, i, n)] for d, i, n in self.parts]
        if not some:
            return self.digests, self.ids, self.rows
        d, i, n = _grouped(*(np.concatenate(x) for x in zip(*some, strict=True)))
        return d[n > 1], i[n > 1], n[n > 1]


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one batch by digest: largest id and number."""
    for b in batches:
        ids = b.column("id").fill_null(_LOWEST).to_numpy(zero_copy_only=False)
        d, i, n = _grouped(_digests_of(b.column("digest")), ids, np.ones(len(ids), np.int64))
        yield _batch(d, i, n)


def _batch(d: np.ndarray, i: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_bytes_of(d), pa.array(i, pa.int64()), pa.array(n, pa.int64())], ["digest", "id", "rows"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket = DigestBucket()
    for b in batches:
        bucket.add(_digests_of(b.column("digest")), b.column("id").to_numpy(), b.column("rows").to_numpy())
    yield _batch(*bucket.repeated())


_COMBINED = "digest binary, id long, rows long"


def repeated_digests(hashed: DataFrame) -> DataFrame:
    """(digest, keep, rows) of the digests that several rows of (digest, id) have."""
    combined = hashed.select("digest", "id").mapInArrow(_combine, _COMBINED)
    return combined.repartition(parts_for(hashed, ROWS_EACH), "digest").mapInArrow(_repeated, _COMBINED).withColumnRenamed("id", "keep")


def exact_dedup(df: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``df`` (doc_id, text, ...) as a struct ``row`` with keep_id, group_size, kept and text_sha256, all rows included.

    carry: the columns of ``row`` (None: all); what isn't carried isn't written.
    """
    row = F.struct(*(df.columns if carry is None else carry)).alias("row")
    hashed = written(df.select(row, F.col("doc_id").cast("long").alias("id"), _digest()), "digests")
    again = written(repeated_digests(hashed), "repeated")
    keep = F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.when(F.col("keep") != _LOWEST, F.col("keep")))
    return (
        hashed.join(again, "digest", "left")
        .withColumn("keep_id", keep)
        .select("row", "keep_id", F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


# ---------------------------------------------------------------- the kept index


@dataclass
class StoredIndex:
    """content: (bucket, digest, id, rows) of the live rows; filters: (bucket, slots) of the live digests."""

    content: DataFrame
    filters: DataFrame
    buckets: int

    def keeps(self) -> DataFrame:
        """(digest, keep, rows) of every live digest."""
        keep = F.max("id")
        return self.content.groupBy("digest").agg(F.when(keep != _LOWEST, keep).alias("keep"), F.sum("rows").alias("rows"))


def _rows(df: DataFrame, buckets: int, sign: int = 1) -> DataFrame:
    own = df.select(_digest(), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"))
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return own.select(bucket.alias("bucket"), "digest", "id").groupBy("bucket", "digest", "id").agg((F.count(F.lit(1)) * sign).alias("rows"))


def _keys(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).drop_null().combine_chunks()
    return _digests_of(column)[:, 0] if len(column) else np.zeros(0, np.uint64)


def _first(table: pa.Table, name: str) -> bytes | None:
    return table.column(name)[0].as_py() if table.num_rows else None


def _slots(bucket: int, filter_: CuckooFilter | None) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "slots": pa.array([filter_ and filter_.table.tobytes()], pa.binary())})


def _filled(table: pa.Table) -> pa.Table:
    keys = _keys(table, "digest")
    filter_ = CuckooFilter(len(keys))
    if not filter_.insert(keys):
        filter_.refill(keys)
    return _slots(table.column("bucket")[0].as_py(), filter_)


def _filters(content: DataFrame) -> DataFrame:
    each = content.select("bucket", "digest").distinct()
    return written(each.groupBy("bucket").applyInArrow(_filled, "bucket int, slots binary"), "filters")


def _changed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket's filter after digests come and go; without slots if it overflows."""
    filter_ = CuckooFilter.of(_first(left, "slots"))
    bucket = (left if left.num_rows else right).column("bucket")[0].as_py()
    filter_.delete(_keys(right, "gone"))
    return _slots(bucket, filter_ if filter_.insert(_keys(right, "new")) else None)


def _hits(left: pa.Table, right: pa.Table) -> pa.Table:
    """The digests that a bucket's filter may hold."""
    if not left.num_rows or not right.num_rows:
        return right.slice(0, 0)
    return right.filter(pa.array(CuckooFilter.of(_first(left, "slots")).contains(_keys(right, "digest"))))


def build_index(df: DataFrame) -> StoredIndex:
    """The index of the rows of ``df`` (doc_id, text)."""
    buckets = parts_for(df, ROWS_EACH)
    content = written(_rows(df, buckets), "content")
    return StoredIndex(content, _filters(content), buckets)


def stored_digests(index: StoredIndex, digests: DataFrame) -> DataFrame:
    """Those of the distinct (bucket, digest) that the index holds: the filters' hits, verified against the content."""
    hits = index.filters.groupBy("bucket").cogroup(digests.groupBy("bucket")).applyInArrow(_hits, "bucket int, digest binary")
    return hits.join(index.content.select("bucket", "digest"), ["bucket", "digest"], "left_semi")


def update_index(index: StoredIndex, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> StoredIndex:
    """The index after rows (doc_id, text) come and go."""
    moves = [_rows(df, index.buckets, sign) for df, sign in ((inserts, 1), (deletes, -1)) if df is not None]
    content = index.content
    for m in moves:
        content = content.unionByName(m)
    live = content.groupBy("bucket", "digest", "id").agg(F.sum("rows").alias("rows")).where("rows > 0")
    live = written(live, "content")
    if not moves:
        return index
    touched = moves[0].unionByName(moves[-1]).select("bucket", "digest").distinct()
    before = stored_digests(index, touched).withColumn("was", F.lit(True))
    after = touched.join(live.select("bucket", "digest"), ["bucket", "digest"], "left_semi").withColumn("is", F.lit(True))
    told = touched.join(before, ["bucket", "digest"], "left").join(after, ["bucket", "digest"], "left")
    told = told.select("bucket", F.when(F.col("is") & F.col("was").isNull(), F.col("digest")).alias("new"), F.when(F.col("was") & F.col("is").isNull(), F.col("digest")).alias("gone"))
    filters = written(index.filters.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_changed, "bucket int, slots binary"), "filters")
    full = filters.where("slots IS NULL").select("bucket")
    again = _filters(live.join(full, "bucket", "left_semi"))
    return StoredIndex(live, filters.where("slots IS NOT NULL").unionByName(again), index.buckets)
