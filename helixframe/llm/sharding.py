"""Sharding along a Hilbert curve: rows are sorted by the curve index of their quantised metadata and cut into runs.

Each dimension is turned into an order-keeping integer (strings by the seven bytes after what all of them begin with) and quantised at its
quantiles, so that cells hold about equally many rows; the index is computed with numpy.  Quantiles come from exact counts of all rows, by value where there
are few and else in bins (by the seven highest bits), so they don't depend on how the rows are dealt out, and reruns agree.  Rows of one
text share the cell of their smallest id and stand next to each other, so a cut parts at most one such group.  The
sort is a range exchange of the full key, whose last parts (text hash, id) split any hot cell; the numbered rows
are written to the shared folder once, and a run's place follows from the row counts of the parts before it.

Edge cases: null dimensions are quantised as the smallest; a null text has no bytes (size 1, checksum 0) and forms
one group with other nulls; repeated rows get a slot each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import numbered, written

BITS = 5
#: Distinct values of a dimension that are counted one by one; more are counted in bins.
BINS = 8_192


def hilbert_index(coords: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points with ``bits`` bits in each dimension (vectorised over the points)."""
    x = [np.asarray(c, np.int64).copy() for c in coords]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> b) & 1, flip ^ ((1 << b) - 1), flip)
    x = [c ^ flip for c in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | ((c >> b) & 1)
    return out


def ordinal(column: Column, kind: T.DataType, shared: int = 0) -> Column:
    """An order-keeping long: numbers as they are, strings by the seven bytes after the ``shared`` first ones; null is the smallest."""
    if isinstance(kind, T.StringType):
        rest = F.substring(F.encode(column, "UTF-8"), shared + 1, 7)
        value = F.conv(F.hex(F.rpad(rest, F.lit(7), F.lit(b"\0"))), 16, 10).cast("long")
    else:
        value = column.cast("long")
    return F.coalesce(value, F.lit(-(1 << 62)))


def _bin(value: Column) -> Column:
    """The value with all but the seven highest bits of its amount cleared: at most some 8,000 values, in order."""
    amount = F.abs(value)
    low = F.greatest(F.length(F.bin(amount)) - 7, F.lit(0))
    kept = F.call_function("shiftleft", F.call_function("shiftright", amount, low), low)
    return F.when(value < 0, -kept).otherwise(kept)


def quantile_edges(base: DataFrame, names: Sequence[str], bits: int) -> list[np.ndarray]:
    """For each column the values at which its cells begin: 2^bits cells of about equally many rows."""
    out = []
    for n in names:
        found = base.groupBy(F.col(n).alias("v")).count().limit(BINS + 1).collect()
        if len(found) > BINS:
            found = base.groupBy(_bin(F.col(n)).alias("v")).count().collect()
        counts = sorted((r[0], r[1]) for r in found)
        values, rows = np.array([v for v, _ in counts], np.int64), np.array([c for _, c in counts], np.int64)
        below = np.cumsum(rows) - rows
        total = int(rows.sum())
        at = np.searchsorted(below, [total * k / (1 << bits) for k in range(1, 1 << bits)]) if total else np.zeros(0, np.int64)
        out.append(np.unique(values[at[at < len(values)]]))
    return out


def _shared_bytes(df: DataFrame, dims: Sequence[str]) -> dict[str, int]:
    """How many bytes all values of a string column begin with: the smallest and the largest tell."""
    names = [d for d in dims if d in df.columns and isinstance(df.schema[d].dataType, T.StringType)]
    if not names:
        return {}
    ends = df.select(*[F.struct(F.min(d), F.max(d)).alias(d) for d in names]).first()
    return {d: len(commonprefix([(x or "").encode() for x in ends[d]])) for d in names}


def hilbert_shards(df: DataFrame, dims: Sequence[str] = ("source", "lang", "size"), shards: int = 8, bits: int = BITS, law: str = "rows", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (doc_id, text, ...) as a struct ``row`` with size, text_crc32, curve, shard and slot.

    law "rows": shard sizes are at most one row apart.  A dimension named size is the UTF-8 bytes of the text plus 1.
    keep: the columns of ``row``, doc_id among them (None: all); what isn't kept isn't exchanged.
    """
    if law != "rows":
        raise ValueError(f"unknown law {law!r}")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    shared = _shared_bytes(df, dims)
    own = lambda d: ordinal(size, T.LongType()) if d == "size" else ordinal(F.col(d), df.schema[d].dataType, shared.get(d, 0))
    base = df.select(
        F.struct(*(df.columns if keep is None else keep)).alias("row"),
        size.alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text", F.col("text").isNull()).alias("same"),
        *[own(d).alias(f"dim{k}") for k, d in enumerate(dims)],
    )
    names = [f"dim{k}" for k in range(len(dims))]
    edges = quantile_edges(base, names, bits)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [np.searchsorted(e, b.column(n).to_numpy(zero_copy_only=False), "right") for n, e in zip(names, edges, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("same"), pa.array(hilbert_index(cells, bits), pa.int64())], ["same", "curve"])

    first = base.groupBy("same").agg(F.min(F.struct("row.doc_id", *names)).alias("m")).select("same", *[F.col(f"m.{n}").alias(n) for n in names])
    curve = first.mapInArrow(index, "same long, curve long")
    # written, so that the join below it reads two plain exchanges, and a hot group can be split
    placed = base.drop(*names).join(written(curve, "curve"), "same")
    ranked, total = numbered(placed, [F.col("curve"), F.col("same"), F.col("row.doc_id")], "shards")
    each, more = divmod(total, shards)
    edge = more * (each + 1)  # the first `more` shards have one row more
    rank = F.col("rank")
    shard = F.when(rank < edge, F.expr(f"rank div {each + 1}")).otherwise(F.lit(more) + F.expr(f"(rank - {edge}) div {max(1, each)}"))
    head = F.when(F.col("shard") < more, F.col("shard") * (each + 1)).otherwise(F.lit(edge) + (F.col("shard") - more) * each)
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .select("row", "size", "text_crc32", "curve", "shard", (rank - head).cast("long").alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str, rows_each: int = 100_000) -> None:
    """Write ``row`` of what ``hilbert_shards`` gives, a folder for each shard, in the order of the curve.

    A file has at most ``rows_each`` rows, so the statistics of its columns span a small box of all dimensions, and readers skip what lies outside of a filter.
    """
    line = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    line.select("row.*", F.col("shard").alias("curve_shard")).write.partitionBy("curve_shard").option("maxRecordsPerFile", rows_each).option("compression", "zstd").parquet(path)
