"""Line deduplication by content-defined chunks of lines, and by pairs of lines where chunks can't tell.

A *line* is what stands between ``\\n``; blank ones (white space only) belong to no window.  Each two lines in a row that aren't blank, with the blank ones between,
are a *window*.  Of windows with equal bytes the first one (smallest id, hash of the text, place) stays, and a line goes if it
stands in a window that isn't the first.  So every passage of two lines or more that occurs again goes, and every line that goes has an equal one that stays.

1. A hash rolling over the hashes of the last ``ROLL`` lines ends a chunk where it is 0 modulo ``EVERY``, once the chunk has ``LEAST`` lines; nothing else
   ends one.  Boundaries depend on nearby lines only, so inserted or removed lines shift no chunk beyond the next boundary.
   Chunks are counted over the corpus by 128-bit hash; copies of an earlier chunk go whole, and their windows aren't looked at again.
2. Passages whose edges aren't chunk boundaries share no chunk.  So the windows outside of those copies are counted in the same way.  (A window inside a later
   copy of a chunk has an equal one in the first copy, so leaving it out changes no first window.)
   Those that follow each other both here and at their first place make one run.
3. The bytes of every chunk and run are compared with those at its first place before it goes.

Only hashes and places are exchanged at first; text moves for documents with repeated passages alone.  Edge cases: null
text is the empty text, one line; a null id sorts last; rows that repeat an id and text count as one document and keep or lose lines
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import NULL_ID, chunks, written

ROLL, EVERY, LEAST = 2, 4, 2
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def full_lines(data: bytes) -> list[tuple[int, int, int]]:
    """(first byte, end, number) of each line that isn't blank."""
    out, at = [], 0
    for k, line in enumerate(data.split(b"\n")):
        if line.strip():
            out.append((at, at + len(line), k))
        at += len(line) + 1
    return out


def line_chunks(data: bytes, full: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(first, end) of each chunk, in numbers of lines that aren't blank."""
    out, begin, rolled = [], 0, [0] * ROLL
    for k, (a, z, _) in enumerate(full):
        rolled = [*rolled[1:], xxhash.xxh3_64_intdigest(data[a:z])]
        value = 0
        for x in rolled:
            value = (value * _BASE + x) & _MASK
        if k + 1 == len(full) or (k + 1 - begin >= LEAST and (value >> 20) % EVERY == 0):
            out.append((begin, k + 1))
            begin = k + 1
    return out


_WINDOW = pa.struct([("place", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _lists(rows: list[list[tuple[int, int, bytes]]]) -> pa.Array:
    """Lists of (place, windows, 128-bit hash)."""
    flat = [x for own in rows for x in own]
    h = np.frombuffer(b"".join(x[2] for x in flat), ">i8").astype(np.int64).reshape(-1, 2)
    columns = [pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)] + [pa.array(h[:, 0]), pa.array(h[:, 1])]
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_WINDOW)))


_POSTED = "id long, mark long, whole_sha256 string, n_lines long, chunks array<struct<place:int,n:int,h1:long,h2:long>>, windows array<struct<place:int,n:int,h1:long,h2:long>>"


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b):
            sha, lines, cut, windows = [], [], [], []
            for text in c.column("text").to_pylist():
                data = text.encode()
                full = full_lines(data)
                sha.append(sha256(data).hexdigest())
                lines.append(data.count(b"\n") + 1)
                print_ = lambda a, z: xxhash.xxh3_128_digest(data[full[a][0] : full[z][1]])  # noqa: B023, E731
                cut.append([(a, z - a - 1, print_(a, z - 1)) for a, z in line_chunks(data, full) if z - a > 1])
                windows.append([(k, 1, print_(k, k + 1)) for k in range(len(full) - 1)])
            yield pa.RecordBatch.from_arrays([c.column("id"), c.column("mark"), pa.array(sha), pa.array(lines, pa.int64()), _lists(cut), _lists(windows)], ["id", "mark", "whole_sha256", "n_lines", "chunks", "windows"])


def _later(each: DataFrame, name: str) -> DataFrame:
    """Of (id, mark, place, n, h1, h2): those with an equal one before them, and where the first one stands."""
    firsts = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("all"), F.min(F.struct("id", "mark", "place")).alias("first")).where("all > 1").drop("all")
    # written, so that the join below it reads two plain exchanges, and a hot hash can be split
    again = each.join(written(firsts, name), ["h1", "h2"]).where(F.col("first") != F.struct("id", "mark", "place"))
    return again.select("id", "mark", "place", "n", F.col("first.id").alias("f_id"), F.col("first.mark").alias("f_mark"), F.col("first.place").alias("f_place"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that follow each other here and at their first place, as one run of ``n`` windows."""
    names = ["id", "mark", "place", "n", "f_id", "f_mark", "f_place"]
    for b in batches:
        out: list[list] = []
        for i, mark, hits in zip(*(b.column(c).to_pylist() for c in ("id", "mark", "hits")), strict=True):
            last = None
            for h in sorted(hits, key=lambda h: h["place"]):
                k, first = h["place"], (h["f_id"], h["f_mark"], h["f_place"])
                if last and k == last[2] + last[3] and first == (last[4], last[5], last[6] + last[3]):
                    last[3] += 1
                else:
                    last = [i, mark, k, 1, *first]
                    out.append(last)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)


def _run_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b):
            out: list[tuple] = []
            for i, mark, text, runs in zip(*(c.column(x).to_pylist() for x in ("id", "mark", "text", "runs")), strict=True):
                data = text.encode()
                full = full_lines(data)
                out += [(i, mark, r["f_place"], r["n"], data[full[r["f_place"]][0] : full[r["f_place"] + r["n"]][1]]) for r in runs]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["f_id", "f_mark", "f_place", "n", "first_bytes"])


def _drop_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b):
            sha, removed, kept = [], [], []
            for text, runs in zip(c.column("text").to_pylist(), c.column("runs").to_pylist(), strict=True):
                data = text.encode()
                full, gone = full_lines(data), set()
                for r in runs:
                    (a, _, first), (_, z, last) = full[r["place"]], full[r["place"] + r["n"]]
                    if data[a:z] == r["first_bytes"]:
                        gone.update(range(first, last + 1))
                out = b"\n".join(x for k, x in enumerate(data.split(b"\n")) if k not in gone)
                sha.append(sha256(out).hexdigest())
                removed.append(len(gone))
                kept.append(out.decode() if gone else None)
            yield pa.RecordBatch.from_arrays([c.column("id"), c.column("mark"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["id", "mark", "n_removed", "kept_sha256", "kept_text"])


def line_dedup(df: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each row of ``df`` (doc_id, text, ...).

    With ``keep_text`` also kept_text, null where nothing was removed.
    """
    text = F.coalesce("text", F.lit(""))
    own = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    posted = written(own.mapInArrow(_post, _POSTED), "lines")
    each = lambda df, c: df.select("id", "mark", F.explode(c).alias("w")).select("id", "mark", "w.*")
    copies = written(_later(each(posted, "chunks"), "chunks").distinct(), "copies")
    spans = copies.groupBy("id", "mark").agg(F.collect_set(F.struct("place", "n")).alias("spans"))
    inside = lambda w: F.exists("spans", lambda s: (w["place"] >= s["place"]) & (w["place"] < s["place"] + s["n"]))
    rest = F.when(F.col("spans").isNull(), F.col("windows")).otherwise(F.filter("windows", lambda w: ~inside(w)))
    outside = posted.select("id", "mark", "windows").join(spans, ["id", "mark"], "left").select("id", "mark", rest.alias("windows"))
    hits = _later(each(outside, "windows"), "windows").groupBy("id", "mark").agg(F.collect_set(F.struct("place", "f_id", "f_mark", "f_place")).alias("hits"))
    fields = "id long, mark long, place int, n int, f_id long, f_mark long, f_place int"
    runs = copies.unionByName(written(hits.mapInArrow(_runs, fields), "runs"))
    wanted = runs.groupBy(F.col("f_id").alias("id"), F.col("f_mark").alias("mark")).agg(F.collect_set(F.struct("f_place", "n")).alias("runs"))
    once = lambda lists: own.join(lists, ["id", "mark"]).dropDuplicates(["id", "mark"])
    pieces = written(once(wanted).mapInArrow(_run_bytes, "f_id long, f_mark long, f_place int, n int, first_bytes binary"), "pieces")
    told = runs.join(pieces, ["f_id", "f_mark", "f_place", "n"])
    told = told.groupBy("id", "mark").agg(F.collect_list(F.struct("place", "n", "first_bytes")).alias("runs"))
    cleaned = once(told).mapInArrow(_drop_runs, "id long, mark long, n_removed long, kept_sha256 string, kept_text string")
    out = posted.drop("chunks", "windows").join(cleaned if keep_text else cleaned.drop("kept_text"), ["id", "mark"], "left")
    extra = ["kept_text"] if keep_text else []
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), *extra)
