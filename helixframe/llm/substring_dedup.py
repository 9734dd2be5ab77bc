"""Substring deduplication by recompression of word sequences.

Words become symbols, and rounds rename them as recompression does: first maximal runs of one word become one symbol, then
in each round the symbols are parted into left and right ones and every left symbol takes in a right one
after it.  A name is a 64-bit hash of what it stands for, so it is the same in every task and needs no exchange.
Equal substrings get equal interior symbols: whether two neighbours merge depends on them alone, so only symbols at the rims can
differ.  ``zones`` follows, for each window of ``window`` words, the symbols that are the same wherever the window
stands; the longest of them (leftmost of equal ones) is the window's *anchor*.  A window is anchored at the highest level that leaves it a symbol;
windows inside one long run stand for themselves.

1. All documents post their anchors' occurrences; only anchors that occur at least twice can hold equal windows.
2. Documents with such anchors get 128-bit hashes of those windows, from two independent hashes of each word.  Each chunk of documents settles its own
   repeats, and sends one entry for each distinct window to the window's bucket, where the first place in the corpus stays.  Windows on very frequent anchors
   (a passage that a third of all documents share) are settled in salted parts first, so that a bucket gets a few entries of each.
3. Each document takes out the words that windows with an earlier copy cover.

"Earlier" is a smaller id, or an earlier start in one document.  Edge cases: null text has no words; texts shorter than a window stay
whole; a null id sorts last; rows that repeat an id are judged as one document, so equal ones
stay or go alike; an empty table gives an empty result; other columns are not needed and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import CHUNK_BYTES, NULL_ID, Words, chunks, grams, ids_of, mix, ragged, written

WINDOW = 20
ROUNDS = 4
#: Pending windows of one bucket.
BUCKET = 1_000_000
#: Windows on anchors that occur more often than this are settled in SALTS parts first.
HOT, SALTS = 1_000, 16
_C = np.uint64(0x9FB21C651E98DF25)
_MASK = (1 << 64) - 1


def recompressed(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """For each level (symbols, first words, right-hand flags, place of each symbol of the level below).

    The flags say which symbols the next round may merge into their left neighbour.
    """
    n = len(h)
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    pos = np.flatnonzero(fresh)
    length = np.diff(np.append(pos, n)).astype(np.uint64)
    sym = np.where(length > 1, mix(h[pos] + length * _C), h[pos])
    place = np.cumsum(fresh) - 1
    levels = []
    for r in range(rounds + 1):
        right = (mix(sym + np.uint64((r + 1) * int(_C) & _MASK)) >> np.uint64(63)).astype(bool)
        levels.append((sym, pos, right, place))
        if r == rounds:
            break
        taken = np.zeros(len(sym), bool)
        taken[1:] = ~right[:-1] & right[1:] & (doc[pos[1:]] == doc[pos[:-1]])
        head = np.zeros(len(sym), bool)
        head[:-1] = taken[1:]
        merged = sym.copy()
        at = np.flatnonzero(head)
        merged[at] = mix(sym[at] * _C + mix(sym[at + 1] + np.uint64(r)))
        place = np.cumsum(~taken) - 1
        sym, pos = merged[~taken], pos[~taken]
    return levels


def _leftmost_least(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the leftmost smallest q in [lo, hi), by doubling."""
    out = np.empty(len(lo), np.int64)
    width = hi - lo
    best, k = np.arange(len(q)), 0
    while True:
        span = 1 << k
        mine = np.flatnonzero((width >= span) & (width < 2 * span))
        a, b = best[lo[mine]], best[hi[mine] - span]
        out[mine] = np.where(q[a] <= q[b], a, b)
        if not (width >= 2 * span).any():
            return out
        a, b = best[: len(best) - span], best[span:]
        best = np.where(q[a] <= q[b], a, b)
        k += 1


def anchors(h: np.ndarray, at: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of windows, anchor of each, a number for the anchor's occurrence)."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(at[1:], n))
    name, place = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    if not len(start):
        return start, name, place
    levels = recompressed(h, doc, rounds)
    own = levels[0][3]
    lo, hi = own[start] + 1, own[start + window - 1]  # the runs at both rims may go on outside
    live = np.arange(len(start))
    empty = lo >= hi
    whole = live[empty]
    name[whole], place[whole] = mix(grams(h, window)[start[whole]] + _C), start[whole]
    live, lo, hi = live[~empty], lo[~empty], hi[~empty]
    for r, (sym, pos, right, _) in enumerate(levels):
        if r < rounds:
            low = lo + right[lo]
            high = hi - ~right[hi - 1]
            done = low >= high
        else:
            done = np.ones(len(live), bool)
        if done.any():
            length = np.minimum(np.diff(np.append(pos, len(h))), 63).astype(np.uint64)
            q = ((np.uint64(63) - length) << np.uint64(58)) | (sym >> np.uint64(6))
            best = _leftmost_least(q, lo[done], hi[done])
            name[live[done]], place[live[done]] = mix(sym[best] + np.uint64(r)), pos[best]
        if r < rounds:
            up = levels[r + 1][3]
            live, lo, hi = live[~done], up[low[~done]], up[high[~done] - 1] + 1
    return start, name, place


def _sha(parts: list[bytes]) -> str:
    return sha256(b" ".join(parts)).hexdigest()


_POSTED = "doc_id long, n_words long, whole_sha256 string, anchors array<long>"


def _post(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                w = Words(c.column("text"))
                start, name, place = anchors(w.hashes(), w.at, window, rounds)
                first = np.ones(len(start), bool)
                first[1:] = (place[1:] != place[:-1]) | (name[1:] != name[:-1])
                start, name, place = start[first], name[first], place[first]
                _, one = np.unique(np.stack([place.astype(np.uint64), name], 1), axis=0, return_index=True) if len(start) else (None, np.zeros(0, np.int64))
                one = np.sort(one)
                ends = np.searchsorted(start[one], w.at)
                data = w.data.tobytes()
                sha = [_sha(data[a:z].split()) for a, z in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(c.column("doc_id"))), pa.array(w.counts().astype(np.int64)), pa.array(sha), ragged(name[one].view(np.int64), ends, pa.int64())], ["doc_id", "n_words", "whole_sha256", "anchors"])

    return run


_PENDING = "doc_id long, packed binary, gone binary, starts binary, hot_starts binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd: what is exchanged twice from here on."""
    pack = zstandard.ZstdCompressor(3).compress
    for b in batches:
        for c in chunks(b):
            text = c.column("text").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([c.column("id"), pa.array([pack(x.as_buffer()) for x in text], pa.binary())], ["id", "packed"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``chunks`` of a batch with packed texts, which stay beside the texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    total = np.cumsum(np.asarray(pc.binary_length(batch.column("packed")), np.int64))
    part = np.append(0, total[:-1]) // CHUNK_BYTES
    for begin, n in zip(*np.unique(part, return_index=True, return_counts=True)[1:], strict=True):
        c = batch.slice(int(begin), int(n))
        text = pa.array([unpack(x) for x in c.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())
        yield from chunks(c.append_column("text", text))


def _settle(window: int, rounds: int):
    """Windows on repeated anchors: repeats inside the chunk are settled, the first ones stay pending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _unpacked(b):
                w = Words(c.column("text"))
                h = w.hashes()
                start, name, _ = anchors(h, w.at, window, rounds)
                ids = ids_of(c.column("id"))
                doc = np.searchsorted(w.at, start, "right") - 1
                repeated = c.column("repeated")
                flat = np.asarray(repeated.flatten()).astype(np.int64).view(np.uint64)
                size = np.asarray(repeated.value_lengths())
                owner = np.repeat(np.arange(len(size)), size).astype(np.uint64)
                pick = np.isin(mix(name) ^ mix(doc.astype(np.uint64) + _C), mix(flat) ^ mix(owner + _C))
                start, doc = start[pick], doc[pick]
                often = np.isin(name[pick], np.asarray(c.column("hot").flatten()).astype(np.int64).view(np.uint64))
                g, check = grams(h, window)[start], grams(w.hashes(1), window)[start]
                begin = start - w.at[doc]
                order = np.lexsort((begin, ids[doc], check, g))
                g, check, doc, begin, often = g[order], check[order], doc[order], begin[order], often[order]
                same = np.zeros(len(g), bool)
                same[1:] = (g[1:] == g[:-1]) & (check[1:] == check[:-1])
                # rows that repeat an id have their windows in one place: those stay pending together
                twin = np.zeros(len(g), bool)
                twin[1:] = same[1:] & (ids[doc[1:]] == ids[doc[:-1]]) & (begin[1:] == begin[:-1])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
                gone = same & ~((ids[doc] == ids[doc[lead]]) & (begin == begin[lead])) if len(g) else same

                begin = begin.astype(np.int32)

                def lists(mask: np.ndarray) -> list[pa.Array]:
                    at = np.flatnonzero(mask)
                    at = at[np.lexsort((begin[at], doc[at]))]
                    cut = np.searchsorted(doc[at], np.arange(len(ids) + 1))
                    return [pa.array([begin[at[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())]

                yield pa.RecordBatch.from_arrays([pa.array(ids), c.column("packed"), *lists(gone), *lists(~gone & ~often), *lists(~gone & often)], ["doc_id", "packed", "gone", "starts", "hot_starts"])

    return run


_ENTRIES = "bucket long, ids binary, hashes binary, checks binary, starts binary"
_TYPES = {"ids": np.int64, "hashes": np.uint64, "checks": np.uint64, "starts": np.int32}


def _deal(buckets: int, window: int, salts: int = 1):
    """Entries of the pending windows; their hashes are made again from the text, which is less than to keep them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _unpacked(b):
                w = Words(c.column("text"))
                starts = c.column("starts").to_pylist()
                size = [len(x) // 4 for x in starts]
                begin = np.frombuffer(b"".join(starts), np.int32)
                at = np.repeat(w.at[:-1], size) + begin
                ids = np.asarray(c.column("doc_id"))
                got = {"ids": np.repeat(ids, size), "hashes": grams(w.hashes(), window)[at], "checks": grams(w.hashes(1), window)[at], "starts": begin}
                salt = int(mix(ids[:1].view(np.uint64))[0] % np.uint64(salts))
                yield _entries(got, (got["hashes"] % np.uint64(buckets)).astype(np.int64) * salts + salt)

    return run


def _entries(got: dict[str, np.ndarray], to: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket."""
    order = np.argsort(to, kind="stable")
    which, first = np.unique(to[order], return_index=True)
    ends = np.append(first, len(order))[1:]
    cols = [pa.array([got[k][order[i:j]].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for k in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(which), *cols], ["bucket", *_TYPES])


def _settled(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """All entries of a task's buckets, equal windows next to each other and the first place first; and which aren't the first."""
    held: dict[str, list[bytes]] = {k: [] for k in _TYPES}
    for b in batches:
        for k in _TYPES:
            held[k] += b.column(k).to_pylist()
    got = {k: np.frombuffer(b"".join(held.pop(k)), t) for k, t in _TYPES.items()}
    order = np.lexsort((got["starts"], got["ids"], got["checks"], got["hashes"]))
    if not len(order):
        return None
    got = {k: x[order] for k, x in got.items()}
    i, g, c, s = got.values()
    same = np.zeros(len(i), bool)
    same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(i))))
    return got, same & ~((i == i[lead]) & (s == s[lead]))


def _by_document(i: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, more): the starts of each document."""
    order = np.argsort(i, kind="stable")
    i, s = i[order], s[order]
    who, begin = np.unique(i, return_index=True)
    ends = np.append(begin, len(i))[1:]
    for k in range(0, len(who), 10_000):
        cols = [s[a:z].tobytes() for a, z in zip(begin[k : k + 10_000], ends[k : k + 10_000], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(who[k : k + 10_000]), pa.array(cols, pa.binary())], ["doc_id", "more"])


def _first_stays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with an earlier equal one, by document."""
    if found := _settled(batches):
        got, gone = found
        yield from _by_document(got["ids"][gone], got["starts"][gone])


def _first_of_part(buckets: int):
    """The same of a salted part; its first windows go on as entries of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _settled(batches):
            got, gone = found
            schema = pa.schema([("doc_id", pa.int64()), ("more", pa.binary()), ("bucket", pa.int64()), *[(k, pa.binary()) for k in _TYPES]])
            none = lambda b, k: pa.nulls(b.num_rows, schema.field(k).type)
            stay = {k: x[~gone] for k, x in got.items()}
            entries = _entries(stay, (stay["hashes"] % np.uint64(buckets)).astype(np.int64))
            for b in (*_by_document(got["ids"][gone], got["starts"][gone]), entries):
                yield pa.RecordBatch.from_arrays([b.column(k) if k in b.schema.names else none(b, k) for k in schema.names], schema=schema)

    return run


_CLEANED = "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string, kept_text string"


def _clean(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k in range(0, b.num_rows, 500):
                c, out = b.slice(k, 500), []
                for text, gone, more in zip(c.column("packed").to_pylist(), c.column("gone").to_pylist(), c.column("more").to_pylist(), strict=True):
                    words = unpack(text).split()
                    begin = np.frombuffer(gone + b"".join(more or []), np.int32)
                    begin = begin[begin <= len(words) - window]  # an id may stand for texts of other lengths
                    cover = np.zeros(len(words) + window + 1, np.int32)
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + window, -1)
                    keep = np.cumsum(cover)[: len(words)] == 0
                    kept = list(compress(words, keep.tolist()))
                    out.append((_sha(words), len(words) - len(kept), _sha(kept), b" ".join(kept).decode() if keep_text else None))
                cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), *cols], ["doc_id", "whole_sha256", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(df: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``df`` (doc_id, text, ...).

    With ``keep_text`` also kept_text: the kept words joined by one space, null where nothing was removed.
    """
    if window <= 2 << (rounds - 1):
        raise ValueError("too many rounds for this window")
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    posted = written(own.mapInArrow(_post(window, rounds), _POSTED), "anchors")
    each = posted.select("doc_id", F.explode("anchors").alias("anchor"))
    # written, so that the join below it reads two plain exchanges, and a hot anchor can be split
    twice = written(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    hot = F.collect_set(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot")
    hit = each.join(twice, "anchor").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("anchor").alias("repeated"), hot)
    packed = own.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text").mapInArrow(_pack, "id long, packed binary")
    some = packed.join(hit, "id")
    settled = written(some.mapInArrow(_settle(window, rounds), _PENDING), "settled")
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    total, often = (n // 4 for n in settled.agg(size("starts"), size("hot_starts")).first())
    buckets = max(1, -(-(total + often) // BUCKET))
    entries = settled.select("doc_id", "packed", "starts").mapInArrow(_deal(buckets, window), _ENTRIES)
    gone = None
    if often:
        parts = settled.where(F.octet_length("hot_starts") > 0).select("doc_id", "packed", F.col("hot_starts").alias("starts")).mapInArrow(_deal(buckets, window, SALTS), _ENTRIES)
        parts = written(parts.repartition(buckets * SALTS, "bucket").mapInArrow(_first_of_part(buckets), f"doc_id long, more binary, {_ENTRIES}"), "parts")
        gone = parts.where("doc_id IS NOT NULL").select("doc_id", "more")
        entries = entries.unionByName(parts.where("doc_id IS NULL").select("bucket", *_TYPES))
    later = entries.repartition(buckets, "bucket").mapInArrow(_first_stays, "doc_id long, more binary")
    later = later.unionByName(gone) if gone is not None else later
    later = later.groupBy("doc_id").agg(F.collect_list("more").alias("more"))
    cleaned = settled.select("doc_id", "packed", "gone").join(later, "doc_id", "left").mapInArrow(_clean(window, keep_text), _CLEANED)
    cleaned = cleaned.dropDuplicates(["doc_id", "whole_sha256"])
    out = posted.drop("anchors").join(cleaned, ["doc_id", "whole_sha256"], "left")
    extra = ["kept_text"] if keep_text else []
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), *extra)
