"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

A window has as many words as the item it is held against (a shorter document is one window).  Words are lower-cased (A-Z);
the shingles of five words of a window or item make a weighted set, the weights being how often each occurs.

* Only windows that hold at least one shingle of an item of their size are fingerprinted: others have similarity 0.
* A fingerprint is the sign of the sum of the shingles' 64 hash bits, weighed by the square roots of their weights; sliding sums give those of all windows
  in which no shingle repeats.  With square roots the cosine of two bags of similarity 0.8 is at least 0.88, whatever the weights.
* The index cuts fingerprints into 8 blocks of 8 bits.  Two fingerprints at most RADIUS = 23 bits apart agree up to 2 bits in some block,
  so listing each item under every block value at most 2 bits from its own finds all of them, for sure.
* Candidates within the radius are verified by weighted Jaccard similarity, at least 0.8.  At 0.8 fingerprints
  differ in about 10 bits (standard deviation 3), so the radius leaves more than four deviations.

The benchmark is small by nature; its size is checked before it is broadcast, and a larger one is dealt into blocks of at most ``BLOCK_BYTES`` by hash, each
held against all documents.  For each block the documents are read in one pass without an exchange.  Edge cases: null and empty texts and items match nothing; items of one to four words are one
shingle, their whole sequence; repeated items and rows give a row each; an empty table on either side gives an empty result;
columns beside doc_id, item_id and text are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Words, chunks, grams, mix, row_chunks

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 23, 8
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 64 << 20
_BITS = np.arange(64, dtype=np.uint64)


def _signs(g: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    return (((mix(g)[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int32)


def _packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def simhash(g: np.ndarray) -> np.uint64:
    """SimHash of one bag of shingles, each weighed by the square root of how often it occurs."""
    each, n = np.unique(g, return_counts=True)
    return _packed((np.sqrt(n) @ _signs(each))[None])[0]


def simhashes(g: np.ndarray, k: int) -> np.ndarray:
    """SimHash of g[i : i + k] for each i: sliding sums, but for windows that hold a shingle twice."""
    total = np.zeros((len(g) + 1, 64), np.int32)
    np.cumsum(_signs(g), axis=0, out=total[1:])
    out = _packed(total[k:] - total[:-k])
    order = np.argsort(g, kind="stable")
    same = np.flatnonzero(g[order[1:]] == g[order[:-1]])
    first, again = order[same], order[same + 1]
    close = again - first < k
    if close.any():
        twice = np.zeros(len(out) + 1, np.int64)
        np.add.at(twice, np.maximum(again[close] - k + 1, 0), 1)
        np.add.at(twice, np.minimum(first[close] + 1, len(out)), -1)
        for i in np.flatnonzero(np.cumsum(twice)[:-1] > 0).tolist():
            out[i] = simhash(g[i : i + k])
    return out


class BlockIndex:
    """Fingerprints found by any block that is at most radius // blocks bits off."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.blocks = prints, radius, blocks
        self.bits = 64 // blocks
        near = [sum(1 << b for b in c) for r in range(radius // blocks + 1) for c in combinations(range(self.bits), r)]
        self.lists: list[list[list[int]]] = []
        for b in range(blocks):
            own: list[list[int]] = [[] for _ in range(1 << self.bits)]
            for k, p in enumerate(self.block(prints, b).tolist()):
                for x in near:
                    own[p ^ x].append(k)
            self.lists.append(own)

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def within(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, stored, distance) of all that are at most radius apart."""
        found = [set() for _ in range(len(prints))]
        for b in range(self.blocks):
            for q, v in enumerate(self.block(prints, b).tolist()):
                found[q].update(self.lists[b][v])
        pairs = [(q, k) for q, ks in enumerate(found) for k in sorted(ks)]
        if not pairs:
            return []
        q, k = np.array(pairs).T
        apart = np.bitwise_count(prints[q] ^ self.prints[k]).tolist()
        return [(a, b, d) for (a, b), d in zip(pairs, apart, strict=True) if d <= self.radius]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


class Benchmark:
    """The items by size in words, with their shingles, an inverted shingle map and a block index for each size."""

    def __init__(self, items: list[tuple[int, str]]):
        w = Words(pa.array([t or "" for _, t in items], pa.large_string()), lower=True)
        h = w.hashes()
        self.ids = [i for i, _ in items]
        self.bags: list[Counter] = []
        self.sizes: dict[int, list[int]] = defaultdict(list)
        self.holders: dict[int, set[int]] = defaultdict(set)  # a shingle, and the sizes of the items that have it
        prints = []
        for k, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
            g = grams(h[a:b], min(SHINGLE, b - a)) if b > a else h[:0]
            self.bags.append(Counter(g.tolist()))
            prints.append(simhash(g) if b > a else np.uint64(0))
            if b > a:
                self.sizes[b - a].append(k)
                for x in self.bags[-1]:
                    self.holders[x].add(b - a)
        prints = np.array(prints, np.uint64)
        self.index = {n: BlockIndex(prints[own]) for n, own in self.sizes.items()}
        self.all = np.sort(np.fromiter(self.holders, np.uint64, len(self.holders)))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.all >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        at = np.flatnonzero(self.seen[(g >> np.uint64(44)).astype(np.int64)])
        return at[np.isin(g[at], self.all)]

    def matches(self, h: np.ndarray, g: dict[int, np.ndarray], where: dict[int, np.ndarray], least: float) -> Iterator[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, distance) of the best window for each item, in one document.

        g and where: the document's shingles of k words, and the places of those that some item has.
        """
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, places in where.items():
            for p in places.tolist():
                for n in self.holders[int(g[k][p])]:
                    if min(n, SHINGLE) == k:
                        spans[n].append((max(0, p - (n - k)), p))
        for n, found in spans.items():
            k = min(n, SHINGLE)
            size = min(n, len(h))
            width = size - k + 1
            starts = sorted({s for lo, hi in found for s in range(lo, min(hi, len(h) - size) + 1)}) or [0]
            best: dict[int, tuple[float, int, int]] = {}
            begin = 0
            while begin < len(starts):  # runs of consecutive windows
                end = begin + 1
                while end < len(starts) and starts[end] == starts[end - 1] + 1:
                    end += 1
                first = starts[begin]
                own = g[k][first : starts[end - 1] + width]
                for q, item, apart in self.index[n].within(simhashes(own, width)):
                    item = self.sizes[n][item]
                    s = weighted_jaccard(Counter(own[q : q + width].tolist()), self.bags[item])
                    if s >= least and (item not in best or s > best[item][0]):
                        best[item] = s, first + q, apart
                begin = end
            for item, (s, first, apart) in best.items():
                yield item, first, size, s, apart


_FOUND = "doc_id long, item_id long, start long, n_words long, similarity double, distance int"


def _blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The benchmark in parts of a bounded size, each sent to the executors."""
    own = items.select("item_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size"))
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = -(-total // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))).cast("int")
    if parts > 1:  # parts that chance makes larger are dealt anew
        parts = _enough(own, parts)
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")
    for k in range(parts):
        rows = [(r[0], r[1]) for r in own.where(part == k).select("item_id", "text").collect()]
        yield items.sparkSession.sparkContext.broadcast(Benchmark(rows))


def _enough(own: DataFrame, parts: int) -> int:
    """So many parts that none has more than BLOCK_BYTES, but for items that repeat or are longer."""
    each = own.select(F.xxhash64("item_id", "text").alias("h"), "size").dropDuplicates(["h"]).where(f"size < {BLOCK_BYTES // 4}")
    while True:
        most = each.groupBy(F.pmod("h", F.lit(parts))).agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0]
        if (most or 0) <= BLOCK_BYTES:
            return parts
        parts += -(-parts // 4)


def _matches(bench: Benchmark, texts: pa.Array, least: float) -> Iterator[tuple]:
    """(place of the text, item, first word, words, similarity, distance) in a run of texts."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = {k: grams(h, k) for k in sorted({min(n, SHINGLE) for n in bench.sizes})}
    hits = {k: bench.hits(x) for k, x in g.items()}
    docs = np.unique(np.searchsorted(w.at, np.concatenate([*hits.values(), np.zeros(0, np.int64)]), "right") - 1)
    for d in docs.tolist():
        lo, hi = int(w.at[d]), int(w.at[d + 1])
        own = {k: x[lo : max(lo, hi - k + 1)] for k, x in g.items()}
        where = {k: x[(x >= lo) & (x <= hi - k)] - lo for k, x in hits.items()}
        for m in bench.matches(h[lo:hi], own, where, least):
            yield d, *m


def decontaminated(df: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` (text, ...) without any matching window, in one pass for each block of the benchmark."""
    packed = df.select(F.struct(*df.columns).alias("row"))

    def without(sent: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in row_chunks(b):
                    clean = np.ones(c.num_rows, bool)
                    clean[[m[0] for m in _matches(sent.value, c.column("text"), similarity)]] = False
                    yield c.select(["row"]).filter(pa.array(clean))

        return run

    for sent in _blocks(items):
        packed = packed.mapInArrow(without(sent), packed.schema)
    return packed.select("row.*")


def contaminated(df: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance): the best window of each document and item that match."""
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def found(sent: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in chunks(b):
                    ids, bench = c.column("doc_id").to_pylist(), sent.value
                    out = [(ids[m[0]], bench.ids[m[1]], *m[2:4], round(m[4], 6), m[5]) for m in _matches(bench, c.column("text"), similarity)]
                    cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start", "n_words", "similarity", "distance"])

        return run

    parts = [own.mapInArrow(found(sent), _FOUND) for sent in _blocks(items)]
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], _FOUND)
