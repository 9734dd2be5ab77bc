"""MinHash near-deduplication by a signature-coordinate inverted join.

A text's set is its distinct 5-word shingles (A-Z lower-cased), as 64-bit hashes.  Rows with equal sets are one node, named by their
smallest id; sets are equal if two prints of 64 bits from independent word hashes are.
Each node's signature has ``COORDS`` min-hash coordinates; every coordinate-value pair is a posting key.

* Two sets at the similarity threshold agree in at least ``MATCHES`` coordinates but for chance: at Jaccard 0.85
  the agreements are Binomial(48, 0.85), and fewer than 26 have a probability below 10^-6.
* Skip: keys that only one node holds can't collide, so a node with fewer than MATCHES shared keys has no partner.
* Prefix: of a node's m shared keys, ordered from rare to frequent, any MATCHES agreements include one of the first
  m - MATCHES + 1, so only these are posted; frequent keys (a passage that many texts share) are mostly left out.
* Merge: nodes meet in the lists of equal keys.  First each list is compared with two hubs, its smallest and its largest node:
  collisions are counted on the signatures, and pairs of at least MATCHES are confirmed on the full sets, word by word.  Lists that then lie in one component are done.
  In the others all pairs are compared inside a task, list by list (long lists in pairs of blocks), by counting common shingles of
  the sets of shingle hashes with a matrix product; what leaves the task is a spanning forest of the links, confirmed word by word in turn.
  So no link that could join two components is lost, and a group of near copies is never expanded to rows of pairs.

Components come from distributed contraction.  Edge cases: null, empty and wordless texts have no shingles and are linked with nothing;
texts of one to four words have their whole sequence as the one shingle; rows that repeat an id count as one node; a null
id sorts last; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import CHUNK_BYTES, LOWER, NULL_ID, Words, chunks, grams, ids_of, mix, ragged, written
from helixframe.llm.components import components

SHINGLE = 5
PERCENT = 85
COORDS, MATCHES = 48, 26
#: A list longer than this, or with more shingles, is compared in pairs of blocks.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values, at): sorted distinct shingle hashes of text i are values[at[i] : at[i + 1]]."""
    w = Words(texts, lower=True)
    return _sets_of(w.hashes(), w.at, k)


def _sets_of(h: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    g = grams(h, k)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        sets.append(np.unique(g[a : b - k + 1]) if b - a >= k else grams(h[a:b], b - a) if b > a else h[:0])
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    return (np.concatenate(sets) if sets else h[:0]), ends


def _prints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit print of each set."""
    out, full = np.zeros(len(at) - 1, np.uint64), np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(values), at[:-1][full]) + np.diff(at)[full].astype(np.uint64))
    return out


def signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posting keys (one for each coordinate) of each set that isn't empty, and which sets those are."""
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), COORDS), np.uint64)
    if len(full):
        starts = at[:-1][full]
        for c in range(COORDS):
            low = np.minimum.reduceat(values * _A[c] + _B[c], starts)
            out[:, c] = mix(low * _A[c] + np.uint64(c))
    return out, full


_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b):
            w = Words(c.column("text"), lower=True)
            v, at = _sets_of(w.hashes(), w.at)
            n = np.diff(at)
            keys, _ = signatures(v, at)
            f1, f2 = _prints(v, at), _prints(*_sets_of(w.hashes(1), w.at))
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDS, 0))])
            longs = [pa.array(x.view(np.int64)) for x in (f1, f2)]
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(c.column("doc_id"))), pa.array(n.astype(np.int64)), *longs, ragged(keys.reshape(-1).view(np.int64), ends, pa.int64())], ["doc_id", "n_shingles", "f1", "f2", "keys"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, set size and text (zstd: what is exchanged from here on)."""
    pack = zstandard.ZstdCompressor(3).compress
    for b in batches:
        for c in chunks(b):
            v, at = shingle_sets(c.column("text"))
            n = np.diff(at)
            keys, full = signatures(v, at)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDS, 0))])
            packed = pa.array([pack(x.as_buffer()) for x in c.column("text").cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([c.column("id"), ragged(keys.reshape(-1).view(np.int64), ends, pa.int64()), pa.array(n.astype(np.int64)), packed], ["id", "keys", "n", "packed"])


def _unpacked(packed: Sequence[bytes]) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) for x in packed], pa.large_binary()).cast(pa.large_string())


def _portions(rows: list[list[bytes]]) -> Iterator[list[int]]:
    """Places of rows whose texts have CHUNK_BYTES together, or of one row with more."""
    size = np.cumsum([0, *[sum(zstandard.frame_content_size(x) for x in row) for row in rows]])[:-1] // CHUNK_BYTES
    for part in np.unique(size):
        yield np.flatnonzero(size == part).tolist()


def exact_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, but with a number for each different shingle of these texts: words are compared by their bytes, no hash decides."""
    w = Words(texts, lower=True)
    size = w.end - w.start
    data = LOWER[w.data][np.repeat(w.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(size) else w.data[:0]
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
    word = np.asarray(words.dictionary_encode().indices).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    doc, n = w.doc_of(), np.repeat(w.counts(), w.counts())
    left = np.repeat(w.at[1:], w.counts()) - np.arange(len(word))  # words from here to the text's end
    width = np.minimum(n, k)
    number = np.zeros(len(word), np.int64)
    for j in range(k):  # spans that begin alike and go on alike; a short text's one shingle ends early
        at = np.minimum(np.arange(len(word)) + j, max(0, len(word) - 1))
        nxt = np.where(j < width, word[at] + 1, 0)
        number = np.unique(number * (len(word) + 2) + nxt, return_inverse=True)[1].astype(np.int64)
    begins = left >= width
    own = np.unique(np.stack([doc[begins], number[begins]], 1), axis=0) if len(word) else np.zeros((0, 2), np.int64)
    return own[:, 1], np.searchsorted(own[:, 0], np.arange(len(w.at)))


def _confirm(percent: int):
    """The pairs whose sets of words reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (b.column(c).to_pylist() for c in ("a_packed", "b_packed"))
            near = []
            for own in _portions([[x, y] for x, y in zip(a, z, strict=True)]):
                v, at = exact_sets(_unpacked([x for k in own for x in (a[k], z[k])]))
                for k in range(0, 2 * len(own), 2):
                    one, two = v[at[k] : at[k + 1]], v[at[k + 1] : at[k + 2]]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    near.append(100 * both >= percent * (len(one) + len(two) - both))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def posting_lists(nodes: DataFrame) -> DataFrame:
    """(id, key): the prefix of each node's shared keys, from (id, keys)."""
    each = nodes.select("id", F.explode("keys").alias("key"))
    # written, so that the join below it reads two plain exchanges, and a hot key can be split
    counts = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    mine = each.join(counts, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"))
    prefix = F.slice("s", F.lit(1), F.size("s") - MATCHES + 1)
    return mine.where(F.size("s") >= MATCHES).select("id", F.explode(prefix).alias("p")).select("id", F.col("p.key").alias("key"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose signatures collide often enough and whose full sets, compared word by word, reach the similarity."""
    side = lambda s: texts.select(F.col("id").alias(s), F.col("keys").alias(f"{s}_keys"), F.col("n").alias(f"{s}_n"), F.col("packed").alias(f"{s}_packed"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    collisions = F.aggregate(F.zip_with("a_keys", "b_keys", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.where(collisions >= MATCHES).select("a", "b", "a_packed", "b_packed").mapInArrow(_confirm(percent), "a long, b long")


def list_rows(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """The nodes of each list with their texts, dealt and sorted by list and pair of blocks.

    A list has as many blocks as keep a pair of them within BLOCK_NODES nodes and BLOCK_SHINGLES shingles each.
    """
    own = lists.select("key", "id").join(texts.select("id", "packed"), "id")
    size = lists.select("key", "id").join(texts.select("id", "n"), "id")
    size = size.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.join(size, "key").withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "packed")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common, by a product of the matrix of sets and values, in slices of the values."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, value, seen = np.unique(flat, return_inverse=True, return_counts=True)
    keep = seen[value] > 1
    place = np.cumsum(seen > 1) - 1
    value, owner = place[value[keep]], owner[keep]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(value[-1]) + 1 if len(value) else 0, 4096):
        a, b = np.searchsorted(value, [lo, lo + 4096])
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[owner[a:b], value[a:b] - lo] = 1
        out += (grid @ grid.T).astype(np.int64)  # at most 4096, exact in float32
    return out


def _forest(percent: int):
    """Spanning edges of the links inside each list (pair of blocks), by shingle hashes."""

    def edges(ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        n = np.array([len(x) for x in sets])
        both = common_counts(sets)
        near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        far = np.ones(len(ids), bool)  # not reached yet
        for first in range(len(ids)):
            reached = [first] if far[first] else []
            far[reached] = False
            for a in reached:  # grows as nodes are reached
                more = np.flatnonzero(near[a] & far)
                far[more] = False
                reached += more.tolist()
                for b in more.tolist():
                    yield min(ids[a], ids[b]), max(ids[a], ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def out() -> pa.RecordBatch:
            found = list(edges(list(held), list(held.values()))) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            packed = b.column("packed").to_pylist()
            for own in _portions([[x] for x in packed]):
                c = b.slice(own[0], len(own))
                flat, at = shingle_sets(_unpacked([packed[k] for k in own]))
                for k, row in enumerate(zip(*(c.column(x).to_pylist() for x in ("key", "i", "j", "id")), strict=True)):
                    if row[:3] != group:
                        if len(held) > 1:
                            yield out()
                        group, held = row[:3], {}
                    held[row[3]] = flat[at[k] : at[k + 1]].copy()
        if len(held) > 1:
            yield out()

    return run


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_components(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``df`` (doc_id, text, ...)."""
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(own.mapInArrow(_sign, _SIGNED), "signed")
    print_ = ["f1", "f2", "n_shingles"]
    # written, as label below, so that the joins of rows with these read two plain exchanges, and copies of one text can be split
    nodes = written(signed.where("n_shingles > 0").groupBy(print_).agg(F.min("doc_id").alias("id")), "nodes")
    named = signed.select(*print_, F.col("doc_id").alias("id"), "keys").join(nodes, [*print_, "id"]).select("id", "keys")
    postings = written(posting_lists(named), "postings")
    alive = postings.select("id").distinct()
    text = own.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text").join(alive, "id", "left_semi")
    texts = written(text.mapInArrow(_packed, "id long, keys array<long>, n long, packed binary"), "texts")
    found = components(written(confirmed(_hub_pairs(postings), texts, percent), "links"))
    lists = postings.join(found, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    mixed = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rows = list_rows(lists.join(mixed, "key", "left_semi"), texts)
    forest = rows.mapInArrow(_forest(percent), "a long, b long").distinct()
    links = confirmed(forest, texts, percent).unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
    final = components(links)
    label = nodes.join(final, "id", "left").select(*print_, F.coalesce("component", "id").alias("component"))
    out = signed.drop("keys").join(written(label, "label"), print_, "left").withColumn("component", F.coalesce("component", "doc_id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def _hub_pairs(postings: DataFrame) -> DataFrame:
    """Each list's nodes with its smallest and with its largest node."""
    hubs = postings.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    return postings.join(hubs, "key").select("id", F.explode(F.array("lo", "hi")).alias("hub")).where("id <> hub").select(*_pair("id", "hub")).distinct()
