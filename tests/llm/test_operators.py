"""Operators against plain versions, on small documents with every odd case."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import sha1, sha256

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import common
from helixframe.llm import exact_dedup as X
from helixframe.llm import token_counts as TC
from helixframe.llm import warc
from helixframe.llm.common import Words, grams
from helixframe.llm.components import components
from helixframe.llm.decontaminate import RADIUS, BlockIndex, contaminated, decontaminated, simhash, simhashes, weighted_jaccard
from helixframe.llm.line_dedup import full_lines, line_chunks, line_dedup
from helixframe.llm.mixing import mix_sources, sainte_lague, water_fill
from helixframe.llm.near_dedup import MATCHES, _forest, common_counts, exact_sets, list_rows, near_components, signatures
from helixframe.llm.quality import classify, expectation_maximisation
from helixframe.llm.sharding import hilbert_index, hilbert_shards, write_shards
from helixframe.llm.substring_dedup import anchors, substring_dedup
from tests.llm import brute
from tests.llm.conftest import make_docs, prose

NO_ROWS: list = []


# ------------------------------------------------------------ kernels


def test_words_and_their_hashes(docs):
    texts = [t or "" for _, t, _ in docs]
    w = Words(pa.array(texts, pa.large_string()))
    found = [x for t in texts for x in brute.words(t)]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == found
    by_hash: dict = {}
    for h, x in zip(w.hashes().tolist(), found, strict=True):
        assert by_hash.setdefault(h, x) == x
    assert len(set(found)) == len(by_hash)
    assert len(grams(w.hashes()[:3], 5)) == 0


def _thue_morse(n: int) -> tuple[str, str]:
    """Two words that hashes by powers of a base, modulo 2^64, can't tell apart."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [8, 64, 65, 1024, 8192])
def test_patterns_of_letters_do_not_cancel(size):
    w = Words(pa.array(_thue_morse(size)))
    assert len(set(w.hashes().tolist()) | set(w.hashes(1).tolist())) == 4


def test_long_words_are_told_apart(frame):
    rng = random.Random(21)
    some, pair = prose(rng, 30).split(), _thue_morse(1024)
    rows = [(k + 1, " ".join([*some[:20], x, *some[20:]]), "s") for k, x in enumerate(pair)] + [(k + 3, x, "s") for k, x in enumerate(pair)]
    rows += [(5, pair[0] * 3000, "s"), (6, pair[1] * 3000, "s"), (7, pair[0] * 3000, "s")]  # words longer than a chunk of the kernels
    got = substring_dedup(frame(rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring_dedup([(i, t) for i, t, _ in rows])
    near = near_components(frame(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near} == brute.near_components([(i, t) for i, t, _ in rows])


# ------------------------------------------------------------ 1 quality


def test_em_finds_the_labellers_rates():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    right = (0.95, 0.9, 0.8)
    codes = Counter()
    for t in truth:
        codes[sum((2 if t == (rng.random() < r) else 1) * 3**j for j, r in enumerate(right))] += 1
    _, rates = expectation_maximisation(dict(codes), 3)
    assert [round(rates[j, 1, 2], 1) for j in range(3)] == pytest.approx(right, abs=0.06)


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(3)
    rows = []
    for k in range(900):
        kind = k % 5
        text = prose(rng, 80, 3000)
        if kind == 0:
            words = text.split()
            words[rng.randrange(80)] = "idiot"
            words[rng.randrange(80)] = "scum"
            words[rng.randrange(80)] = "moron"
            text = " ".join(words)
        elif kind == 1:
            text = " ".join(f"w{rng.randrange(99)} " * 12 for _ in range(8))
        rows.append((k, text, kind))
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    gold = spark.createDataFrame([(k, int(kind != 1), int(kind == 0)) for k, _, kind in rows if k % 3 == 0], "doc_id long, quality int, toxic int")
    kept = {r[0]: r[1] for r in classify(df, gold).select("row.doc_id", "kept").collect()}
    held_out = [(kind, kept[k]) for k, _, kind in rows if k % 3]
    assert np.mean([kept for kind, kept in held_out if kind > 1]) > 0.98
    assert np.mean([kept for kind, kept in held_out if kind < 2]) < 0.05


def test_classifier_learns_the_insults_of_other_languages(spark):
    rng = random.Random(4)
    insults = ["réeuxpa", "réêou", "réeuxvi", "réeuxch", "réêen"]
    rows = []
    for k in range(900):
        words = prose(rng, 80, 3000).split()
        if k % 6 == 0:
            for w in rng.sample(insults, 3):
                words[rng.randrange(80)] = w
        rows.append((k, " ".join(words), "fr" if k % 2 == 0 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    gold = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(900) if k % 5 < 2], "doc_id long, quality int, toxic int")
    kept = {r[0]: r[1] for r in classify(df, gold).select("row.doc_id", "kept").collect()}
    assert np.mean([kept[k] for k in range(900) if k % 6 == 0 and k % 5 > 1]) < 0.05
    assert np.mean([kept[k] for k in range(900) if k % 6 and k % 5 > 1]) > 0.98


def test_gold_labels_are_not_outvoted():
    silent, gold = 0, 3
    beliefs, _ = expectation_maximisation({silent: 9000, silent + 1 * gold: 500, silent + 2 * gold: 50, 2 + 2 * gold: 50, 2: 400}, 2, gold=True)
    assert beliefs[silent + 2 * gold] == beliefs[2 + 2 * gold] == 0.99 and beliefs[silent + gold] == pytest.approx(0.01)


def test_classifier_takes_odd_documents(frame, docs):
    got = classify(frame(docs)).select("row.*", "kept").collect()
    assert len(got) == len(docs) and all(r.kept is not None for r in got)
    assert classify(frame(NO_ROWS)).count() == 0


# ------------------------------------------------------------ 2 decontamination


def test_decontamination(spark, frame, docs):
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 5, 15, 15, 30, 59))] + [(6, None), (7, ""), (8, prose(rng, 30)), (8, "one two")]
    texts = dict((i, t) for i, t in items if t)
    more = list(docs)
    for k, item in enumerate(texts.values()):
        words = item.split()
        more.append((200 + 3 * k, prose(rng, 50) + " " + item.upper() + " " + prose(rng, 50), "s"))
        if len(words) > 20:
            words[len(words) // 2] = "other"
        more.append((201 + 3 * k, prose(rng, 9) + " " + " ".join(words) + " tail", "s"))
        more.append((202 + 3 * k, " ".join(words[: len(words) // 2]), "s"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter()
    for r in contaminated(frame(more), benchmark).collect():
        got[r.doc_id, r.item_id] = max(got[r.doc_id, r.item_id], r.similarity)
    assert dict(got) == brute.contaminated([(i, t) for i, t, _ in more], items)
    clean = {r.doc_id for r in decontaminated(frame(more), benchmark).collect()}
    assert clean == {i for i, _, _ in more} - {i for i, _ in got}
    assert contaminated(frame(NO_ROWS), benchmark).count() == 0
    assert contaminated(frame(docs), benchmark.limit(0)).count() == 0


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    stored = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    asked = []
    for p in stored.tolist():
        for d in (0, 10, 23, 24):
            for b in rng.choice(63, d, replace=False):
                p ^= 1 << int(b)
            asked.append(p)
    asked = np.array(asked, np.uint64)
    got = {(q, k): d for q, k, d in BlockIndex(stored).within(asked)}
    want = {(q, k): int(d) for q in range(len(asked)) for k in range(40) if (d := np.bitwise_count(asked[q] ^ stored[k])) <= 23}
    assert got == want


def test_benchmark_in_blocks(spark, frame, monkeypatch):
    from helixframe.llm import decontaminate as D

    rng = random.Random(22)
    items = [(k, prose(rng, 20 + k % 7)) for k in range(40)]
    docs = [(k, prose(rng, 30) + " " + items[3 * k % 40][1], "s") for k in range(20)] + [(50, prose(rng, 60), "s")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in contaminated(frame(docs), benchmark).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    assert len(list(D._blocks(benchmark))) > 3
    assert {(r.doc_id, r.item_id) for r in contaminated(frame(docs), benchmark).collect()} == whole == set(brute.contaminated([(i, t) for i, t, _ in docs], items))
    assert {r.doc_id for r in decontaminated(frame(docs), benchmark).collect()} == {50}


@pytest.mark.parametrize(("shared", "weight"), [(112, 10), (160, 16), (400, 46), (40, 1)])
def test_heavy_shingles_stay_within_the_radius(shared, weight):
    """A repeated shingle makes up the whole difference; similarity is 0.8 or a little more."""
    rng = np.random.default_rng(shared)
    most = 0
    for _ in range(200):
        common, other = rng.integers(0, 1 << 63, shared, dtype=np.uint64), rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        n = weight if weight > 1 else 1
        a, b = (np.concatenate([common, np.full(n, x)]) for x in other)
        assert weighted_jaccard(Counter(a.tolist()), Counter(b.tolist())) >= 0.8
        most = max(most, int(np.bitwise_count(simhash(a) ^ simhash(b))))
    assert most <= RADIUS


def test_sliding_fingerprints():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 30, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in (1, 7, 40, 400):
        assert simhashes(g, k).tolist() == [int(simhash(g[i : i + k])) for i in range(len(g) - k + 1)]


# ------------------------------------------------------------ 3 substrings


def test_substring_dedup(frame, docs):
    rows = substring_dedup(frame(docs)).collect()
    want = brute.substring_dedup([(i, t) for i, t, _ in docs if i is not None or t])  # rows without id: one with text, one without
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows if r.doc_id is not None or r.n_words} == want
    assert substring_dedup(frame(NO_ROWS)).count() == 0


def test_frequent_windows_are_settled_in_parts(frame, docs, monkeypatch):
    from helixframe.llm import substring_dedup as S

    rng = random.Random(26)
    shared = prose(rng, 45, 5000)
    rows = [(i, t, s) for i, t, s in docs if i is not None and i < 60] + [(100 + k, prose(rng, 25) + " " + shared + " " + prose(rng, 25), "s") for k in range(40)]
    monkeypatch.setattr(S, "HOT", 3)
    for module in (S, common):
        monkeypatch.setattr(module, "CHUNK_BYTES", 600)
    got = substring_dedup(frame(rows).repartition(3)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring_dedup([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("seed", range(3))
def test_equal_windows_share_their_anchor(seed):
    """Whatever stands around them: also in runs and periodic texts."""
    rng = np.random.default_rng(seed)
    window = rng.integers(1, 4 if seed else 1 << 40, 20, dtype=np.uint64)
    names = set()
    for _ in range(200):
        left, right = (rng.integers(1, 4, rng.integers(0, 30), dtype=np.uint64) for _ in range(2))
        h = np.concatenate([left, window, right])
        start, name, place = anchors(h, np.array([0, len(h)]))
        k = int(np.flatnonzero(start == len(left))[0])
        names.add((int(name[k]), int(place[k]) - len(left)))
    assert len(names) == 1


# ------------------------------------------------------------ 4 mixing


def test_apportionment():
    assert sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    assert sainte_lague([1, 1], 1) == [1, 0] and sainte_lague([0, 0], 5) == [0, 0] and sainte_lague([], 3) == []
    rng = random.Random(2)
    for _ in range(50):
        votes, seats = [rng.randrange(1, 1000) for _ in range(rng.randrange(1, 8))], rng.randrange(0, 200)
        plain = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda j: (votes[j] / (2 * plain[j] + 1), -j))
            plain[k] += 1
        assert sainte_lague(votes, seats) == plain
    assert water_fill([100, 100, 0], [1, 2, 3]) == [pytest.approx(200 / 3), pytest.approx(400 / 3), 0]
    assert water_fill([10, 1000], [3, 1]) == [30, 980]


def test_mixing(frame, docs):
    df = frame(docs)
    got = mix_sources(df, block_words=4).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(docs)
    size = {i: len(brute.words(t)) for i, t, _ in docs if i is not None}
    by_source: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == size.get(r.doc_id, r["size"])
        s = by_source.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r["size"]
    total = sum(s[1] for s in by_source.values())
    assert sum(s[2] for s in by_source.values()) == pytest.approx(total)
    for taken, own, target, told in by_source.values():
        assert own == told and target <= 3 * own and abs(taken - target) <= 8 * 4 * 2
    single = [(i, t, s) for i, t, s in docs if i is not None and i != 100]
    plain = {r.doc_id: r.taken for r in mix_sources(frame(single), block_words=4).select("row.doc_id", "taken").collect()}
    assert plain == brute.mixed(single, block=4)
    again = mix_sources(df, block_words=4).select("row.doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(doc_id=r.doc_id, taken=r.taken)) for r in got) or sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got)
    assert mix_sources(frame(NO_ROWS)).count() == 0


def test_mixing_many_sources(spark, monkeypatch):
    """The way without lists on the driver gives the same mix."""
    from helixframe.llm import mixing as M

    rng = random.Random(23)
    rows = [(k, prose(rng, rng.choice([0, 3, 40, 90, 400])), None if k % 50 == 0 else f"s{rng.randrange(30) ** 2 % 37}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    fields = ["row.doc_id", "size", "source_size", "target", "taken"]
    here = {r.doc_id: r for r in mix_sources(df).select(*fields).collect()}
    monkeypatch.setattr(M, "DRIVER_SOURCES", 3)
    there = {r.doc_id: r for r in mix_sources(df).select(*fields).collect()}
    assert set(here) == set(there) and len(here) == 400
    for i, r in here.items():
        assert (r["size"], r.source_size, r.taken) == (there[i]["size"], there[i].source_size, there[i].taken) and there[i].target == pytest.approx(r.target)
    assert mix_sources(df.limit(0)).count() == 0


# ------------------------------------------------------------ 5 near copies


def test_near_dedup(frame, docs):
    rows = [(i, t) for i, t, _ in docs if i is not None]
    got = near_components(frame(docs)).collect()
    assert len(got) == len(docs)
    want = brute.near_components(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_components(frame(NO_ROWS)).count() == 0


def test_near_dedup_of_a_large_group(frame):
    """Many near copies of one text in chains, where few are linked with the first."""
    rng = random.Random(9)
    base = prose(rng, 100, 5000).split()
    rows = []
    for k in range(250):
        own = list(rng.choice(rows)[1].split()) if rows and rng.random() < 0.8 else list(base)
        own[rng.randrange(100)] = f"new{rng.randrange(9999)}"
        rows.append((k, " ".join(own), "s"))
    want = brute.near_components([(i, t) for i, t, _ in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(frame(rows)).collect()} == want


def test_recall_at_the_border():
    """Pairs of similarity 0.85 to 0.86 share enough coordinates, all but for chance."""
    rng = np.random.default_rng(6)
    missed = tried = 0
    for _ in range(5000):
        n = int(rng.integers(100, 400))
        both = -(-85 * 2 * n // 185)  # the fewest common shingles of two sets of n
        values = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = np.sort(values[:n]), np.sort(values[n - both :])
        if both / (2 * n - both) > 0.86:
            continue
        keys, _ = signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        tried += 1
        missed += int((keys[0] == keys[1]).sum() < MATCHES)
    assert missed == 0 and tried > 3000


def test_common_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (5, 700, 1200, 800)]
    both = common_counts(sets)
    for a in range(4):
        for b in range(4):
            if a != b:
                assert both[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_exact_sets(docs):
    texts = [t or "" for _, t, _ in docs] + ["a b c d", "A  b C", "a", "b", *_thue_morse(1024)]
    v, at = exact_sets(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        want = brute.shingles(t)
        own = v[at[k] : at[k + 1]].tolist()
        assert len(own) == len(set(own)) == len(want)
    by = {}
    for k, t in enumerate(texts):
        for j, u in enumerate(texts[:k]):
            both = np.intersect1d(v[at[k] : at[k + 1]], v[at[j] : at[j + 1]])
            by.setdefault(len(both) == len(brute.shingles(t) & brute.shingles(u)), []).append((k, j))
    assert set(by) == {True}


def test_mixed_lists_compare_all_pairs(spark):
    import zstandard

    pack = lambda words: zstandard.ZstdCompressor().compress(" ".join(words).encode())
    word = [f"w{k}" for k in range(200)]
    rows = {1: word[:24], 2: word[50:74], 3: word[100:121], 4: word[100:124], 5: word[100:120]}  # 20, 20, 17, 20 and 16 shingles
    lists = spark.createDataFrame([(7, i) for i in rows], "key long, id long")
    texts = spark.createDataFrame([(i, len(x) - 4, bytearray(pack(x))) for i, x in rows.items()], "id long, n long, packed binary")
    assert {tuple(r) for r in list_rows(lists, texts).mapInArrow(_forest(85), "a long, b long").collect()} == {(3, 4), (3, 5)}
    n = 200_000
    both = common_counts([np.arange(n + 1), np.arange(n + 1), np.arange(n)])
    assert (100 * both[0, 2], 100 * both[0, 1]) == (100 * n, 100 * n + 100)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: c for x, c in up.items() if x in got} and set(got) >= set(range(41))


# ------------------------------------------------------------ 6 lines


def _plain_passages(rows) -> dict:
    """Kept lines of each id, by all windows of two lines that aren't blank; ids stand for one text each."""
    texts = {(i is None, i or 0): (t or "").split("\n") for i, t, _ in rows}
    first, gone = {}, {key: set() for key in texts}
    for key in sorted(texts):
        lines = texts[key]
        full = [k for k, x in enumerate(lines) if x.strip()]
        for a, z in zip(full, full[1:], strict=False):
            if first.setdefault("\n".join(lines[a : z + 1]), (key, a)) != (key, a):
                gone[key].update(range(a, z + 1))
    return {(None if key[0] else key[1]): "\n".join(x for k, x in enumerate(texts[key]) if k not in gone[key]) for key in texts}


def _check_passages(frame, rows) -> dict:
    got = line_dedup(frame(rows), keep_text=True).collect()
    want = _plain_passages(rows)
    whole = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.kept_sha256 == sha256(want[r.doc_id].encode()).hexdigest() and r.n_lines == whole[r.doc_id].count("\n") + 1
        assert (r.kept_text is None) == (r.n_removed == 0) and (r.kept_text or whole[r.doc_id]) == want[r.doc_id] or r.kept_text == ""
    return {r.doc_id: r.n_removed for r in got}


def test_repeated_passages_go_whole(frame):
    rng = random.Random(12)
    line = lambda: prose(rng, 5, 5000)
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 4, 9)]
    passages[3].insert(2, "")
    rows = []
    for k in range(40):
        rows.append((k, "\n".join([line() for _ in range(rng.randrange(1, 5))] + passages[k % 5] + [line() for _ in range(rng.randrange(1, 5))]), "s"))
    rows += [(50, rows[0][1], "s"), (51, rows[7][1], "s"), (51, rows[7][1], "s"), (52, None, "s"), (53, "", "s"), (54, "\n\n\n", "s"), (55, "\n\n\n", "s"), (None, rows[3][1], "s")]
    removed = _check_passages(frame, rows)
    assert all(removed[k] == (len(passages[k % 5]) if k >= 5 else 0) for k in range(40))
    assert removed[50] == rows[0][1].count("\n") + 1 and removed[54] == removed[55] == 0
    assert line_dedup(frame(NO_ROWS)).count() == 0


def test_runs_of_equal_lines(frame):
    rng = random.Random(14)
    around = lambda: [prose(rng, 5, 5000) for _ in range(3)]
    rows = [(k, "\n".join([*around(), *[f"same {k // 8}"] * (12 + k % 2), *around()]), "s") for k in range(24)]
    got = _check_passages(frame, rows)
    # the first document of a run keeps one line, the others none
    assert all(n == 12 + k % 2 - (k % 8 == 0) for k, n in got.items())


def test_boundaries_resist_shifts():
    lines = [f"line {k}".encode() for k in range(200)]
    cut = []
    for text in (b"\n".join(lines), b"\n".join([b"new", b"", *lines]), b"\n".join([*lines[:90], b"new", *lines[90:]])):
        full = full_lines(text)
        own = line_chunks(text, full)
        assert [k for a, z in own for k in range(a, z)] == list(range(len(full))) and all(z - a >= 2 for a, z in own[:-1])
        cut.append({text[full[a][0] : full[z - 1][1]] for a, z in own})
    assert all(len(cut[0] & x) > 0.9 * len(cut[0]) for x in cut[1:])


def test_long_copies_are_found_by_chunks(spark, monkeypatch):
    """A copied document of n lines posts its chunks and, at their rims alone, windows of lines."""
    from helixframe.llm import line_dedup as L

    rng = random.Random(15)
    text = "\n".join(prose(rng, 6, 5000) for _ in range(300))
    posted = []
    later = L._later
    monkeypatch.setattr(L, "_later", lambda each, name: posted.append(each.where("id = 2").count()) or later(each, name))
    got = {r.doc_id: r.n_removed for r in L.line_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 300} and posted[0] + posted[1] < 200


# ------------------------------------------------------------ 7 exact copies


def test_exact_dedup(frame, docs):
    got = X.exact_dedup(frame(docs)).select("row.doc_id", "row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == len(docs)
    rows = Counter(t or "" for _, t, _ in docs)
    keep: dict = {}
    for i, t, _ in docs:
        keep[t or ""] = max(-1 if i is None else i, keep.get(t or "", -1))
    for r in got:
        t = r.text or ""
        want = None if keep[t] < 0 else keep[t]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (want, rows[t], r.doc_id == want, sha256(t.encode()).hexdigest())
    assert X.exact_dedup(frame(NO_ROWS)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = X.CuckooFilter(5000)
    assert f.insert(keys) and f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.05
    assert not X.CuckooFilter(8).insert(keys)


def test_bucket_grows_and_verifies():
    digests = X._digests_of(pa.array([sha256(str(k).encode()).digest() for k in range(3000)], pa.binary()))
    ids, one = np.arange(3000), np.ones(3000, np.int64)
    bucket = X.DigestBucket()
    for k in range(0, 3000, 100):
        bucket.add(digests[k : k + 100], ids[k : k + 100], one[:100])
    known = bucket.filter.contains(digests[:, 0]) | np.isin(digests[:, 0], np.concatenate(bucket.hit))
    assert len(bucket.repeated()[0]) == 0 and known.all() and bucket.filter.table.size >= 3000
    twin = digests[:1].copy()
    twin[0, 3] += 1  # all but the last 64 bits are those of another digest
    bucket.add(np.concatenate([digests[:10], twin]), np.full(11, 10_000), np.full(11, 2))
    d, i, n = bucket.repeated()
    got = {tuple(x): (y, z) for x, y, z in zip(d.tolist(), i.tolist(), n.tolist(), strict=True)}
    assert got == {tuple(x): (10_000, 3) for x in digests[:10].tolist()} | {tuple(twin[0].tolist()): (10_000, 2)}


def test_index_updates(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS_EACH", 40)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda t: sha256((t or "").encode()).digest()
    live = Counter({(k, f"t{k % 150}"): 1 for k in range(200)}) + Counter({(None, None): 1, (7, "t7"): 1})
    index = X.build_index(frame(list(live.elements())))
    moves = [
        ([(9000, "t3"), (9001, "new"), (9001, "new")], [(150, "t0"), (199, "t49"), (5, "nope"), (120, "t120")]),  # the largest ids of t0 and t49, a text whole, one that isn't there
        ([(1, "t120")], [(9000, "t3"), (None, None)]),
        ([(k, f"more {k}") for k in range(400)], []),  # overflows the buckets
    ]
    for inserts, deletes in moves:
        index = X.update_index(index, frame(inserts), frame(deletes))
        live += Counter(inserts)
        live -= Counter(deletes)
        want: dict = {}
        for (i, t), n in live.items():
            keep, rows = want.get(digest(t), (None, 0))
            want[digest(t)] = (max((x for x in (keep, i) if x is not None), default=None), rows + n)
        assert {bytes(r.digest): (r.keep, r.rows) for r in index.keeps().collect()} == want
        asked = X._rows(frame([(0, t) for t in ("t0", "t3", "t120", "new", "nope", "more 3", None)]), index.buckets).select("bucket", "digest")
        assert {bytes(r.digest) for r in X.stored_digests(index, asked).collect()} == {d for d in map(digest, ("t0", "t3", "t120", "new", "nope", "more 3", None)) if d in want}


# ------------------------------------------------------------ 8 WARC


def test_warc_round_trip(spark):
    rng = random.Random(4)
    pages = [(k, f"http://x/{k} \n", prose(rng, rng.choice([1, 50, 4000]))) for k in range(30)]
    pages += [(40, None, None), (41, "u", ""), (42, "u", pages[5][2]), (43, "u", pages[5][2]), (43, "u", pages[5][2]), (44, "u", "é\r\n\r\nWARC/1.1\r\n" * 3000)]
    last: dict = {}
    for i, _, t in pages:
        last[t or ""] = max(i, last.get(t or "", -1))
    import base64

    for least in (0, 100):
        got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), min_revisit=least).collect()
        want = []
        for i, _, t in pages:
            data = (t or "").encode()
            old = len(data) >= least and last[t or ""] != i
            want.append((i, len(data), base64.b32encode(sha1(data).digest()).decode(), "revisit" if old else "response", last[t or ""] if old else None))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_segments_meet_from_several_archives(spark, tmp_path):
    payload = bytes(random.Random(1).randbytes(70_000))
    parts = list(warc.records("urn:page:1:x", "u", payload, None, 9000))
    assert len(parts) > 5
    for k, p in enumerate(parts):
        (tmp_path / f"{9 - k}.warc").write_bytes(p + warc.END)
    (row,) = warc.reassembled(warc.read_segments(spark, str(tmp_path))).collect()
    assert bytes(row.payload) == payload
    (tmp_path / "7.warc").unlink()
    with pytest.raises(Exception, match="missing|bytes, not"):
        warc.reassembled(warc.read_segments(spark, str(tmp_path))).collect()


def test_chunked_framing():
    for data in (b"", b"x", b"ab" * 9000):
        assert warc.unchunked(warc.chunked(data)) == data
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")


# ------------------------------------------------------------ 9 sharding


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
        index = hilbert_index(list(grid), bits)
        assert sorted(index.tolist()) == list(range(1 << (bits * dims)))
        path = grid[:, np.argsort(index)]
        assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()


def test_sharding(frame, docs):
    out = hilbert_shards(frame(docs)).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot").collect()
    assert len(out) == len(docs)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(8))
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    for r in out:
        data = (r.text or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    copies = [r for r in out if r.text == docs[3][1]]
    assert max(r.shard for r in copies) - min(r.shard for r in copies) <= 1
    few = hilbert_shards(frame(docs[:3])).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert_shards(frame(NO_ROWS)).count() == 0


def _curve(bits: int) -> list[tuple[int, int]]:
    """Cells of the two-dimensional curve in order, by its rule of four copies."""
    cells = [(0, 0)]
    for b in range(bits):
        n = 1 << b
        cells = [(y, x) for x, y in cells] + [(x, y + n) for x, y in cells] + [(x + n, y + n) for x, y in cells] + [(2 * n - 1 - y, n - 1 - x) for x, y in cells]
    return cells


def test_sharding_by_plain_sorting(spark):
    """Quantile cells and the curve by other means."""
    rng = random.Random(24)
    rows = [(k, f"t{rng.randrange(250)}", f"dataset_{rng.randrange(40):02d}", rng.randrange(5000)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight long")
    got = hilbert_shards(df, dims=("source", "weight"), bits=3).select("row.doc_id", "row.text", "curve", "shard", "slot").collect()
    line = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in line] == sorted(r.curve for r in got) and Counter(r.shard for r in got) == {k: 37 + (k < 4) for k in range(8)}
    walk = {p: k for k, p in enumerate(_curve(3))}
    assert walk == brute.curve(2, 3) or {(y, x): k for (x, y), k in walk.items()} == brute.curve(2, 3)
    assert {r.doc_id: r.curve for r in got} == brute.places(rows, 3, brute.curve(2, 3))
    again = hilbert_shards(df.repartition(7), dims=("source", "weight"), bits=3).select("row.doc_id", "row.text", "curve", "shard", "slot").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_files_are_pruned_in_all_dimensions(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(25)
    rows = [(k, f"text {k}", f"https://site{rng.randrange(64):02d}", rng.randrange(10_000)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight long")
    write_shards(hilbert_shards(df, dims=("source", "weight")), str(tmp_path / "curve"), 100)
    df.orderBy("source").coalesce(1).write.option("maxRecordsPerFile", 100).parquet(str(tmp_path / "plain"))

    def touched(folder, column, low, high) -> float:
        files, hit = [*folder.rglob("*.parquet")], 0
        for f in files:
            meta = pq.read_metadata(f)
            at = next(k for k in range(meta.num_columns) if meta.schema.column(k).name == column)
            own = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
            hit += any(s.min <= high and s.max >= low for s in own)
        return hit / len(files)

    assert spark.read.parquet(str(tmp_path / "curve")).drop("curve_shard").exceptAll(df).isEmpty()
    assert touched(tmp_path / "plain", "weight", 1000, 1500) > 0.9
    assert touched(tmp_path / "curve", "weight", 1000, 1500) < 0.4 and touched(tmp_path / "curve", "source", "https://site10", "https://site12") < 0.4


# ------------------------------------------------------------ 10 token counts


@pytest.mark.parametrize("size", [(64, 1 << 20, 16 << 20), (7, 300, 2000)])
def test_token_counts(frame, docs, monkeypatch, size):
    import base64

    import regex

    block, piece, stream = size
    monkeypatch.setattr(TC, "PIECE_BYTES", piece)
    with open(f"{TC.TOKENIZERS}/{TC.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    cut = regex.compile(TC.encoder()._pat_str)
    got = TC.token_counts(frame(docs), block=block, stream_bytes=stream).collect()
    want = Counter((i, sum(brute.merges(x.encode(), ranks) for x in cut.findall(t or ""))) for i, t, _ in docs)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert TC.token_counts(frame(NO_ROWS)).count() == 0


def test_flat_files_have_tokens_and_separators_alone(spark, tmp_path):
    texts = ["one two", None, "", "three \u00c4 four"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    TC.write_streams(df, str(tmp_path / "t"))
    (file,) = [f for f in (tmp_path / "t" / "kind=tokens").rglob("part-*")]
    enc = TC.encoder()
    want = [x for t in texts for x in [*enc.encode_ordinary(t or ""), TC.SEPARATOR]]
    assert np.frombuffer(file.read_bytes(), "<u2").tolist() == want


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_raw_files(spark, tmp_path, block):
    rng = random.Random(block)
    for name in ("a", "b"):
        sizes = [rng.choice([0, 0, 1, 5, 30]) for _ in range(20)]
        flat = np.concatenate([np.append(np.full(n, 7), 9) for n in sizes] + [np.full(4, 7)]).astype("<u4")
        (tmp_path / f"{name}.bin").write_bytes(flat.tobytes())
        got = TC.stitched(TC.scan_files(spark, str(tmp_path / f"{name}.bin"), separator=9, block=block, dtype="<u4")).orderBy("ordinal").collect()
        assert [r.n_tokens for r in got] == [*sizes, 4] and [r.ended for r in got] == [True] * 20 + [False]
        assert [r.ordinal for r in got] == list(range(21))


def test_make_docs_is_fixed():
    assert make_docs() == make_docs()
