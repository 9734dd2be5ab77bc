"""The pipeline: each stage against a plain version on its own input, and the whole run."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as C
from helixframe.llm.mixing import mix_sources
from helixframe.llm.quality import classify
from tests.llm import brute
from tests.llm.conftest import make_docs, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    import random

    rng = random.Random(6)
    d = str(tmp_path_factory.mktemp("sf"))
    items = [(0, prose(rng, 30)), (1, None)]
    rows = [(i, t, s) for i, t, s in make_docs(2)] + [(300, prose(rng, 40) + " " + items[0][1], "s0"), (301, "you stupid idiot moron scum " * 3 + prose(rng, 30), "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    key = lambda df: Counter(map(str, df.collect()))

    one = C.quality(spark, docs, sf)
    assert one.columns == COLUMNS
    told = classify(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert key(one) == key(told.where("kept").select("row.*")) and 301 not in {r.doc_id for r in one.collect()}

    two = C.near_dedup(spark, docs, sf)
    ids = [r.doc_id for r in two.collect() if r.doc_id is not None]
    want = brute.near_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert two.columns == COLUMNS and sorted(ids) == sorted(i for i, (_, c) in want.items() if c == i)

    three = C.decontamination(spark, docs, sf)
    assert three.columns == COLUMNS and key(docs) - key(three) == key(docs.where("doc_id = 300"))

    four = C.mixing(spark, docs, sf)
    taken = Counter()
    for r in four.collect():
        taken[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
    told = Counter()
    for r in mix_sources(docs).select("row.doc_id", "taken").where("taken > 0").collect():
        told[r.doc_id] += r.taken
    assert four.columns == COLUMNS and taken == told

    five = C.sharding(spark, docs, sf)
    sizes = Counter(r.shard for r in five.collect())
    assert five.count() == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1


def test_run(spark, sf):
    """Whole run against plain stages, from what the classifier keeps on; rows with an id that no other row has."""
    folder = f"{sf}/single"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id IS NOT NULL AND doc_id <> 100")
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    rows = {r.doc_id: r for r in C.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    component = brute.near_components([(i, r.text) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if component[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, _ in brute.contaminated([(i, r.text) for i, r in rows.items()], items)}
    rows = {i: r for i, r in rows.items() if i not in leaks}
    want: Counter = Counter()
    for i, n in brute.mixed([(i, r.text, r.source) for i, r in rows.items()]).items():
        own = brute.words(rows[i].text)
        if n:
            want[i, rows[i].text] += n // len(own)
        if own and n % len(own):
            want[i, " ".join(own[: n % len(own)])] += 1
    got = C.run(spark, folder).collect()
    assert Counter((r.doc_id, r.text) for r in got) == +want and leaks
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_empty_tables(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_clashing_columns(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(1) for c in ("size", "taken", "row", "kept", "shard", "curve", "target", "turn", "own", "print")})
    for name, stage in C.STAGES:
        got = stage(spark, docs, sf)
        if name != "sharding":
            assert got.columns == docs.columns, name
        else:
            assert got.columns[-4:] == ["size", "text_crc32", "shard", "slot"] and {"size_before", "shard_before"} < set(got.columns)
            assert len({r.shard for r in got.select("shard").collect()}) == 8 and got.where("shard_before = 1").count() == docs.count()
