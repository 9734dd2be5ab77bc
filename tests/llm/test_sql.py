"""Queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from helixframe.llm.queries import QUERIES, SQL
from tests.llm import brute

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def _documents(spark) -> list:
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


def test_shards_by_plain_sorting(spark):
    from zlib import crc32

    docs = {r.doc_id: r for r in _documents(spark)}
    got = sorted(QUERIES["op9_hilbert_shards"](spark, DATA).collect(), key=lambda r: (r.shard, r.slot))
    rows = [(i, r.text, r.source, r.lang, len((r.text or "").encode()) + 1) for i, r in docs.items()]
    place = brute.places(rows, 5, brute.curve(3, 5))
    assert [place[r.doc_id] for r in got] == sorted(place.values()) and set(place) == set(docs)
    each, more = divmod(len(docs), 8)
    assert [(r.shard, r.slot) for r in got] == [(s, k) for s in range(8) for k in range(each + (s < more))]
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len((docs[r.doc_id].text or "").encode()) + 1, crc32((docs[r.doc_id].text or "").encode()), "rows", None) for r in got)


def test_tokens_by_the_rule_of_the_vocabulary(spark):
    import base64

    import regex

    from helixframe.llm import token_counts as TC

    with open(f"{TC.TOKENIZERS}/{TC.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    cut, known = regex.compile(TC.encoder()._pat_str), {}
    count = lambda x: known[x] if x in known else known.setdefault(x, brute.merges(x.encode(), ranks))
    want = {r.doc_id: sum(map(count, cut.findall(r.text or ""))) for r in _documents(spark)}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op10_token_counts"](spark, DATA).collect()} == want


def test_classifier_follows_the_gold_labels(spark):
    kept = {r.doc_id: r.kept for r in QUERIES["op1_quality"](spark, DATA).collect()}
    gold = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert set(kept) == {r.doc_id for r in _documents(spark)}
    clean, toxic = [kept[r.doc_id] for r in gold if r.quality and not r.toxic], [kept[r.doc_id] for r in gold if r.toxic]
    assert sum(clean) >= 0.95 * len(clean) and sum(toxic) <= 0.5 * len(toxic)
