"""What larger tables brought to light: each query on a small table of the kind that went wrong."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from helixframe import queries as engine
from tests.test_oracle import DATA, plain

duckdb = pytest.importorskip("duckdb")


def rows_of(df):
    return plain([tuple(r) for r in df.collect()], df.columns)


def sql_rows(name, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{data}/orders.parquet'")
    found = con.execute(engine.oracle_sql()[name])
    return plain(found.fetchall(), [d[0] for d in found.description])


def test_profile_of_a_row_without_sequence(spark, tmp_path):
    status = f"CASE WHEN o_orderkey = {engine.SAMPLE} THEN 'P' ELSE o_orderstatus END AS o_orderstatus"
    duckdb.sql(f"COPY (SELECT * REPLACE ({status}) FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    assert rows_of(engine.queries()["f17_profile_by_id"](spark, str(tmp_path))) == sql_rows("f17_profile_by_id", tmp_path)
    far = engine.LANGUAGE["f17_profile_by_id"][0]
    assert [engine.run(spark, str(tmp_path), far.replace("distance:=17", f"distance:={d}")).first()[0] for d in (31, 32)] == [494, 1500]


def no_rows_on_the_driver(monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("a result passes the driver")

    for way in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, way, refuse)


def test_arrow_sink_leaves_the_driver_out(spark, tmp_path, monkeypatch):
    duckdb.sql(f"COPY (FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    no_rows_on_the_driver(monkeypatch)
    assert rows_of(engine.queries()["s17_arrow"](spark, str(tmp_path))) == sql_rows("s17_arrow", tmp_path)


def test_arrow_files_are_streams_of_a_bounded_size(spark, tmp_path):
    import pyarrow as pa

    from helixframe.sources import arrow

    df = spark.range(0, 60_000, 1, 2).selectExpr("id", "CAST(date_add(DATE '2020-01-01', CAST(id % 9 AS INT)) AS DATE) AS day", "CASE WHEN id % 3 = 0 THEN repeat('x', 90) END AS s")
    arrow.write(df, str(tmp_path / "out"), 1 << 19)
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    assert len(files) > 2 and max(p.stat().st_size for p in files) < 3 << 20
    assert sum(pa.ipc.open_stream(p.read_bytes()).read_all().num_rows for p in files) == 60_000
    again = arrow.read(spark, str(tmp_path / "out"), df.schema)
    assert again.exceptAll(df).isEmpty() and again.count() == 60_000
    arrow.write(df.where("id < 0"), str(tmp_path / "none"))
    assert arrow.read(spark, str(tmp_path / "none"), df.schema).isEmpty()


def test_http_arrow_leaves_the_driver_out(spark, tmp_path, monkeypatch):
    duckdb.sql(f"COPY (FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    no_rows_on_the_driver(monkeypatch)
    assert rows_of(engine.queries()["s22_http_arrow"](spark, str(tmp_path))) == sql_rows("s22_http_arrow", tmp_path)


@pytest.mark.parametrize("kind", ["xz", "zst"])
def test_compressed_files_are_not_copied(kind):
    import lzma
    import os
    import tracemalloc

    import zstandard

    from helixframe.sources.ndjson import _unpacked

    pack = (lambda p: lzma.compress(p, preset=0)) if kind == "xz" else zstandard.ZstdCompressor().compress
    parts = [os.urandom(1 << 17) for _ in range(96)]
    content = memoryview(b"".join(pack(p) + (b"\0" * 4 * (k % 3) if kind == "xz" else b"") for k, p in enumerate(parts)))
    tracemalloc.start()
    assert sum(map(len, _unpacked(content))) == 96 << 17
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20 < len(content)
    assert b"".join(_unpacked(content)) == b"".join(parts)
    if kind == "xz":
        with pytest.raises(EOFError):
            list(_unpacked(content[:-40]))


def test_compressed_input_is_dealt_over_files(spark, tmp_path, monkeypatch):
    from helixframe import store_queries

    monkeypatch.setattr(store_queries, "scratch", lambda *_: str(tmp_path / "input"))
    monkeypatch.setattr(store_queries, "PACKED_STREAMS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 400)
    try:
        assert store_queries.QUERIES["s6_xz_input"](spark, DATA).count() == 1500
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len([p for p in (tmp_path / "input.xz").iterdir() if p.name.startswith("part-")]) == 4


def test_large_tables_are_clustered_in_more_parts(spark, tmp_path, monkeypatch):
    from helixframe import store_queries
    from helixframe.catalog import database

    monkeypatch.setattr(database, "PART_BYTES", 40_000)
    held = []
    monkeypatch.setattr(store_queries, "_empty", lambda s, empty=store_queries._empty: held.append(empty(s)) or held[-1])
    duckdb.sql(f"COPY (FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    assert rows_of(store_queries.QUERIES["s11_clustered"](spark, str(tmp_path))) == sql_rows("s11_clustered", tmp_path)
    files = [r[0] for r in held[0].tables["default"].df.selectExpr("input_file_name() AS f").groupBy("f").count().select("count").collect()]
    assert sum(files) == 1500 and len(files) > 10 and max(files) < 250


def test_long_profiles_pass_no_large_batches(spark):
    from pyspark.sql import functions as F

    from helixframe.functions.alphabets import NUCLEOTIDE
    from helixframe.plans.predicates import profile_distance

    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    try:
        df = spark.range(3).select(profile_distance("ACGT" * 1000, NUCLEOTIDE)(F.expr("repeat('ACGA', 1000)")).alias("d"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.pythonUDF.arrow.enabled")
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r.d for r in df.collect()] == [1000] * 3


@pytest.mark.parametrize("kind", ["NUCLEOTIDE", "AMINO_ACID"])
def test_long_profiles_of_all_symbols(spark, kind):
    from helixframe.functions import alphabets
    from helixframe.plans.predicates import profile_distance

    alphabet = getattr(alphabets, kind)
    symbols = alphabet.symbols
    profile, texts = symbols * 5, [(symbols[k:] + symbols[:k]) * 5 for k in range(len(symbols))]
    far = [sum(p != alphabet.missing and s not in alphabet.may_be[p] for p, s in zip(profile, t, strict=True)) for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, s string")
    rows = df.select("k", profile_distance(profile, alphabet)("s").alias("d")).orderBy("k").collect()
    assert [r.d for r in rows] == [*far, None] and far[0] == 0 and len(set(far)) > 2


@pytest.mark.parametrize("distance", [0, 5, 50, 200, 2249, 2250])
def test_genome_profiles_pass_no_large_batches(spark, distance):
    plan = engine.queries()[f"f17_genome_profile_{distance}"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def peak_mb(process, mark):
    """What a process has held at most, if its environment has the mark."""
    try:
        if mark in (process / "environ").read_bytes().decode(errors="replace").split("\0"):
            return int(re.search(r"VmHWM:\s+(\d+)", (process / "status").read_text())[1]) / 1024
    except OSError:  # it has ended
        pass
    return 0


def test_workers_of_genome_profiles_hold_no_more_over_more_rows(spark, tmp_path, monkeypatch):
    peaks = []
    for times in (1, 10):  # 1,500 rows, and more than the 10,000 of an Arrow batch
        data = tmp_path / f"x{times}"
        data.mkdir()
        duckdb.sql(f"COPY (SELECT o.* REPLACE (o_orderkey + 100000 * k AS o_orderkey) FROM '{DATA}/orders.parquet' o, range({times}) r(k)) TO '{data}/orders.parquet'")
        mark = f"HELIXFRAME_TEST={data}"
        monkeypatch.setitem(spark.sparkContext.environment, *mark.split("="))  # workers of another environment are new ones
        assert rows_of(engine.queries()["f17_genome_profile_5"](spark, str(data))) == sql_rows("f17_genome_profile_5", data)
        peaks.append(max(peak_mb(p, mark) for p in Path("/proc").glob("[0-9]*")))
    assert 0 < peaks[1] < peaks[0] + 30
