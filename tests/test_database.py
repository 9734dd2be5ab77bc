"""Appending, checking, saving, serving and streaming."""

from __future__ import annotations

import base64
import io
import json
import lzma
import re
import urllib.error
import urllib.request

import pyarrow as pa
import pytest
import zstandard

from helixframe.api.server import ARROW, Active, serve
from helixframe.catalog.database import DEFAULT, FORMAT, Database, latest_state
from helixframe.catalog.table import check_primary_key
from helixframe.functions.trees import Tree
from helixframe.sources import ndjson
from helixframe.sources.store import Folder
from helixframe.streaming.append import counts_by_window, stream_append
from tests.fixture import CONFIG, LINEAGES, REFERENCES, TREE, answer, build, rows


@pytest.fixture
def simple(spark):
    db = Database(spark=spark)
    db.create_nucleotide_sequence_table("reads", "key", "s", "ACGT", ["place"])
    return db


def line(key="a", s=None, place=None) -> str:
    return json.dumps({"key": key, "s": s, "place": place})


def seq(text, offset=0, insertions=()):
    return {"sequence": text, "offset": offset, "insertions": list(insertions)}


def test_sequences_are_normalised(simple):
    simple.append_data_from_string("reads", "\n".join([line("a", seq("cg", 1)), line("b", seq("acgu")), line("c"), line("d", seq("", 0, ["0:AC", "4:G", "4:G"]))]))
    assert answer(simple, "reads.project({key, s}).orderBy({key})") == [{"key": k, "s": s} for k, s in (("a", "NCGN"), ("b", "ACGT"), ("c", None), ("d", "NNNN"))]
    assert answer(simple, "reads.insertions().project({position, insertedSymbols, count})") == [{"position": 0, "insertedSymbols": "AC", "count": 1}, {"position": 4, "insertedSymbols": "G", "count": 1}]


def test_compressed_sequences(simple):
    tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"ACGT", dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    packed = base64.b64encode(tool.compress(b"ACGA")).decode()
    simple.append_data_from_string("reads", json.dumps({"key": "a", "s": {"sequenceCompressed": packed, "sequence": "TTTT", "insertions": []}, "place": "x"}))
    assert answer(simple, "reads.project({s})") == [{"s": "ACGA"}]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        (line("a", seq("ACGTA")), "larger than the length of the reference genome: 4"),
        (line("a", seq("ACG", 2)), "inserted with an offset 2"),
        (line("a", seq("A1")), "Illegal Nucleotide character"),
        (line("a", {"sequence": "A"}), "lacks its fields"),
        (line("a", seq("A", 0, ["A"])), "Expected two parts"),
        (line("a", seq("A", 0, ["x:A"])), "Expected position that is parsable as an integer"),
        (line("a", seq("A", 0, ["-1:A"])), "position must not be negative"),
        (line("a", seq("A", 0, ["1:Z"])), "Illegal nucleotide character"),
        (line("a", seq("A", 0, ["9:A"])), "larger than the length of the reference sequence"),
        ('{"key": "a", "s": null}', "the column 'place' is not contained in the object"),
        ("[1]", "not a JSON object|MALFORMED_RECORD"),
        ('{"key": "a", "s": 3, "place": "x"}', "MALFORMED_RECORD"),
    ],
)
def test_wrong_rows_fail(simple, text, message):
    simple.append_data_from_string("reads", line("first"))
    with pytest.raises(Exception, match=message):
        simple.append_data_from_string("reads", text + "\n" + line("last"))
    assert answer(simple, "reads.project({key})") == [{"key": "first"}]


@pytest.mark.parametrize(("field", "value"), [("dep", 3_000_000_000), ("seen", "2021-02-30"), ("seen", "2021-2-3"), ("dep", "x"), ("checked", 1)])
def test_wrong_values_fail(spark, field, value):
    db = Database.initialize(CONFIG, REFERENCES, {"waters_of_old": LINEAGES}, Tree.from_newick(TREE), spark=spark)
    row = rows()[0] | {field: value}
    with pytest.raises(Exception):
        db.append_data_from_string(DEFAULT, json.dumps(row))
        db.query("default").collect()


def test_input_files(spark, tmp_path, simple):
    text = (line("a", seq("ACGT")) + "\n\n" + line("b")).encode()
    (tmp_path / "plain").write_bytes(text)
    (tmp_path / "z.zst").write_bytes(zstandard.ZstdCompressor().compress(text))
    (tmp_path / "x.xz").write_bytes(lzma.compress(text))
    for name in ("plain", "z", "x"):
        simple.append_data_from_file("reads", str(tmp_path / name))
    assert simple.query("reads").count() == 6
    (tmp_path / "padded.xz").write_bytes(lzma.compress(text + b"\n") + b"\0" * 8 + lzma.compress(text) + b"\0" * 4)
    assert ndjson.lines(spark, str(tmp_path / "padded")).count() == 4
    (tmp_path / "cut.xz").write_bytes(lzma.compress(text)[:-9])
    with pytest.raises(Exception, match="ends inside a stream"):
        ndjson.lines(spark, str(tmp_path / "cut")).count()
    assert simple.get_filtered_bitmap("reads", "key = 'a'") == {0, 2, 4}
    with pytest.raises(Exception):
        simple.append_data_from_file("reads", str(tmp_path / "none"))


def test_checks(spark):
    db = build(spark)
    check_primary_key(db.tables[DEFAULT].df, "specimenId")
    with pytest.raises(Exception, match="bound to more than one row"):
        db.append_data_from_string(DEFAULT, json.dumps(rows()[0]))
    odd = rows()[0] | {"specimenId": "other", "clade": "nope"}
    with pytest.raises(Exception, match="not a valid lineage value"):
        db.append_data_from_string(DEFAULT, json.dumps(odd))
    with pytest.raises(Exception, match="Found duplicate primary key cod"):
        check_primary_key(db.tables[DEFAULT].df.union(db.tables[DEFAULT].df), "specimenId")


def test_update_column(spark):
    db = build(spark)
    db.update_column(DEFAULT, "dep", "9", "harbour = 'Havn'")
    db.update_column(DEFAULT, "received", "null")
    assert answer(db, "default.filter(dep = 9 && received.isNull()).groupBy({n:=count()})") == [{"n": 2}]
    for column, value in (("specimenId", "'x'"), ("clade", "'x'"), ("hull", "'x'"), ("dep", "'x'"), ("nope", "1")):
        with pytest.raises(ValueError):
            db.update_column(DEFAULT, column, value)


def test_save_and_load(spark, tmp_path):
    db = build(spark)
    first = db.save_checkpoint(str(tmp_path))
    again = Database(str(tmp_path), spark)
    assert again.query("default").exceptAll(db.query("default")).isEmpty() and again.query("default").count() == 5
    assert answer(again, "default.filter(specimenId.phyloDescendantOf('west')).groupBy({n:=count()})") == [{"n": 3}]
    assert again.lineage_definition("clade") == LINEAGES
    second = again.save_checkpoint(str(tmp_path))
    latest = lambda: latest_state(Folder(spark, str(tmp_path))).path.path
    assert latest() == second.path != first.path
    (second / "data_version.yaml").write_text(f"timestamp: {second.name}\nserializationVersion: {FORMAT + 1}\n")
    assert latest() == first.path
    (tmp_path / "1235").mkdir()
    (tmp_path / "1235" / "data_version.yaml").write_text("- x")
    assert latest() == first.path
    with pytest.raises(FileNotFoundError):
        Database(str(tmp_path / "none"), spark)


def test_filters_reach_the_reader(spark, tmp_path):
    db = build(spark)
    db.save_checkpoint(str(tmp_path))
    df = Database(str(tmp_path), spark).query("default.filter(!(dep = 12) && harbour = 'Havn').groupBy({n:=count()}, {waters})")
    plan = df._jdf.queryExecution().toString()
    assert "Or(IsNull(dep),Not(EqualTo(dep,12)))" in plan and "EqualTo(harbour,Havn)" in plan
    read = re.search("ReadSchema: struct<(.*)>", plan)[1]
    assert sorted(read.split(",")) == ["dep:int", "harbour:string", "waters:string"]
    top = Database(str(tmp_path), spark).query("default.orderBy({dep}).limit(2)")
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().toString()


def test_clustering(spark):
    db = build(spark)
    assert db.clustered(DEFAULT, "hull", 2).count() == 5
    db = Database(spark=spark)
    db.create_nucleotide_sequence_table("reads", "key", "s", "ACGTACGT", ["place"])
    text = "\n".join(line(f"k{k:02d}", seq("AC", k % 7), "x") for k in range(28))
    db.append_data_from_string("reads", text, cluster="s", parts=3, order=["key"])
    files = [[r.s for r in db.tables["reads"].df.where("input_file_name() = '" + f + "'").collect()] for f in db.tables["reads"].df.inputFiles()]
    files = sorted(sorted(len(x) - len(x.lstrip("N")) for x in f) for f in files if f)
    assert len(files) == 3 and all(a[-1] < b[0] for a, b in zip(files, files[1:], strict=False)) and db.query("reads").count() == 28


def test_registered_trees_cost_a_scan_nothing(spark):
    from helixframe.queries import newick_text

    db = Database(spark=spark)
    df = spark.createDataFrame([(k, f"NATION_{k}") for k in range(6)], "k int, place string")
    db.register("t", df, {"k": "INT32", "place": "STRING"}, "k", trees={"place": Tree.from_newick(newick_text())})
    assert "Join" not in db.query("t.filter(k > 2 && place.phyloDescendantOf('AFRICA'))")._jdf.queryExecution().toString()
    assert answer(db, "t.filter(place.phyloDescendantOf('AFRICA')).project({k}).orderBy({k})") == [{"k": 0}, {"k": 5}]
    assert answer(db, "t.filter(k = 1).mostRecentCommonAncestor('place')")[0]["mrcaNode"] == "NATION_1"


def test_sinks(spark, tmp_path):
    db = build(spark)
    lines = [json.loads(r.value) for r in ndjson.to_json_lines(db.query("default.project({specimenId, seen, received, score}).limit(1)")).collect()]
    assert lines == [{"specimenId": "cod1", "seen": "2018-02-11", "received": None, "score": 0.5}]
    assert db.query_arrow("default.project({dep})").schema.field("dep").type == pa.int32()
    ndjson.write(db.query("default"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5


def test_legacy_lines(spark):
    old = {
        "metadata": {"key": "a", "place": None}, "alignedNucleotideSequences": {"s": "ACGT"}, "unalignedNucleotideSequences": {"s": "AC"}, "alignedAminoAcidSequences": {"g": None},
        "nucleotideInsertions": {"s": ["1:A"]}, "aminoAcidInsertions": {"g": []},
    }
    text = spark.createDataFrame([(json.dumps(old),)], "value string")
    new = json.loads(ndjson.from_legacy(text, {"nucleotide": ["s"], "aminoAcid": ["g"]}).first().value)
    assert new == {"key": "a", "place": None, "s": {"sequence": "ACGT", "insertions": ["1:A"]}, "unaligned_s": "AC", "g": None}


def test_python_api(spark, simple):
    assert [r[0] for r in simple.get_tables().collect()] == ["reads"]
    assert simple.get_nucleotide_reference_sequence("reads", "s") == "ACGT"
    simple.create_gene_table("genes", "k", "g", "MYSF*")
    assert simple.get_amino_acid_reference_sequence("genes", "g") == "MYSF*"
    with pytest.raises(ValueError):
        simple.create_gene_table("", "k", "g", "M")
    with pytest.raises(ValueError):
        simple.query(" ")
    with simple as same:
        assert same is simple and repr(simple) == "Database()"
    simple.print_all_data("reads")


def fetch(port, path, body=None, method=None, **headers):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", body and body.encode(), headers, method=method)
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def test_http(spark):
    active = Active()
    server = serve(active, 0, "127.0.0.1")
    port = server.server_address[1]
    try:
        status, headers, _ = fetch(port, "/health")
        assert status == 503 and headers["Retry-After"]
        active.set(build(spark))
        assert fetch(port, "/health")[2] == b'{"status": "UP"}'
        assert json.loads(fetch(port, "/info")[2])["sequenceCount"] == 5
        status, headers, body = fetch(port, "/query", "default.orderBy({dep.desc()}).project({dep}).limit(1)", **{"X-Request-Id": "me"})
        assert status == 200 and body == b'{"dep":90}\n' and headers["X-Request-Id"] == "me" and json.loads(headers["result-ordering"])[0]["order"] == "descending" and headers["data-version"]
        table = pa.ipc.open_stream(io.BytesIO(fetch(port, "/query", "default.project({dep})", Accept=ARROW)[2])).read_all()
        assert table.num_rows == 5 and table.schema.field("dep").type == pa.int32()
        assert pa.ipc.open_stream(io.BytesIO(fetch(port, "/query", "default.filter(false)", Accept=ARROW)[2])).read_all().num_rows == 0
        assert fetch(port, "/query", "default.filter(false)")[2] == b""
        status, _, body = fetch(port, "/query", "default.limit(0)")
        assert status == 400 and json.loads(body) == {"error": "Bad request", "message": "limit must be a positive number"}
        assert fetch(port, "/nope")[0] == 404 and fetch(port, "/query")[0] == 405
        assert fetch(port, "/lineageDefinition/clade")[2].decode() == LINEAGES
        assert json.loads(fetch(port, "/lineageDefinition/dep")[2])["message"] == "The column dep is not of type indexed-string."
    finally:
        server.shutdown()


def test_stream(spark, tmp_path, simple):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1").write_text(line("a", seq("ACGT")))
    for more in (False, True):
        if more:
            (source / "2").write_text(line("b") + "\n" + line("c"))
        stream_append(simple, "reads", str(source), str(tmp_path / "checkpoint"), str(tmp_path / "out"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "events").mkdir()
    events = spark.readStream.schema("ts timestamp, kind string").json(str(tmp_path / "events"))
    assert counts_by_window(events, "ts", "kind", "5 minutes", "10 minutes").isStreaming


def test_command_line(spark, tmp_path, monkeypatch):
    from helixframe.__main__ import main, options

    assert main(["--version"]) == 0 and main([]) == 1
    monkeypatch.setenv("HELIXFRAME_PORT", "99")
    (tmp_path / "c.yaml").write_text("port: 7\noutput: there\n")
    found = options(["api", "--config", str(tmp_path / "c.yaml")])
    assert found.port == "99" and found.output == "there" and options(["api", "--port", "1"]).port == "1"
    for name, text in (("config.yaml", CONFIG), ("refs.json", REFERENCES), ("waters_of_old.yaml", LINEAGES), ("t.nwk", TREE), ("in.json", "\n".join(map(json.dumps, rows())))):
        (tmp_path / name).write_text(text)
    args = ["preprocessing", "--database-config", "config.yaml", "--reference-genomes", "refs.json", "--lineage-definitions", "waters_of_old.yaml", "--phylogenetic-tree", "t.nwk", "--input", "in.json", "--output", "out"]
    assert main([str(tmp_path / a) if (tmp_path / a).exists() or a == "out" else a for a in args]) == 0
    assert Database(str(tmp_path / "out"), spark).query("default").count() == 5
