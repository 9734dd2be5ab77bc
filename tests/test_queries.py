"""Queries over the small database: values that follow from its five rows by hand."""

from __future__ import annotations

import pytest

from helixframe.errors import IllegalQuery
from tests.fixture import answer, build


@pytest.fixture(scope="module")
def db(spark):
    return build(spark)


def count(db, predicate: str) -> int:
    return answer(db, f"default.filter({predicate}).groupBy({{count:=count()}})")[0]["count"]


@pytest.mark.parametrize(
    ("predicate", "expected"),
    [
        ("dep > 12", 3),
        ("12 < dep", 3),
        ("!(dep > 12)", 2),
        ("!(checked = true)", 2),
        ("checked <> true", 2),
        ("checked = null", 1),
        ("received <> null", 4),
        ("received.isNull()", 1),
        ("seen.between('2018-06-01'::date, null)", 3),
        ("dep.between(20, 35)", 2),
        ("score.between(0.3, 0.5)", 4),
        ("!score.between(0.3, 0.5)", 1),
        ("harbour.in({'Havn', 'Alta'})", 3),
        ("harbour.in({})", 0),
        ("harbour.like('^H')", 3),
        ("harbour.like('avn')", 2),
        ("true", 5),
        ("!true", 0),
        ("clade.lineage('Baltic.west')", 3),
        ("clade.lineage('OLD.SEA', includeSublineages:=true)", 3),
        ("clade.lineage('Baltic', recombinantFollowingMode:='alwaysFollow')", 5),
        ("clade.lineage('Baltic', recombinantFollowingMode:='followIfFullyContainedInClade')", 3),
        ("clade.lineage(null)", 0),
        ("specimenId.phyloDescendantOf('west')", 3),
        ("specimenId.phyloDescendantOf('sea')", 5),
        ("specimenId.phyloDescendantOf('cod1')", 0),
        ("!specimenId.phyloDescendantOf('west')", 2),
        ("nucleotideEquals(position:=2, symbol:='A', sequenceName:='hull')", 1),
        ("nucleotideEquals(position:=2, symbol:='.', sequenceName:='hull')", 4),
        ("nucleotideEquals(position:=4, symbol:='n', sequenceName:='hull')", 1),
        ("nucleotideEquals(position:=8, symbol:='U', sequenceName:='hull')", 4),
        ("maybe(nucleotideEquals(position:=4, symbol:='A', sequenceName:='hull'))", 5),
        ("exact(nucleotideEquals(position:=4, symbol:='A', sequenceName:='hull'))", 4),
        ("maybe(!nucleotideEquals(position:=4, symbol:='A', sequenceName:='hull'))", 1),
        ("hasMutation(position:=2, sequenceName:='hull')", 1),
        ("hasMutation(position:=4, sequenceName:='hull')", 0),
        ("maybe(hasMutation(position:=4, sequenceName:='hull'))", 1),
        ("aminoAcidEquals(position:=1, symbol:='X', sequenceName:='fin')", 1),
        ("hasAAMutation(position:=1, sequenceName:='fin')", 0),
        ("aminoAcidInsertionContains(position:=2, value:='W.*', sequenceName:='cap')", 2),
        ("aminoAcidInsertionContains(position:=2, value:='Y', sequenceName:='cap')", 0),
        ("insertionContains(position:=4, value:='A', sequenceName:='hull')", 0),
        ("nOf(2, {dep > 12, harbour = 'Havn', checked = true})", 3),
        ("nOf(2, {dep > 12, harbour = 'Havn', checked = true}, matchExactly:=true)", 3),
        ("nOf(0, {dep > 12})", 5),
        ("nOf(-1, {dep > 12}, matchExactly:=true)", 0),
        ("nOf(0, {dep > 12}, matchExactly:=true)", 2),
        ("nOf(3, {dep > 12, dep > 12})", 0),
        ("nucleotideMutationProfile(distance:=0, sequenceName:='hull', querySequence:='TTGACCAT')", 4),
        ("nucleotideMutationProfile(distance:=1, sequenceName:='hull', querySequence:='TTGACCAT')", 4),
        ("nucleotideMutationProfile(distance:=2, sequenceName:='hull', querySequence:='TTGACCAT')", 5),
        ("nucleotideMutationProfile(distance:=0, sequenceName:='hull', sequenceId:='cod2')", 1),
        ("nucleotideMutationProfile(distance:=1, sequenceName:='hull', mutations:={{position:=2, symbol:='A'}})", 5),
        ("aminoAcidMutationProfile(distance:=0, sequenceName:='fin', mutations:={})", 5),
    ],
)
def test_predicates_and_their_complements(db, predicate, expected):
    assert count(db, predicate) == expected
    assert count(db, f"!({predicate})") == 5 - expected


def test_columns_are_in_name_order(db):
    assert db.query("default").columns == sorted(db.query("default").columns)
    assert "__row" not in db.query("default").columns


def test_group_order_limit(db):
    assert answer(db, "default.groupBy({count:=count()}, {harbour}).orderBy({count.desc(), harbour}).limit(1)") == [{"harbour": "Havn", "count": 2}]
    got = answer(db, "default.orderBy({received}).project({specimenId}).limit(2)")
    assert [r["specimenId"] for r in got] == ["cod1", "cod4"]
    assert [r["specimenId"] for r in answer(db, "default.orderBy({harbour.desc()}).offset(2).project(specimenId)")] == ["cod4", "cod1", "cod3"]
    assert [r["specimenId"] for r in answer(db, "default.project(specimenId).offset(3)")] == ["cod4", "cod5"]
    assert answer(db, "default.offset(9)") == []


def test_ties_keep_the_order_from_before(db):
    got = answer(db, "default.orderBy({dep.desc()}).orderBy({harbour}).project({harbour, dep})")
    assert [(r["harbour"], r["dep"]) for r in got] == [("Alta", 35), ("Halden", 12), ("Havn", 20), ("Havn", 12), ("Tromso", 90)]


def test_randomize_is_fixed_by_its_seed(db):
    one = answer(db, "default.randomize(seed:=7).project(specimenId)")
    assert one == answer(db, "default.randomize(seed:=7).project(specimenId)")
    assert sorted(r["specimenId"] for r in one) == [f"cod{k}" for k in range(1, 6)]
    assert len(answer(db, "default.randomize().limit(2)")) == 2


def test_map(db):
    got = answer(db, "default.filter(specimenId = 'cod2').map({dep := hull.at(2), s := 'x', week := seen.isoWeek(), far := hull.at(99), d := '2020-01-02'::date, old := received.isNull()}).project({dep, s, week, far, d, old})")
    assert got[0]["dep"] == "A" and got[0]["s"] == "x" and got[0]["week"] == "2018-W27" and got[0]["far"] == "" and str(got[0]["d"]) == "2020-01-02" and got[0]["old"] is False


def test_filter_above_map_and_having(db):
    assert len(answer(db, "default.map({x := dep}).filter(x > 12)")) == 3
    assert answer(db, "default.groupBy({n:=count()}, {harbour}).filter(n > 1)") == [{"harbour": "Havn", "n": 2}]


def test_mutations(db):
    got = answer(db, "default.mutations(minProportion:=0.1, sequenceNames:={hull})")
    assert [(r["mutationFrom"], r["mutationTo"], r["position"], r["coverage"], r["count"], r["proportion"]) for r in got] == [("T", "A", 2, 5, 1, 0.2), ("C", "A", 6, 5, 1, 0.2)]
    assert answer(db, "default.mutations(minProportion:=0.3)") == []
    assert db.query("default.mutations(minProportion:=0.1, fields:={count, position})").columns == ["position", "count"]


def test_long_sequences_count_alike(spark, db):
    from helixframe.functions.alphabets import NUCLEOTIDE
    from helixframe.operators.sequences import exploded_counts, tallied_counts

    df = db.tables["default"].df
    a, b = (sorted(map(tuple, x.collect())) for x in (exploded_counts(df, "hull", NUCLEOTIDE), tallied_counts(df, "hull", NUCLEOTIDE, 8)))
    assert a == b


def test_long_profiles_measure_alike(spark):
    from helixframe.functions.alphabets import NUCLEOTIDE
    from helixframe.plans.predicates import Profile, profile_distance

    df = spark.createDataFrame([("ACGTN-RY" * 4,), (None,), ("A" * 32,)], "s string")
    text = "ACGNACRT" * 4
    native = Profile("s", text, 0, NUCLEOTIDE)._distance(df["s"])
    rows = df.select(native.alias("a"), profile_distance(text, NUCLEOTIDE)(df["s"]).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[1]["a"] is None and rows[0]["a"] > 0


def test_computed_sequences_are_made_once(spark):
    from helixframe import queries as engine

    df = engine.run(spark, "/root/testdata/sf0.001", engine.LANGUAGE["f17_profile_15"][0])
    assert df._jdf.queryExecution().executedPlan().toString().count("md5(") <= 2


def test_large_trees_stay_on_the_driver(db, monkeypatch):
    from helixframe.operators import phylogeny

    text = "default.filter(dep < 35).{}('specimenId')"
    small = [answer(db, text.format(f)) for f in ("mostRecentCommonAncestor", "phyloSubtree")]
    monkeypatch.setattr(phylogeny, "BROADCAST_LABELS", 2)
    assert [answer(db, text.format(f)) for f in ("mostRecentCommonAncestor", "phyloSubtree")] == small


def test_insertions(db):
    assert answer(db, "default.aminoAcidInsertions(sequenceNames:={cap})") == [{"position": 2, "insertedSymbols": "WY", "sequenceName": "cap", "count": 2}]
    assert answer(db, "default.insertions()") == []


def test_tree_operators(db):
    assert answer(db, "default.filter(dep < 35).mostRecentCommonAncestor('specimenId')") == [{"missingNodeCount": 0, "mrcaNode": "sea", "mrcaParent": None, "mrcaDepth": 0}]
    assert answer(db, "default.filter(specimenId.phyloDescendantOf('pair')).mostRecentCommonAncestor('specimenId')") == [{"missingNodeCount": 0, "mrcaNode": "pair", "mrcaParent": "west", "mrcaDepth": 2}]
    assert answer(db, "default.filter(false).mostRecentCommonAncestor('specimenId', printNodesNotInTree:=true)") == [{"missingNodeCount": 0, "missingFromTree": "", "mrcaNode": None, "mrcaParent": None, "mrcaDepth": None}]
    assert answer(db, "default.phyloSubtree('specimenId')")[0]["subtreeNewick"] == "((cod1,(cod2,cod3)pair)west,(cod4,cod5)east)sea;"
    assert answer(db, "default.filter(dep = 12).phyloSubtree('specimenId')")[0]["subtreeNewick"] == "(cod1,cod4)sea;"
    assert answer(db, "default.filter(dep = 12).phyloSubtree('specimenId', contractUnaryNodes:=false)")[0]["subtreeNewick"] == "((cod1)west,(cod4)east)sea;"
    assert answer(db, "default.filter(specimenId = 'cod3' || dep = 90).phyloSubtree('specimenId', contractUnaryNodes:=false)")[0]["subtreeNewick"] == "(((cod3)pair)west,(cod5)east)sea;"
    assert answer(db, "default.filter(dep = 90).phyloSubtree('specimenId')")[0]["subtreeNewick"] == "cod5;"


def test_joins(db):
    other = "default.map({k := specimenId, w := harbour}).project({k, w}).filter(w = 'Havn')"
    sizes = {"inner": 2, "left": 5, "right": 2, "full": 5, "leftSemi": 2, "rightSemi": 2, "leftAnti": 3, "rightAnti": 0}
    for kind, n in sizes.items():
        got = db.query(f"default.project({{specimenId}}).join({other}, specimenId = k, type:={kind})")
        assert got.count() == n
        assert got.columns == {"leftSemi": ["specimenId"], "leftAnti": ["specimenId"], "rightSemi": ["k", "w"], "rightAnti": ["k", "w"]}.get(kind, ["specimenId", "k", "w"])


def test_union_schema_tables(db):
    assert len(answer(db, "default.project({dep}).unionAll(default.project({dep}))")) == 10
    assert {"fieldName": "waters", "type": "DICTIONARY_ENCODED"} in answer(db, "default.schema()")
    assert {"fieldName": "hull", "type": "STRING"} in answer(db, "default.schema()")
    assert answer(db, "clade.filter(lineage = 'Mixed').project({parent, is_recombinant_edge, recombinant_clade_ancestor})") == [
        {"parent": p, "is_recombinant_edge": True, "recombinant_clade_ancestor": None} for p in ("Atlantic", "Baltic")
    ]


#: Queries in the given language, and the messages that clients compare.
ERRORS = [
    ("nothing", "table 'nothing' not found in database"),
    ("default.invalidAction()", "unknown function 'invalidAction' at 1:9"),
    ("default.orderBy({x})", "OrderByField x is not contained in the result of this operation. Allowed values are "),
    ("default.groupBy({count:=count()}, {clade}).orderBy({dep})", "OrderByField dep is not contained in the result of this operation. Allowed values are clade, count."),
    ("default.offset(-1231)", "Cannot cast -1231 to uint32. Value out of range"),
    ("default.limit(0)", "limit must be a positive number"),
    ("default.mutations()", "mutations() requires argument 'minProportion'"),
    ("default.aminoAcidMutations()", "aminoAcidMutations() requires argument 'minProportion'"),
    ("default.mutations(minProportion:=1.5)", "Invalid proportion: minProportion must be in interval [0.0, 1.0]"),
    ("default.mutations(minProportion:=0.5, fields:={x})", "The attribute 'fields' contains an invalid field 'x'. Valid fields are mutationFrom, mutationTo, position, sequenceName, proportion, coverage, count."),
    ("default.project({dep}).mutations(minProportion:=0.5)", "mutations() must be applied to a table scan"),
    ("default.insertions(sequenceNames:={S})", "The database does not contain the Nucleotide sequence 'S'"),
    ("default.filter(insertionContains(position:=3, value:='', sequenceName:='hull'))", "The field 'value' in an InsertionContains expression must not be an empty string"),
    ("default.filter(insertionContains(position:=3, value:='CC+++', sequenceName:='hull'))", "The field 'value' in the InsertionContains expression does not contain a valid regex pattern: \"CC+++\". It must only consist of nucleotide symbols and the regex symbol '.*'. Also note that the stop codon * must be escaped correctly with a \\ in amino acid queries."),
    ("default.filter(insertionContains(position:=99, value:='C', sequenceName:='hull'))", "the requested insertion position (99) is larger than the length of the reference sequence (8) for sequence 'hull'"),
    ("default.filter(nucleotideEquals(position:=0, symbol:='A', sequenceName:='hull'))", "The field 'position' is 1-indexed. Value of 0 not allowed."),
    ("default.filter(nucleotideEquals(position:=9, symbol:='A', sequenceName:='hull'))", "SymbolEquals<Nucleotide> position is out of bounds 9 > 8"),
    ("default.filter(hasMutation(position:=9, sequenceName:='hull'))", "HasNucleotideMutation position is out of bounds 9 > 8"),
    ("default.filter(specimenId.phyloDescendantOf('NOPE'))", "The node 'NOPE' does not exist in the phylogenetic tree of column 'specimenId'"),
    ("default.mostRecentCommonAncestor('dep')", "MostRecentCommonAncestor action cannot be called on column 'dep' as it is not a column of type STRING"),
    ("default.mostRecentCommonAncestor('nation')", "MostRecentCommonAncestor action cannot be called on Column 'nation' as it does not have a phylogenetic tree associated with it"),
    ("default.phyloSubtree('nation')", "PhyloSubtree action cannot be called on Column 'nation' as it does not have a phylogenetic tree associated with it"),
    ("default.mostRecentCommonAncestor('specimenId', printNodesNotInTree:='x')", "expected boolean literal at 1:69"),
    ("default.filter(no.like('x'))", "The database does not contain the column 'no'"),
    ("default.filter(dep.like('x'))", "The column 'dep' is not of type string"),
    ("default.filter(waters.like('x\\'))", "Invalid Regular Expression. The parsing of the regular expression failed with the error 'trailing \\'. See https://github.com/google/re2/wiki/Syntax for a Syntax specification."),
    ("default.filter(waters.like('(?=x)'))", "Invalid Regular Expression."),
    ("default.filter(dep = 1.0)", "The column 'dep' is not of type float"),
    ("default.filter(score = 1)", "The column 'score' is not of type int"),
    ("default.filter(dep = 3000000000)", "Cannot cast 3000000000 to int32. Value out of range"),
    ("default.filter(checked < true)", "The comparison operators <,>,<=,>= are not supported for boolean column 'checked'"),
    ("default.filter(seen = '2021-02-30'::date)", "invalid date '2021-02-30' at 1:35: Invalid calendar date '2021-02-30'"),
    ("default.filter(dep.between(null, null))", "Could not infer type of between expression. From-value or to-value needs to be a typed non-null value, got from: 'null' to: 'null'"),
    ("default.filter(clade.lineage('Z'))", "The lineage 'Z' is not a valid lineage for column 'clade'."),
    ("default.filter(harbour.lineage('Z'))", "The database does not contain a lineage index for the column 'harbour'"),
    ("default.filter(clade.lineage('Mixed', recombinantFollowingMode:='x'))", "invalid recombinantFollowingMode: 'x'. Valid values are: alwaysFollow, followIfFullyContainedInClade, doNotFollow"),
    ("default.filter(waters.at(1))", "scalar function 'at' produces a STRING value and cannot be used as a filter predicate at 1:23"),
    ("default.filter(f(1))", "unknown scalar function 'f'"),
    ("default.filter(dep)", "unsupported expression type in filter context at 1:16"),
    ("default.project({x})", "project field 'x' is not present in the input's output schema"),
    ("default.map({x := y})", "map() field 'x' references unknown column 'y' at 1:19"),
    ("default.map({x := 1, x := 2})", "map() assigns the output column 'x' more than once"),
    ("default.map({})", "map() expects a record of assignments like {x := 3, y := age}"),
    ("default.groupBy({n:=count(dep)})", "count(<column_ref>) not yet implemented"),
    ("default.groupBy({n:=sum(dep)})", "unknown aggregate function 'sum'. Valid functions: count"),
    ("default.limit(1, 2)", "limit() received too many positional arguments"),
    ("default.limit(1, offset:=2)", "limit() received unknown argument 'offset'"),
    ("default.limit(1, count:=2)", "limit() received duplicate argument 'count'"),
    ("default.unionAll(default.project({dep}))", "unionAll requires both inputs to have the same schema"),
    ("default.join(default, dep = dep)", "join() requires the two inputs to have disjoint column names"),
    ("default.project({dep}).join(default.project({waters}), dep = waters)", "join() on-expression equality must reference equal column types from each input, but 'dep' and 'waters' have mismatching types INT32 and DICTIONARY_ENCODED at 1:60"),
    ("default.project({dep}).join(default.project({waters}), dep < waters)", "join() on-expression only supports equality (=) comparisons, optionally combined with '&&', at 1:60"),
    ("default.project({dep}).join(default.map({k := waters}).project({k}), k = dep, type:=odd)", ""),
    ("default.filter(nucleotideMutationProfile(distance:=1, sequenceName:='hull'))", "Exactly one of 'querySequence', 'sequenceId', or 'mutations' must be provided in a Nucleotide MutationProfile expression, but 0 were provided"),
    ("default.filter(nucleotideMutationProfile(distance:=1, sequenceName:='hull', querySequence:='A'))", "querySequence length 1 does not match the reference sequence length 8 for Nucleotide MutationProfile"),
    ("default.filter(nucleotideMutationProfile(distance:=1, sequenceName:='hull', sequenceId:='no'))", "No sequence found with primary key 'no' in Nucleotide MutationProfile"),
]


@pytest.mark.parametrize(("text", "message"), ERRORS)
def test_errors(db, text, message):
    with pytest.raises(IllegalQuery) as e:
        db.relation(text)
    assert str(e.value).startswith(message)


def test_strict_engine_refuses_late_filters(spark):
    strict = build(spark, strict=True)
    for text in ("default.map({x := 1}).filter(x = 1)", "default.schema().filter(type = 'x')"):
        with pytest.raises(IllegalQuery):
            strict.relation(text)


def test_result_ordering(db):
    assert db.relation("default.orderBy({dep, seen.desc()})").order_metadata() == [
        {"field": "dep", "order": "ascending", "nullPlacement": "atStart"},
        {"field": "seen", "order": "descending", "nullPlacement": "atEnd"},
    ]
    assert db.relation("default").order_metadata() == []
