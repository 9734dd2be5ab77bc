"""Lineages, trees, configurations, alphabets and dates."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from helixframe.errors import ConfigError, InputError
from helixframe.functions.alphabets import AMINO_ACID, NUCLEOTIDE
from helixframe.functions.lineages import LineageTree, Recombinants
from helixframe.functions.trees import Tree
from helixframe.lang.arguments import to_date
from helixframe.sources.config import Config, References
from tests.fixture import CONFIG, LINEAGES


def test_ambiguity_follows_from_the_codes():
    assert NUCLEOTIDE.may_be["A"] == set("ARWMDHVN")
    assert NUCLEOTIDE.may_be["R"] == set("RDVN") and NUCLEOTIDE.may_be["N"] == {"N"} and NUCLEOTIDE.may_be["-"] == set("-N")
    assert AMINO_ACID.may_be["D"] == set("DBX") and AMINO_ACID.may_be["*"] == set("*X")
    assert NUCLEOTIDE.read("u") == "T" and NUCLEOTIDE.read("J") is None


def test_recombinants():
    tree = LineageTree.from_yaml("R: {}\nA: {parents: [R]}\nB: {parents: [R]}\nX: {parents: [A, B]}\nY: {parents: [X]}\nOther: {}\nZ: {parents: [A, Other]}\n")
    assert tree.clade_ancestors == {"X": "R", "Z": None}
    assert tree.descendants("A", Recombinants.NEVER) == {"A"}
    assert tree.descendants("A", Recombinants.ALWAYS) == {"A", "X", "Y", "Z"}
    assert tree.descendants("R", Recombinants.CONTAINED) == {"R", "A", "B", "X", "Y"}
    assert tree.descendants("X", Recombinants.NEVER) == {"X", "Y"}


def test_lineage_names_and_aliases():
    tree = LineageTree.from_yaml(LINEAGES + "'1.10': {parents: [OLD.SEA]}\n")
    assert tree.parents["1.10"] == ["Baltic"] and "OLD.SEA" in tree
    assert tree.spelled(tree.descendants("OLD.SEA", Recombinants.NEVER)) == ["1.10", "Baltic", "Baltic.west", "OLD.SEA"]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("A: {parents: [B]}", "The lineage 'B' which is specified as the parent of lineage 'A' does not have a definition itself."),
        ("A: {parents: [B]}\nB: {parents: [A]}", "The given lineages contain the cycle"),
        ("A: 3", "The lineage 'A' is not defined as a valid YAML Map"),
        ("A: {x: 1}", "The definition of lineage 'A' may only contain"),
        ("A: {parents: x}", "The parents of lineage 'A' are not defined as a YAML Sequence"),
    ],
)
def test_wrong_lineages(text, message):
    with pytest.raises(InputError, match=message.replace("(", r"\(")):
        LineageTree.from_yaml(text)


def test_newick():
    tree = Tree.from_newick(" ((a:1,b:2.5)[note]x:0.1, c )r;\n")
    assert tree.names == ["r", "x", "a", "b", "c"] and tree.length == [None, pytest.approx(0.1), 1.0, 2.5, None]
    assert tree.subtree({2, 3}) == "(a:1,b:2.5)x;"
    assert tree.subtree({2, 4}) == "(a:1.1,c)r;" and tree.subtree({2, 4}, contract=False) == "((a:1)x:0.1,c)r;"
    assert tree.names[tree.common(2, 3)] == "x" and tree.names[tree.common(2, 4)] == "r"
    assert tree.subtree(set()) == "" and tree.subtree({3}) == "b;"


def test_auspice_children_are_printed_in_reverse():
    tree = Tree.from_auspice('{"tree": {"name": "r", "children": [{"name": "a", "node_attrs": {"div": 1}}, {"name": "b"}]}}')
    assert tree.subtree({tree.number["a"], tree.number["b"]}) == "(b,a:1)r;"


@pytest.mark.parametrize("text", ["", "(a,b)r", "(a,b;", "a,b);", "(a,a)r;", "(a,b)r;x", "(a:x,b)r;", "(a,b]r;", "(a b)r;", "(a,b)r$;"])
def test_wrong_newick(text):
    with pytest.raises(InputError):
        Tree.from_newick(text)


def test_deep_trees():
    tree = Tree.from_newick("(" * 20_000 + "leaf" + "".join(f")n{k}" for k in range(20_000)) + ";")
    assert tree.depth[tree.number["leaf"]] == 20_000 and tree.subtree({tree.number["leaf"], 0})


@given(st.recursive(st.just([]), lambda c: st.lists(c, min_size=1, max_size=3), max_leaves=12))
def test_whole_trees_print_as_they_were_read(shape):
    count = iter(range(1000))

    def text(node) -> str:
        name = f"n{next(count)}"
        return f"({','.join(map(text, node))}){name}" if node else name

    newick = text(shape) + ";"
    tree = Tree.from_newick(newick)
    leaves = {k for k in range(len(tree.names)) if tree.is_leaf(k)}
    if len(leaves) > 1 and tree.common(min(leaves), max(leaves)) == 0:
        assert tree.subtree(leaves, contract=False) == newick


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (("name: seen, type: date", "name: waters, type: date"), "Metadata waters is defined twice in the config"),
        (("name: dep, type: int", "name: dep, type: int, generateIndex: true"), "Metadata 'dep' generateIndex is set, but generating an index is only allowed for types STRING"),
        (("name: dep, type: int", "name: dep, type: int, isPhyloTreeField: true"), "Metadata 'dep' isPhyloTreeField is set, but the column is not of type STRING."),
        (("name: dep, type: int", "name: dep, type: odd"), "Unknown metadata type: odd"),
        (("name: harbour, type: string, generateIndex: true", "name: harbour, type: string, generateLineageIndex: x"), "Metadata 'harbour' generateLineageIndex is set, generateIndex must also be set."),
        (("name: harbour, type: string, generateIndex: true", "name: harbour, type: string, lineageIndexType: table"), "Metadata 'harbour' lineageIndexType is set to 'table', but generateLineageIndex is not set."),
        (("isPhyloTreeField: true", "isPhyloTreeField: true, generateIndex: true"), "Metadata 'specimenId' isPhyloTreeField and generateIndex are both set, if isPhyloTreeField is set then generateIndex cannot be set."),
        (("primaryKey: specimenId", "primaryKey: other"), "Primary key is not in metadata"),
        (("lineageIndexType: both", "lineageIndexType: odd"), "Unknown lineageIndexType: 'odd'. Must be one of 'columnMetadata', 'table', 'both'."),
    ],
)
def test_wrong_configs(change, message):
    with pytest.raises(ConfigError) as e:
        Config.from_yaml(CONFIG.replace(*change))
    assert str(e.value) == message


def test_references():
    assert References.from_json('{"nucleotideSequences": [{"name": "s", "sequence": "acu"}], "genes": []}').nucleotides == {"s": "ACT"}
    with pytest.raises(InputError):
        References.from_json('{"genes": [{"name": "s", "sequence": "1"}]}')


@pytest.mark.parametrize("text", ["2020-1-01", "2020-13-01", "2021-02-29", "20200101", "2020-0a-01"])
def test_wrong_dates(text):
    with pytest.raises(ValueError):
        to_date(text)


@given(st.lists(st.lists(st.integers(0, 30), max_size=3), min_size=2, max_size=12))
def test_clade_ancestors_by_all_ways_up(shape):
    parents = {f"n{k}": sorted({f"n{p % k}" for p in own}) if k else [] for k, own in enumerate(shape)}
    tree = LineageTree(parents, {})

    def ways(name: str) -> list[set[str]]:
        return [{name} | w for p in parents[name] for w in ways(p)] or [{name}]

    for name, own in parents.items():
        if len(own) > 1:
            always = set.intersection(*[w - {name} for w in ways(name)])
            closest = [x for x in always if all(x == y or y in set.intersection(*ways(x)) for y in always)]
            assert tree.clade_ancestors[name] == (closest[0] if closest else None)
