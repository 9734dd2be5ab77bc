"""A table: a DataFrame with typed columns, reference sequences, lineages and trees.

Hidden columns ride beside the shown ones: ``__row``, the place of ingestion; ``<sequence>__ins``, the insertions; and ``<column>__pre`` and ``<column>__leaf``, the
number of the tree node (of the leaf) that a label names, null where there is none, so that a clade is an interval.  Rows are numbered when they are ingested; a DataFrame
that is registered gets tree numbers in the operators that need them, and no scan pays for them otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.errors import InputError
from helixframe.functions.alphabets import BY_KIND, Alphabet
from helixframe.functions.lineages import LineageTree
from helixframe.functions.trees import Tree
from helixframe.plans.relation import ROW, Field, Relation, quoted

#: A tree of more labels than this is joined, not sent whole to every task.
BROADCAST_LABELS = 2_000_000


@dataclass
class Table:
    name: str
    df: DataFrame
    fields: list[Field]
    primary_key: str
    references: dict[str, str] = field(default_factory=dict)
    lineages: dict[str, LineageTree] = field(default_factory=dict)
    lineage_texts: dict[str, str] = field(default_factory=dict)
    trees: dict[str, Tree] = field(default_factory=dict)
    lenient_lineages: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.fields = sorted(self.fields, key=lambda f: f.name)

    def kind_of(self, name: str) -> str | None:
        return next((f.kind for f in self.fields if f.name == name), None)

    def sequences(self, alphabet: Alphabet) -> list[str]:
        return [f.name for f in self.fields if f.kind == alphabet.kind]

    def alphabet_of(self, name: str) -> Alphabet:
        return BY_KIND[self.kind_of(name)]

    def scan(self) -> Relation:
        hidden = tuple(c for c in self.df.columns if c not in {f.name for f in self.fields})
        return Relation(self.df, list(self.fields), [], self, hidden)


def pre(column: str) -> str:
    return f"{column}__pre"


def insertions(sequence: str) -> str:
    return f"{sequence}__ins"


def leaf(column: str) -> str:
    return f"{column}__leaf"


def with_tree_numbers(df: DataFrame, column: str, tree: Tree) -> DataFrame:
    if pre(column) in df.columns:
        return df
    rows = [(n, k, k if tree.is_leaf(k) else None) for n, k in tree.number.items()]
    labels = df.sparkSession.createDataFrame(rows, f"__label string, {quoted(pre(column))} int, {quoted(leaf(column))} int")
    if len(tree.names) <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    return df.join(labels, F.col(quoted(column)) == F.col("__label"), "left").drop("__label")


def check_primary_key(df: DataFrame, key: str) -> None:
    twice = df.groupBy(quoted(key)).count().where("count > 1").limit(1).collect()
    if twice:
        raise InputError(f"Found duplicate primary key {twice[0][0]}")


def check_lineages(df: DataFrame, column: str, tree: LineageTree) -> None:
    known = df.sparkSession.createDataFrame([(n,) for n in tree.names()], "__known string")
    odd = df.select(F.col(quoted(column)).alias("v")).where("v IS NOT NULL").distinct().join(known, F.col("v") == F.col("__known"), "left_anti").limit(1).collect()
    if odd:
        raise InputError(f"The value '{odd[0][0]}' is not a valid lineage value for column '{column}'. Is your lineage definition file outdated?")


def check_tree_binding(df: DataFrame, column: str) -> None:
    twice = df.where(F.col(quoted(pre(column))).isNotNull()).groupBy(quoted(column)).count().where("count > 1").limit(1).collect()
    if twice:
        raise InputError(f"The tree node '{twice[0][0]}' of column '{column}' is bound to more than one row")


def with_rows(df: DataFrame, first: int = 0) -> DataFrame:
    """Number the rows in their present order; the numbers rise with it and need no exchange."""
    return df.withColumn(ROW, F.monotonically_increasing_id() + F.lit(first))
