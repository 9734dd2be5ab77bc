"""Operators on a tree column: the most recent common ancestor, and the pruned subtree.

The rows are reduced to one first: the smallest and largest node number bound a common ancestor, as the numbers are in preorder.  Only then does the tree turn numbers
into names: in the one task that has the row, or on the driver where the tree is too large to be sent.  Labels outside the tree are gathered only if their names are asked
for, and then distinct, as the one text that the result has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.catalog.table import BROADCAST_LABELS, pre, with_tree_numbers
from helixframe.functions.trees import Tree
from helixframe.plans.relation import quoted


def _missing(column: str):
    """Null rows and distinct labels outside the tree."""
    odd = F.when(F.col(quoted(pre(column))).isNull(), F.col(quoted(column)))
    return F.count(F.when(F.col(quoted(column)).isNull(), 1)).alias("nulls"), odd


def common_ancestor(df: DataFrame, column: str, tree: Tree, print_missing: bool) -> DataFrame:
    df = with_tree_numbers(df, column, tree)
    nulls, odd = _missing(column)
    number = F.col(quoted(pre(column)))
    names = F.array_join(F.sort_array(F.collect_set(odd)), ",") if print_missing else F.lit("")
    one = df.agg(nulls, F.countDistinct(odd).alias("odd"), names.alias("names"), F.min(number).alias("lo"), F.max(number).alias("hi"))

    def look_up(t: Tree, r) -> tuple:
        node = None if pd.isna(r.lo) else t.common(int(r.lo), int(r.hi))
        up = None if node is None or t.parent[node] < 0 else t.names[t.parent[node]]
        return r.nulls + r.odd, r.names, None if node is None else t.names[node], up, None if node is None else t.depth[node]

    out = _with_tree(one, tree, look_up, {"missingNodeCount": "int", "missingFromTree": "string", "mrcaNode": "string", "mrcaParent": "string", "mrcaDepth": "int"})
    return out if print_missing else out.drop("missingFromTree")


def _with_tree(one: DataFrame, tree: Tree, row: Callable[[Tree, Any], tuple], fields: dict[str, str]) -> DataFrame:
    """``row`` of the tree and the one row."""
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    if len(tree.names) > BROADCAST_LABELS:
        return one.sparkSession.createDataFrame([row(tree, r) for r in one.toPandas().itertuples()], schema)
    sent = one.sparkSession.sparkContext.broadcast(tree)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = pd.DataFrame([row(sent.value, r) for r in p.itertuples()], columns=list(fields))
            yield out.astype({n: "Int32" for n, t in fields.items() if t == "int"})

    return one.mapInPandas(run, schema)


def pruned_subtree(df: DataFrame, column: str, tree: Tree, print_missing: bool, contract: bool) -> DataFrame:
    df = with_tree_numbers(df, column, tree)
    nulls, odd = _missing(column)
    names = F.array_join(F.sort_array(F.collect_set(odd)), ",") if print_missing else F.lit("")
    # the distinct nodes are bounded by the tree, which is known here
    one = df.agg(nulls, F.countDistinct(odd).alias("odd"), names.alias("names"), F.collect_set(F.col(quoted(pre(column)))).alias("nodes"))

    def draw(t: Tree, r) -> tuple:
        return r.nulls + r.odd, r.names, t.subtree({int(x) for x in r.nodes}, contract)

    out = _with_tree(one, tree, draw, {"missingNodeCount": "int", "missingFromTree": "string", "subtreeNewick": "string"})
    return out if print_missing else out.drop("missingFromTree")
