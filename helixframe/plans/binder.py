"""Syntax tree to DataFrame: names and kinds are resolved here, everything else is Catalyst's.

Each pipeline function takes a Relation and gives one.  A relation that is a scan with filters at most keeps its table, which the sequence and tree operators need.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.catalog.table import Table, insertions, leaf
from helixframe.errors import IllegalQuery, require
from helixframe.functions.alphabets import AMINO_ACID, NUCLEOTIDE, Alphabet
from helixframe.functions.lineages import Recombinants
from helixframe.lang import arguments as A
from helixframe.lang.arguments import Signature, place
from helixframe.lang.tree import Binary, Call, Literal, Name, Node, Not, Record, SetOf
from helixframe.operators import phylogeny, sequences
from helixframe.plans import predicates as P
from helixframe.plans.relation import ROW, Field, Order, Relation, quoted
from helixframe.sources.store import numbered

#: Error messages here and below are fixed values: clients compare them.
_MISSING_COLUMN = "The database does not contain the column '{}'"
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "leftSemi": "left_semi", "rightSemi": "left_semi", "leftAnti": "left_anti", "rightAnti": "left_anti"}


class Binder:
    """Binds one query against a set of tables.

    strict: refuse filters above computed columns, joins and schema(), as some clients expect.
    """

    def __init__(self, tables: Mapping[str, Table], strict: bool = False):
        self.tables, self.strict = tables, strict

    # ------------------------------------------------------------ pipelines

    def relation(self, node: Node) -> Relation:
        if isinstance(node, Name):
            require(node.name in self.tables, f"table '{node.name}' not found in database")
            return self.tables[node.name].scan()
        require(isinstance(node, Call), f"expected table reference or function call at {place(node)}")
        require(node.function in PIPELINE, f"unknown function '{node.function}' at {place(node)}")
        signature, handler = PIPELINE[node.function]
        return handler(self, signature.bind(node), node.function)

    def filter(self, args, _):
        rel = self.relation(args["input"])
        if self.strict and rel.scan is None:
            self._strict_filter(args["input"], args["predicate"], rel)
        return rel.but(df=rel.df.where(self.predicate(args["predicate"], rel).column()))

    def _strict_filter(self, below: Node, predicate: Node, rel: Relation) -> None:
        if not isinstance(below, Call):
            return
        if below.function == "map":
            computed = {n for n, _ in below.positional[-1].fields} if isinstance(below.positional[-1], Record) else set()
            used = _names_in(predicate) & computed
            require(not used, f"filter() cannot reference the computed column '{min(used, default='')}'")
        require(below.function not in ("join", "schema"), f"filter() cannot be applied to the result of {below.function}()")

    def project(self, args, _):
        fields = args["fields"]
        names = [A.name_of(fields)] if isinstance(fields, Name) else A.names_of(fields)
        rel = self.relation(args["input"])
        for n in names:
            require(rel.find(n), f"project field '{n}' is not present in the input's output schema")
        keep = [rel.find(n) for n in dict.fromkeys(names)]
        gone = [o for o in rel.order if not o.hidden and o.name not in names]
        df, hidden, order = rel.df, rel.hidden, rel.order
        if gone:  # sort keys that are no longer shown ride along, for ties
            order = [o if o.hidden or o.name in names else Order(f"__by_{o.name}", o.ascending, True) for o in order]
            df = df.withColumns({f"__by_{o.name}": rel.column(o.name) for o in gone})
            hidden = (*hidden, *[f"__by_{o.name}" for o in gone])
        rest = [h for h in hidden if h not in names]
        return rel.but(df=df.select(*[F.col(quoted(f.name)) for f in keep], *[F.col(quoted(h)) for h in rest]), fields=keep, order=order, hidden=tuple(rest), scan=None)

    def map(self, args, _):
        fields = A.record_of(args["expressions"], "map() expects a record of assignments like {x := 3, y := age}")
        require(fields, "map() requires at least one assignment")
        rel = self.relation(args["input"])
        made: dict[str, tuple[Column, str]] = {}
        for name, value in fields:
            require(name not in made, f"map() assigns the output column '{name}' more than once")
            made[name] = self.scalar(value, rel, f"map() field '{name}'")
        shown = [Field(f.name, made[f.name][1]) if f.name in made else f for f in rel.fields]
        shown += [Field(n, k) for n, (_, k) in made.items() if not rel.find(n)]
        keep = [h for h in rel.hidden if h not in made]
        columns = [made[f.name][0].alias(f.name) if f.name in made else rel.column(f.name) for f in shown]
        order, extra = [], []
        for o in rel.order:
            if o.name in made and not o.hidden:
                extra.append(rel.column(o.name).alias(f"__by_{o.name}"))
                order.append(Order(f"__by_{o.name}", o.ascending, True))
            else:
                order.append(o)
        df = rel.df.select(*columns, *[F.col(quoted(h)) for h in keep], *extra)
        return rel.but(df=df, fields=shown, order=order, hidden=(*keep, *[o.name for o in order if o.name.startswith("__by_") and o.name not in keep]), scan=None)

    def group_by(self, args, _):
        rel = self.relation(args["input"])
        record = A.record_of(args["aggregates"], "groupBy aggregates must be a record literal like {count:=count()}")
        counts = []
        for name, value in record:
            require(isinstance(value, Call), f"aggregate definition '{name}' must be a function call (e.g. count(), sum(col))")
            require(value.function == "count", f"unknown aggregate function '{value.function}'. Valid functions: count")
            if value.positional:
                source = A.name_of(value.positional[0])
                require(rel.find(source), f"source column {source} is not present in the input's output schema")
                raise IllegalQuery("count(<column_ref>) not yet implemented")
            counts.append(name)
        keys = A.names_of(args["columns"]) if "columns" in args else []
        for k in keys:
            require(rel.find(k), f"groupBy field '{k}' is not present in the input's output schema")
        keys = list(dict.fromkeys(keys))
        made = [F.count(F.lit(1)).alias(n) for n in counts]
        if not made:
            df = rel.df.select(*[rel.column(k) for k in keys]).distinct() if keys else rel.df.sparkSession.range(1).select()
        else:
            df = rel.df.groupBy(*[rel.column(k) for k in keys]).agg(*made)
        return Relation(df, [rel.find(k) for k in keys] + [Field(n, "INT64") for n in counts])

    def order_by(self, args, _):
        rel = self.relation(args["input"])
        keys = []
        for item in A.set_of(args["fields"]):
            ascending, name = True, item
            if isinstance(item, Call):
                f = item.function
                require(f in ("asc", "desc"), f"orderBy field must be an identifier or asc()/desc() call, got '{f}' at {place(item)}")
                require(len(item.positional) == 1 and not item.named, f"{f}() expects exactly one argument")
                ascending, name = f == "asc", item.positional[0]
            else:
                require(isinstance(item, Name), f"orderBy field must be an identifier or asc()/desc() call at {place(item)}")
            name = A.name_of(name)
            require(rel.find(name), f"OrderByField {name} is not contained in the result of this operation. Allowed values are {', '.join(rel.names)}.")
            keys.append(Order(name, ascending))
        return self._sorted(rel, keys) if keys else rel

    @staticmethod
    def _sorted(rel: Relation, keys: list[Order]) -> Relation:
        """Sort by the keys; ties keep the order from before, where there is one."""
        seen = {k.name for k in keys}
        before = [o for o in rel.order if o.name not in seen]
        if ROW in rel.hidden and ROW not in {o.name for o in before}:
            before.append(Order(ROW, True, True))
        by = [F.col(quoted(o.name)).asc_nulls_first() if o.ascending else F.col(quoted(o.name)).desc_nulls_last() for o in [*keys, *before]]
        return rel.but(df=rel.df.orderBy(*by), order=[*keys, *[Order(o.name, o.ascending, True) for o in before]], scan=None)

    def randomize(self, args, _):
        rel = self.relation(args["input"])
        seed = A.int_of(args["seed"], "uint32") if "seed" in args else time.time_ns() & 0xFFFFFFFF
        if rel.order:  # the order so far decides a row's ordinal
            by = [F.col(quoted(o.name)).asc_nulls_first() if o.ascending else F.col(quoted(o.name)).desc_nulls_last() for o in rel.order]
            rel = rel.but(df=numbered(rel.df, by, "ordinals", "__place")[0])
            place_ = F.col("__place")
        elif ROW in rel.hidden:
            place_ = F.col(ROW)
        else:
            place_ = F.xxhash64(*[rel.column(n) for n in rel.names])
        df = rel.df.withColumn("__place", place_).withColumn("__shuffle", shuffle_key(seed)(F.col("__place")))
        # the hash is unsigned
        rel = rel.but(df=df, hidden=(*rel.hidden, "__place", "__shuffle"), order=[], scan=None)
        out = self._sorted(rel.but(hidden=tuple(h for h in rel.hidden if h != ROW)), [Order("__shuffle", True, True), Order("__place", True, True)])
        return out.but(hidden=rel.hidden)

    def limit(self, args, _):
        rel = self.relation(args["input"])
        n = A.int_of(args["count"], "uint32")
        require(n > 0, "limit must be a positive number")
        return rel.but(df=rel.df.limit(min(n, (1 << 31) - 1)), scan=None)

    def offset(self, args, _):
        rel = self.relation(args["input"])
        n = A.int_of(args["count"], "uint32")
        if not rel.order and ROW in rel.hidden:
            rel = self._sorted(rel, [])
        return rel.but(df=rel.df.offset(min(n, (1 << 31) - 1)), scan=None)

    def join(self, args, _):
        left, right = self.relation(args["left"]), self.relation(args["right"])
        both = [n for n in left.names if right.find(n)]
        require(not both, f"join() requires the two inputs to have disjoint column names, but the column(s) [{', '.join(both)}] are present in both. Rename one side (e.g. via map()) before joining.")
        keys = self._join_keys(args["on"], left, right)
        kind = A.name_of(args["type"]) if "type" in args else "inner"
        require(kind in _JOINS, f"invalid join type '{kind}'. Valid types are: inner, left, right, full, leftSemi, rightSemi, leftAnti, rightAnti")
        if kind.startswith("right") and kind != "right":
            left, right, keys = right, left, [(r, ln) for ln, r in keys]
        a, b = left.result(), right.result()
        on = [F.col(quoted(x)) == F.col(quoted(y)) for x, y in keys]
        fields = left.fields if _JOINS[kind].startswith("left_") else left.fields + right.fields
        return Relation(a.join(b, on, _JOINS[kind]), list(fields))

    def _join_keys(self, node: Node, left: Relation, right: Relation) -> list[tuple[str, str]]:
        require(isinstance(node, Binary), f"join() on-expression must be an equality between a left and a right column, or a conjunction (&&) of such equalities, at {place(node)}")
        if node.op == "&&":
            return self._join_keys(node.left, left, right) + self._join_keys(node.right, left, right)
        require(node.op == "=", f"join() on-expression only supports equality (=) comparisons, optionally combined with '&&', at {place(node)}")
        sides = []
        for x in (node.left, node.right):
            require(isinstance(x, Name), f"join() on-expression must compare column identifiers, got '{x}' at {place(x)}")
            a, b = left.find(x.name), right.find(x.name)
            require(not (a and b), f"join() on-expression references column '{x.name}', which exists in both inputs and is therefore ambiguous. Rename one side (e.g. via map()) before joining.")
            require(a or b, f"join() on-expression references unknown column '{x.name}'")
            sides.append((0, a) if a else (1, b))
        (s, f), (t, g) = sides
        require(s != t, f"join() on-expression equality must reference one column from each input, but both '{node.left}' and '{node.right}' resolve to the same input at {place(node)}")
        require(
            f.shown == g.shown,
            f"join() on-expression equality must reference equal column types from each input, but '{node.left}' and '{node.right}' have mismatching types {f.shown} and {g.shown} at {place(node)}",
        )
        return [(f.name, g.name) if s == 0 else (g.name, f.name)]

    def union_all(self, args, _):
        left, right = self.relation(args["left"]), self.relation(args["right"])
        told = [", ".join(f"{f.name}:{f.shown}" for f in r.fields) for r in (left, right)]
        require(told[0] == told[1], f"unionAll requires both inputs to have the same schema (same column names, types, and order). Left schema: [{told[0]}], right schema: [{told[1]}].")
        return Relation(left.result().union(right.result()), left.fields)

    def schema(self, args, _):
        rel = self.relation(args["input"])
        df = rel.df.sparkSession.createDataFrame([(f.name, f.shown) for f in rel.fields], "fieldName string, type string")
        return Relation(df, [Field("fieldName", "STRING"), Field("type", "STRING")])

    def _scan_below(self, args, function: str) -> tuple[Relation, Table]:
        rel = self.relation(args["input"])
        require(rel.scan is not None, f"{function}() must be applied to a table scan")
        return rel, rel.scan

    def _sequences(self, args, table: Table, alphabet: Alphabet) -> list[str]:
        names = A.names_of(args["sequenceNames"]) if "sequenceNames" in args else []
        for n in names:
            require(table.kind_of(n) == alphabet.kind, f"The database does not contain the {alphabet.title} sequence '{n}'")
        return names or table.sequences(alphabet)

    def mutations(self, args, function):
        alphabet = NUCLEOTIDE if function == "mutations" else AMINO_ACID
        rel = self.relation(args["input"])
        if "sequenceNames" in args:
            A.names_of(args["sequenceNames"])
        proportion = A.number_of(args["minProportion"])
        require(0 <= proportion <= 1, "Invalid proportion: minProportion must be in interval [0.0, 1.0]")
        chosen = A.names_of(args["fields"]) if "fields" in args else []
        require(rel.scan is not None, "mutations() must be applied to a table scan")
        names = self._sequences(args, rel.scan, alphabet)
        valid = dict(sequences.MUTATION_FIELDS)
        for f in chosen:
            require(f in valid, f"The attribute 'fields' contains an invalid field '{f}'. Valid fields are mutationFrom, mutationTo, position, sequenceName, proportion, coverage, count.")
        fields = [f for f in valid if not chosen or f in chosen]
        df = sequences.mutations(rel.df, rel.scan, names, alphabet, proportion, fields)
        return Relation(df, [Field(f, valid[f]) for f in fields])

    def insertions(self, args, function):
        alphabet = NUCLEOTIDE if function == "insertions" else AMINO_ACID
        rel, table = self._scan_below(args, "insertions")
        df = sequences.insertion_counts(rel.df, self._sequences(args, table, alphabet))
        return Relation(df, [Field(*f) for f in sequences.INSERTION_FIELDS])

    def _tree_column(self, args, function: str, title: str) -> tuple[Relation, str]:
        column = A.text_of(args["column"])
        rel, table = self._scan_below(args, function)
        kind = table.kind_of(column)
        require(kind, f"Column '{column}' not found in table schema")
        tree = f"{title} action cannot be called on Column '{column}' as it does not have a phylogenetic tree associated with it"
        require(kind in ("STRING", "DICTIONARY_ENCODED"), f"{title} action cannot be called on column '{column}' as it is not a column of type STRING")
        require(column in table.trees, tree)
        return rel, column

    def ancestor(self, args, function):
        printed = "printNodesNotInTree" in args and A.bool_of(args["printNodesNotInTree"])
        rel, column = self._tree_column(args, function, "MostRecentCommonAncestor")
        df = phylogeny.common_ancestor(rel.df, column, rel.scan.trees[column], printed)
        kinds = {"missingNodeCount": "INT32", "missingFromTree": "STRING", "mrcaNode": "STRING", "mrcaParent": "STRING", "mrcaDepth": "INT32"}
        return Relation(df, [Field(c, kinds[c]) for c in df.columns])

    def subtree(self, args, function):
        printed = "printNodesNotInTree" in args and A.bool_of(args["printNodesNotInTree"])
        contract = "contractUnaryNodes" not in args or A.bool_of(args["contractUnaryNodes"])
        rel, column = self._tree_column(args, function, "PhyloSubtree")
        df = phylogeny.pruned_subtree(rel.df, column, rel.scan.trees[column], printed, contract)
        return Relation(df, [Field(c, "INT32" if c == "missingNodeCount" else "STRING") for c in df.columns])

    # ------------------------------------------------------------ scalars

    def scalar(self, node: Node, rel: Relation, where: str) -> tuple[Column, str]:
        """A value as a column, and its kind."""
        if isinstance(node, Name):
            f = rel.find(node.name)
            require(f, f"{where} references unknown column '{node.name}' at {place(node)}")
            return rel.column(f.name), f.shown
        if isinstance(node, Literal) and node.value is not None:
            kind = {bool: "BOOL", int: "INT64", float: "FLOAT", str: "STRING"}[type(node.value)]
            return F.lit(node.value).cast("long") if kind == "INT64" else F.lit(node.value), kind
        if A.is_date(node):
            return F.lit(A.date_of(node)), "DATE32"
        if isinstance(node, Call):
            require(node.function in SCALAR or node.function in VALUES, f"{where} references unknown scalar function '{node.function}' at {place(node)}")
            if node.function in VALUES:
                signature, handler = VALUES[node.function]
                return handler(self, signature.bind(node), rel)
            return F.coalesce(self.predicate(node, rel).column(), F.lit(False)), "BOOL"
        raise IllegalQuery(f"{where} must be a literal value (int, float, string, bool, or date), a column reference, or a scalar function call at {place(node)}")

    def at(self, args, rel):
        name = A.name_of(args["input"])
        position = A.int_of(args["position"], "uint32")
        require(position > 0, "at(): the field 'position' is 1-indexed. Value of 0 not allowed.")
        require(rel.find(name), f"at(): the field {name} is not found in the current context")
        return F.substring(rel.column(name).cast("string"), min(position, (1 << 31) - 1), 1), "STRING"

    def iso_week(self, args, rel):
        name = A.name_of(args["input"])
        f = rel.find(name)
        require(f, f"isoWeek(): the field {name} is not found in the current context")
        require(f.kind == "DATE32", f"isoWeek(): the field {name} must be a date column")
        c = rel.column(name)
        return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0")), "STRING"

    # ------------------------------------------------------------ predicates

    def predicate(self, node: Node, rel: Relation) -> P.Predicate:
        if isinstance(node, Not):
            return P.Complement(self.predicate(node.operand, rel))
        if isinstance(node, Binary):
            return self._binary(node, rel)
        if isinstance(node, Literal) and isinstance(node.value, bool):
            return P.Constant(node.value)
        require(isinstance(node, Call), f"unsupported expression type in filter context at {place(node)}")
        if node.function in VALUES:
            _, kind = self.scalar(node, rel, "the predicate")
            raise IllegalQuery(f"scalar function '{node.function}' produces a {kind} value and cannot be used as a filter predicate at {place(node)}")
        require(node.function in SCALAR, f"unknown scalar function '{node.function}'")
        signature, handler = SCALAR[node.function]
        return handler(self, signature.bind(node), rel, node.function)

    def _binary(self, node: Binary, rel: Relation) -> P.Predicate:
        if node.op in ("&&", "||"):
            kind = P.All if node.op == "&&" else P.Any
            return kind([self.predicate(node.left, rel), self.predicate(node.right, rel)])
        if node.op in ("=", "<>"):
            title = "equality" if node.op == "=" else "not-equals"
            one, other = (node.left, node.right) if isinstance(node.left, Name) else (node.right, node.left)
            require(isinstance(one, Name), f"{title} comparison requires an identifier on one side at {place(node.left)}")
            equal = self._equal(one.name, other, rel)
            return equal if node.op == "=" else P.Complement(equal)
        return self._ordering(node, rel)

    def _field(self, name: str, rel: Relation) -> Field:
        f = rel.find(name)
        require(f, _MISSING_COLUMN.format(name))
        return f

    def _value(self, node: Node, where: str) -> object:
        if isinstance(node, Literal) and node.value is not None:
            return node.value
        if A.is_date(node):
            return A.date_of(node)
        raise IllegalQuery(f"{where} must be a literal value (int, float, string, bool, or date), a column reference, or a scalar function call at {place(node)}")

    def _equal(self, name: str, value: Node, rel: Relation) -> P.Predicate:
        if A.is_null(value):
            return P.IsNull(self._field(name, rel).name)
        lone = "An Equals expression can only be compiled to a filter when exactly one side is a column reference and the other a literal value"
        require(not isinstance(value, (Name, Call)), lone)
        found = self._value(value, "the value in an equality")
        f = self._field(name, rel)
        return P.Compare(name, "=", P.typed(f.kind, name, found))

    def _ordering(self, node: Binary, rel: Relation) -> P.Predicate:
        message = "A Comparison expression can only be compiled to a filter when exactly one side is a column reference and the other a literal value"
        sides = []
        for side, where in ((node.left, "the left side of a comparison"), (node.right, "the right side of a comparison")):
            if isinstance(side, Name):
                require(rel.find(side.name), f"{where} references unknown column '{side.name}' at {place(side)}")
                sides.append(None)
            else:
                require(not isinstance(side, Call), message)
                sides.append(self._value(side, where))
        require(isinstance(node.left, Name) != isinstance(node.right, Name), message)
        name, value, op = (node.left.name, sides[1], node.op) if isinstance(node.left, Name) else (node.right.name, sides[0], _FLIPPED[node.op])
        require(not isinstance(value, bool), f"The comparison operators <,>,<=,>= are not supported for boolean column '{name}'")
        return P.Compare(name, op, P.typed(rel.find(name).kind, name, value))

    def between(self, args, rel, _):
        name, low, high = A.name_of(args["column"]), args["from"], args["to"]
        value: Callable[[Node], object]
        if A.is_date(low) or A.is_date(high):
            value, kinds, title = A.date_of, ("DATE32",), "date"
        elif A.is_float(low) or A.is_float(high):
            value, kinds, title = A.number_of, ("FLOAT",), None
        elif A.is_int(low) or A.is_int(high):
            value, kinds, title = A.int_of, ("INT32", "INT64"), "int32 or int64"
        else:
            raise IllegalQuery(f"Could not infer type of between expression. From-value or to-value needs to be a typed non-null value, got from: '{low}' to: '{high}'")
        bounds = [None if A.is_null(x) else value(x) for x in (low, high)]
        f = self._field(name, rel)
        require(f.kind in kinds, f"The column '{name}' is not of type {title}" if title else f"The database does not contain the float column '{name}'")
        for b in bounds if f.kind == "INT32" else ():
            require(b is None or -(1 << 31) <= b < 1 << 31, f"Cannot cast {b} to int32. Value out of range")
        return P.Between(name, *bounds, open_end=title is None)

    def in_set(self, args, rel, _):
        name, values = A.name_of(args["column"]), args["values"]
        require(isinstance(values, SetOf), f"in() expects a set literal argument at {place(values)}")
        chosen = frozenset(A.text_of(x) for x in values.items)
        f = self._field(name, rel)
        require(f.kind in ("STRING", "DICTIONARY_ENCODED"), f"The column '{name}' is not of type string")
        return P.In(name, chosen)

    def is_null(self, args, rel, function):
        found = P.IsNull(self._field(A.name_of(args["column"]), rel).name)
        return found if function == "isNull" else P.Complement(found)

    def like(self, args, rel, _):
        name, pattern = A.name_of(args["column"]), A.text_of(args["pattern"])
        P.check_regex(pattern)
        f = self._field(name, rel)
        require(f.kind in ("STRING", "DICTIONARY_ENCODED"), f"The column '{name}' is not of type string")
        return P.Like(name, pattern)

    def lineage(self, args, rel, _):
        name, value = A.name_of(args["column"]), args["value"]
        chosen = None if A.is_null(value) else A.text_of(value)
        mode = Recombinants.NEVER if "includeSublineages" in args and A.bool_of(args["includeSublineages"]) else None
        if "recombinantFollowingMode" in args:
            told = A.text_of(args["recombinantFollowingMode"])
            require(
                told in {m.value for m in Recombinants},
                f"invalid recombinantFollowingMode: '{told}'. Valid values are: alwaysFollow, followIfFullyContainedInClade, doNotFollow",
            )
            mode = Recombinants(told)
        self._field(name, rel)
        tree = rel.scan.lineages.get(name) if rel.scan else self._lineage_tree(name, rel)
        require(tree, f"The database does not contain a lineage index for the column '{name}'")
        if chosen is None:
            return P.IsNull(name)
        require(chosen in tree, f"The lineage '{chosen}' is not a valid lineage for column '{name}'.")
        own = {tree.resolve(chosen)} if mode is None else tree.descendants(chosen, mode)
        return P.In(name, frozenset(tree.spelled(own)))

    def _lineage_tree(self, name: str, rel: Relation):
        return next((t.lineages[name] for t in self.tables.values() if name in t.lineages), None)

    def descendant_of(self, args, rel, _):
        name, node = A.name_of(args["column"]), A.text_of(args["node"])
        f = self._field(name, rel)
        tree = next((t.trees[name] for t in ([rel.scan] if rel.scan else self.tables.values()) if name in t.trees), None)
        require(f.kind in ("STRING", "DICTIONARY_ENCODED"), f"The column '{name}' is not of type string")
        require(tree, f"Phylotree filter cannot be called on Column '{name}' as it does not have a phylogenetic tree associated with it")
        require(node in tree.number, f"The node '{node}' does not exist in the phylogenetic tree of column '{name}'")
        k = tree.number[node]
        if tree.is_leaf(k):
            return P.Constant(False)
        if leaf(name) in rel.df.columns:
            return P.Between(leaf(name), k, tree.last[k])
        return P.In(name, frozenset(tree.names[x] for x in range(k, tree.last[k] + 1) if tree.is_leaf(x)))

    def _position(self, node: Node) -> int:
        position = A.int_of(node, "uint32")
        require(position > 0, "The field 'position' is 1-indexed. Value of 0 not allowed.")
        return position

    def _sequence(self, node: Node, rel: Relation, alphabet: Alphabet) -> tuple[str, str]:
        """A sequence column and its reference."""
        name = A.text_of(node)
        self._field(name, rel)
        table = rel.scan or next((t for t in self.tables.values() if name in t.references), None)
        require(table and table.kind_of(name) == alphabet.kind, f"The database does not contain the {alphabet.title} sequence '{name}'")
        return name, table.references[name]

    def symbol_equals(self, args, rel, function):
        alphabet = NUCLEOTIDE if function == "nucleotideEquals" else AMINO_ACID
        position = self._position(args["position"])
        told = A.text_of(args["symbol"])
        require(len(told) == 1, f"{function}() symbol must be a single character")
        self._field(A.text_of(args["sequenceName"]), rel)
        symbol = told if told == "." else alphabet.read(told)
        require(symbol, f"{function}() invalid symbol '{told}'")
        name, reference = self._sequence(args["sequenceName"], rel, alphabet)
        require(position <= len(reference), f"SymbolEquals<{alphabet.title}> position is out of bounds {position} > {len(reference)}")
        symbol = reference[position - 1] if symbol == "." else symbol
        return P.Symbols(name, position, lambda mode: alphabet.may_be[symbol] if mode == P.UPPER else frozenset(symbol))

    def has_mutation(self, args, rel, function):
        alphabet = NUCLEOTIDE if function == "hasMutation" else AMINO_ACID
        position = self._position(args["position"])
        name, reference = self._sequence(args["sequenceName"], rel, alphabet)
        require(position <= len(reference), f"Has{alphabet.title}Mutation position is out of bounds {position} > {len(reference)}")
        own, every = reference[position - 1], frozenset(alphabet.symbols)
        return P.Symbols(name, position, lambda mode: every - {own} if mode == P.UPPER else every - alphabet.may_be[own])

    def insertion_contains(self, args, rel, function):
        alphabet = NUCLEOTIDE if function == "insertionContains" else AMINO_ACID
        position, value = A.int_of(args["position"], "uint32"), A.text_of(args["value"])
        require(value, "The field 'value' in an InsertionContains expression must not be an empty string")
        name, reference = self._sequence(args["sequenceName"], rel, alphabet)
        require(position <= len(reference), f"the requested insertion position ({position}) is larger than the length of the reference sequence ({len(reference)}) for sequence '{name}'")
        rest, good = value, True
        while rest and good:
            step = 2 if rest.startswith(".*") or (rest[0] == "\\" and len(rest) > 1) else 1
            good = rest.startswith(".*") or (alphabet.read(rest[step - 1]) is not None and rest[0] != "*")
            rest = rest[step:]
        title = {"Nucleotide": "nucleotide", "AminoAcid": "amino acid"}[alphabet.title]
        require(
            good,
            f"The field 'value' in the InsertionContains expression does not contain a valid regex pattern: \"{value}\". It must only consist of {title} symbols and the regex symbol '.*'. "
            "Also note that the stop codon * must be escaped correctly with a \\ in amino acid queries.",
        )
        return P.InsertionContains(insertions(name), position, value)

    def mode(self, args, rel, function):
        return P.Mode(self.predicate(args["child"], rel), P.UPPER if function == "maybe" else P.LOWER)

    def n_of(self, args, rel, _):
        n = A.int_of(args["count"], "int32")
        exactly = "matchExactly" in args and A.bool_of(args["matchExactly"])
        return P.NOf(n, [self.predicate(x, rel) for x in A.set_of(args["children"])], exactly)

    def profile(self, args, rel, function):
        alphabet = NUCLEOTIDE if function.startswith("nucleotide") else AMINO_ACID
        title = alphabet.title
        distance = A.int_of(args["distance"], "uint32")
        self._field(A.text_of(args["sequenceName"]), rel)
        given = [k for k in ("querySequence", "sequenceId", "mutations") if k in args]
        require(len(given) == 1, f"Exactly one of 'querySequence', 'sequenceId', or 'mutations' must be provided in a {title} MutationProfile expression, but {len(given)} were provided")
        changes = self._profile_changes(args["mutations"], alphabet) if given == ["mutations"] else []
        told = A.text_of(args[given[0]]) if given != ["mutations"] else ""
        name, reference = self._sequence(args["sequenceName"], rel, alphabet)
        if given == ["querySequence"]:
            require(len(told) == len(reference), f"querySequence length {len(told)} does not match the reference sequence length {len(reference)} for {title} MutationProfile")
            own = [alphabet.read(c) for c in told]
            if None in own:
                raise IllegalQuery(f"Invalid {title} symbol '{told[own.index(None)]}' in querySequence for MutationProfile")
        elif given == ["sequenceId"]:
            table = rel.scan or next(t for t in self.tables.values() if name in t.references)
            found = table.df.where(F.col(quoted(table.primary_key)) == told).select(quoted(name)).limit(1).collect()
            require(found, f"No sequence found with primary key '{told}' in {title} MutationProfile")
            if found[0][0] is None:  # no sequence to stand for: every symbol of the others differs
                return P.Constant(True) if distance >= len(reference) else P.IsNull(name)
            own = list(found[0][0])
        else:
            own = list(reference)
            for position, symbol in changes:
                require(position <= len(own), f"{title} MutationProfile mutation position {position} is out of bounds (reference length {len(own)})")
                own[position - 1] = symbol
        return P.Profile(name, "".join(own), distance, alphabet)

    @staticmethod
    def _profile_changes(node: Node, alphabet: Alphabet) -> list[tuple[int, str]]:
        title, out = alphabet.title, []
        require(isinstance(node, SetOf), f"The 'mutations' argument of a {title} MutationProfile expression must be a set literal")
        for item in node.items:
            require(isinstance(item, Record), f"Each element of 'mutations' in a {title} MutationProfile expression must be a record literal with 'position' and 'symbol' fields")
            own = dict(item.fields)
            for key in ("position", "symbol"):
                require(key in own, f"Each mutation in a {title} MutationProfile expression must have a '{key}' field")
            position, told = A.int_of(own["position"], "uint32"), A.text_of(own["symbol"])
            require(position > 0, f"The 'position' field in a {title} MutationProfile mutation is 1-indexed; value 0 is not allowed")
            require(len(told) == 1, f"The 'symbol' field in a {title} MutationProfile mutation must be a single character")
            symbol = alphabet.read(told)
            require(symbol, f"Invalid {title} symbol '{told}' in MutationProfile")
            out.append((position, symbol))
        return out


def _names_in(node: Node) -> set[str]:
    if isinstance(node, Name):
        return {node.name}
    parts: list[Node] = []
    if isinstance(node, Binary):
        parts = [node.left, node.right]
    elif isinstance(node, Not):
        parts = [node.operand]
    elif isinstance(node, Call):
        parts = [*node.positional, *[x for _, x in node.named]]
    elif isinstance(node, SetOf):
        parts = list(node.items)
    return set().union(*map(_names_in, parts)) if parts else set()


def shuffle_key(seed: int):
    """A 64-bit finaliser of a row's place and the seed, as a long that sorts like the unsigned value (fixed constants)."""

    @F.pandas_udf("long")
    def key(place_: pd.Series) -> pd.Series:
        x = place_.to_numpy(np.int64).view(np.uint64) ^ np.uint64(seed)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(33))
        return pd.Series((x ^ np.uint64(1 << 63)).view(np.int64))

    return key


PIPELINE = {
    "filter": (Signature("input", "predicate"), Binder.filter),
    "project": (Signature("input", "fields"), Binder.project),
    "map": (Signature("input", "expressions"), Binder.map),
    "groupBy": (Signature("input", "aggregates", "columns?"), Binder.group_by),
    "orderBy": (Signature("input", "fields"), Binder.order_by),
    "limit": (Signature("input", "count"), Binder.limit),
    "offset": (Signature("input", "count"), Binder.offset),
    "randomize": (Signature("input", "seed?:"), Binder.randomize),
    "join": (Signature("left", "right", "on", "type?:"), Binder.join),
    "unionAll": (Signature("left", "right"), Binder.union_all),
    "schema": (Signature("input"), Binder.schema),
    "mutations": (Signature("input", "minProportion:", "sequenceNames?:", "fields?:"), Binder.mutations),
    "aminoAcidMutations": (Signature("input", "minProportion:", "sequenceNames?:", "fields?:"), Binder.mutations),
    "insertions": (Signature("input", "sequenceNames?:"), Binder.insertions),
    "aminoAcidInsertions": (Signature("input", "sequenceNames?:"), Binder.insertions),
    "mostRecentCommonAncestor": (Signature("input", "column", "printNodesNotInTree?:"), Binder.ancestor),
    "phyloSubtree": (Signature("input", "column", "printNodesNotInTree?:", "contractUnaryNodes?:"), Binder.subtree),
}
_SYMBOL = Signature("position:", "symbol:", "sequenceName:")
_PROFILE = Signature("distance:", "sequenceName:", "querySequence?:", "sequenceId?:", "mutations?:")
SCALAR = {
    "between": (Signature("column", "from", "to"), Binder.between),
    "in": (Signature("column", "values"), Binder.in_set),
    "isNull": (Signature("column"), Binder.is_null),
    "isNotNull": (Signature("column"), Binder.is_null),
    "like": (Signature("column", "pattern"), Binder.like),
    "lineage": (Signature("column", "value", "includeSublineages?:", "recombinantFollowingMode?:"), Binder.lineage),
    "phyloDescendantOf": (Signature("column", "node"), Binder.descendant_of),
    "nucleotideEquals": (_SYMBOL, Binder.symbol_equals),
    "aminoAcidEquals": (_SYMBOL, Binder.symbol_equals),
    "hasMutation": (Signature("position:", "sequenceName:"), Binder.has_mutation),
    "hasAAMutation": (Signature("position:", "sequenceName:"), Binder.has_mutation),
    "insertionContains": (Signature("position:", "value:", "sequenceName:"), Binder.insertion_contains),
    "aminoAcidInsertionContains": (Signature("position:", "value:", "sequenceName:"), Binder.insertion_contains),
    "maybe": (Signature("child"), Binder.mode),
    "exact": (Signature("child"), Binder.mode),
    "nOf": (Signature("count", "children", "matchExactly?:"), Binder.n_of),
    "nucleotideMutationProfile": (_PROFILE, Binder.profile),
    "aminoAcidMutationProfile": (_PROFILE, Binder.profile),
}
#: Scalar functions that give values, not predicates.
VALUES = {"at": (Signature("input", "position"), Binder.at), "isoWeek": (Signature("input"), Binder.iso_week)}
