"""The embedding API: a database is a set of tables; queries give DataFrames."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.catalog import table as tables
from helixframe.catalog.table import Table, insertions, with_rows
from helixframe.errors import InputError, require
from helixframe.functions.alphabets import AMINO_ACID, BY_KIND, NUCLEOTIDE, Alphabet
from helixframe.functions.lineages import LineageTree
from helixframe.functions.trees import Tree
from helixframe.lang import arguments as A
from helixframe.lang.parser import parse
from helixframe.plans.binder import Binder
from helixframe.plans.relation import ROW, SPARK_TYPES, Field, Relation, quoted
from helixframe.sources import arrow, ndjson
from helixframe.sources.config import Config, References, read_reference, table_fields
from helixframe.sources.store import Folder, written

#: Names of the API and its error messages are fixed values: clients compare them.
VERSION = "0.1.0"
#: States of another format are never loaded.
FORMAT = 1764115200
DEFAULT = "default"
#: Bytes of rows, as their columns suggest, that a part of a clustered table may have on average.
PART_BYTES = 64 << 20


@dataclass(frozen=True)
class State:
    path: Folder
    timestamp: int


class Database:
    """``Database()`` is empty; ``Database(path=...)`` loads a saved state (or the latest one below a directory)."""

    def __init__(self, path: str | None = None, spark: SparkSession | None = None, strict: bool = False):
        self.spark = spark or SparkSession.active()
        self.strict = strict
        self.tables: dict[str, Table] = {}
        self.version = int(time.time())
        if path is not None:
            self._load(Folder(self.spark, path))

    # ------------------------------------------------------------ tables

    def get_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.tables)], "table_name string")

    def register(self, name: str, df: DataFrame, kinds: dict[str, str], primary_key: str, **more) -> Table:
        """Take a DataFrame as a table; ``kinds`` names its column kinds, and ``<sequence>__ins`` columns hold insertions.

        Rows get no numbers until they are asked for: numbering would keep filters from reaching the reader.
        """
        require(name not in self.tables, f"the table '{name}' already exists", InputError)
        for n, k in kinds.items():
            if k in BY_KIND and insertions(n) not in df.columns:
                df = df.withColumn(insertions(n), F.array().cast("array<struct<pos:int,ins:string>>"))
        self.tables[name] = Table(name, df, [Field(n, k) for n, k in kinds.items()], primary_key, **more)
        return self.tables[name]

    def _empty(self, name: str, fields: list[Field], primary_key: str, **more) -> Table:
        columns = [f"{quoted(f.name)} {SPARK_TYPES[f.kind].simpleString()}" for f in fields]
        columns += [f"{quoted(insertions(f.name))} array<struct<pos:int,ins:string>>" for f in fields if f.kind in BY_KIND]
        df = self.spark.createDataFrame([], ", ".join([*columns, f"{ROW} long"]))
        return self.register(name, df, {f.name: f.kind for f in fields}, primary_key, **more)

    def _sequence_table(self, name: str, key: str, sequence: str, reference: str, extra: list[str] | None, alphabet: Alphabet) -> Table:
        for title, value in (("table_name", name), ("primary_key_name", key), ("sequence_name", sequence), ("reference_sequence", reference)):
            if not value or not value.strip():
                raise ValueError(f"{title} cannot be empty")
        for c in extra or []:
            if not isinstance(c, str):
                raise TypeError(f"extra_columns must contain strings, got {type(c)}")
        fields = [Field(key, "STRING"), Field(sequence, alphabet.kind), *[Field(c, "STRING") for c in extra or []]]
        return self._empty(name, fields, key, references={sequence: read_reference(reference, alphabet)})

    def create_nucleotide_sequence_table(self, table_name, primary_key_name, sequence_name, reference_sequence, extra_columns=None) -> Table:
        return self._sequence_table(table_name, primary_key_name, sequence_name, reference_sequence, extra_columns, NUCLEOTIDE)

    def create_gene_table(self, table_name, primary_key_name, gene_name, reference_sequence, extra_columns=None) -> Table:
        return self._sequence_table(table_name, primary_key_name, gene_name, reference_sequence, extra_columns, AMINO_ACID)

    @classmethod
    def initialize(cls, config: str, references: str, lineages: dict[str, str] | None = None, tree: Tree | None = None, spark: SparkSession | None = None, unaligned: bool = True, strict: bool = False) -> Database:
        """An empty database from the texts of a configuration, reference sequences and lineage definitions by name."""
        db = cls(spark=spark, strict=strict)
        own, refs = Config.from_yaml(config), References.from_json(references)
        fields = table_fields(own, refs, unaligned)
        texts = lineages or {}
        trees = {n: LineageTree.from_yaml(t) for n, t in texts.items()}
        more: dict[str, dict] = {"lineages": {}, "lineage_texts": {}, "trees": {}}
        for m in own.metadata:
            if m.lineage is not None:
                name = next((n for n in trees if n == m.lineage or Path(n).stem == m.lineage), None)
                require(name, f"Column '{m.name}' has lineage tree '{m.lineage}' configured, but did not find corresponding lineage tree in the provided lineageDefinitionFilenames: {','.join(texts)}", InputError)
                if m.lineage_index in ("columnMetadata", "both"):
                    more["lineages"][m.name], more["lineage_texts"][m.name] = trees[name], texts[name]
                if m.lineage_index in ("table", "both"):
                    db._relation_table(m.name, trees[name])
            if m.tree:
                more["trees"][m.name] = tree or Tree([], [], [])
        lenient = {m.name for m in own.metadata if m.lenient}
        db._empty(DEFAULT, fields, own.primary_key, references=refs.nucleotides | refs.genes, lenient_lineages=lenient, **more)
        return db

    def _relation_table(self, column: str, tree: LineageTree) -> None:
        require(column not in self.tables, f"Cannot create lineage relation table '{column}': a table with that name already exists.", InputError)
        df = self.spark.createDataFrame(tree.relation(), "id string, lineage string, parent string, is_recombinant_edge boolean, recombinant_clade_ancestor string")
        self.register(column, df, {c: "BOOL" if c == "is_recombinant_edge" else "STRING" for c in df.columns}, "id")

    @classmethod
    def preprocess(cls, config: str, references: str, data: str, **more) -> Database:
        """``initialize``, then append a file and check that primary keys are unique."""
        db = cls.initialize(config, references, **more)
        db.append_data_from_file(DEFAULT, data)
        own = db.tables[DEFAULT]
        tables.check_primary_key(own.df, own.primary_key)
        return db

    # ------------------------------------------------------------ data

    def _table(self, name: str) -> Table:
        require(name in self.tables, f"table '{name}' not found in database", InputError)
        return self.tables[name]

    def append(self, name: str, df: DataFrame, cluster: str | None = None, parts: int = 0, order: Sequence[str] = ()) -> None:
        """Add typed rows (as ``ndjson.parsed`` gives them) to a table: they are checked and written once, and then part of it, or not at all.

        With ``cluster`` rows are laid out by the covered range of that sequence, in ``parts`` parts (0: as many as Spark chooses), or in more if so many would get large; ``order`` names columns, such as a
        date, by which the rows of a part are sorted.  Readers skip row groups by either.
        """
        own = self._table(name)
        if cluster:
            df = self._clustered(own, df, cluster, parts, order)
        elif order:
            df = df.sortWithinPartitions(*map(quoted, order))
        for column, tree in own.trees.items():
            df = tables.with_tree_numbers(df, column, tree)
        numbered = ROW in own.df.columns
        for column, tree in own.trees.items():
            own.df = tables.with_tree_numbers(own.df, column, tree)
        if not numbered:
            own.df = written(with_rows(own.df), name)
        last = own.df.agg(F.max(ROW)).first()[0]
        df = written(with_rows(df, 0 if last is None else last + 1), name)
        for column, tree in own.lineages.items():
            if column not in own.lenient_lineages:
                tables.check_lineages(df, column, tree)
        merged = own.df.unionByName(df)
        for column in own.trees:
            tables.check_tree_binding(merged, column)
        own.df = merged
        self.version = max(self.version + 1, int(time.time()))

    def append_data_from_file(self, table_name: str, file_name: str, **layout) -> None:
        own = self._table(table_name)
        self.append(table_name, ndjson.read(self.spark, file_name, own.fields, own.references), **layout)

    def append_data_from_string(self, table_name: str, json_string: str, **layout) -> None:
        if not json_string or not json_string.strip():
            raise ValueError("json_string cannot be empty")
        own = self._table(table_name)
        text = self.spark.createDataFrame([(x,) for x in json_string.split("\n") if x.strip()], "value string").coalesce(1)
        self.append(table_name, ndjson.parsed(text, own.fields, own.references, '"sequenceCompressed"' in json_string), **layout)

    @staticmethod
    def _clustered(own: Table, df: DataFrame, sequence: str, parts: int, order: Sequence[str] = ()) -> DataFrame:
        missing = own.alphabet_of(sequence).missing
        c = F.col(quoted(sequence))
        first = F.length(c) - F.length(F.ltrim(c, F.lit(missing)))
        last = F.length(F.rtrim(c, F.lit(missing)))
        keys = ["__from", "__to"]
        row_bytes = 32 * len(own.fields) + 2 * sum(map(len, own.references.values()))
        least = -(-df.count() * row_bytes // PART_BYTES)
        df = df.withColumns({"__from": first, "__to": last})
        if least > max(parts, 1):  # more than the parts may hold: a range that many rows share is cut as well, by the order and then by key
            df = df.repartitionByRange(least, *keys, *map(quoted, order), F.xxhash64(F.col(quoted(own.primary_key))))
        else:
            df = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
        return df.sortWithinPartitions(*keys, *map(quoted, order)).drop(*keys)

    def clustered(self, name: str, sequence: str, parts: int) -> DataFrame:
        """A table's rows laid out by the covered range of a sequence, so that row groups can be skipped by it."""
        own = self._table(name)
        return self._clustered(own, own.df, sequence, parts)

    def update_column(self, table_name: str, column_name: str, value: str, filter_expression: str = "") -> None:
        """Set one literal (or null) for the rows that a filter selects."""
        if not column_name or not column_name.strip():
            raise ValueError("column_name cannot be empty")
        own = self._table(table_name)
        kind = own.kind_of(column_name)
        require(kind, f"The database does not contain the column '{column_name}'")
        require(column_name not in own.trees, f"Column '{column_name}' is backed by a phylogenetic tree and cannot be updated, because it would break the tree's row bindings")
        require(column_name not in own.lineages, f"Column '{column_name}' is backed by a lineage index and cannot be updated")
        require(kind not in BY_KIND, f"Updating columns of type '{kind}' is not supported (column '{column_name}')")
        node = parse(value)
        readers = {"INT32": lambda n: A.int_of(n, "int32"), "INT64": A.int_of, "FLOAT": A.number_of, "DATE32": A.date_of, "BOOL": A.bool_of}
        new = None if A.is_null(node) else readers.get(kind, A.text_of)(node)
        chosen = Binder(self.tables, self.strict).predicate(parse(filter_expression or "true"), own.scan()).column()
        c = F.col(quoted(column_name))
        own.df = own.df.withColumn(column_name, F.when(chosen, F.lit(new).cast(SPARK_TYPES[kind])).otherwise(c))

    # ------------------------------------------------------------ queries

    def relation(self, text: str) -> Relation:
        return Binder(self.tables, self.strict).relation(parse(text))

    def query(self, query_string: str) -> DataFrame:
        if not query_string or not query_string.strip():
            raise ValueError("query_string cannot be empty")
        return self.relation(query_string).result()

    def query_arrow(self, query_string: str) -> pa.Table:
        """A result that the driver can hold; ``write_arrow`` takes any."""
        return self.query(query_string).toArrow()

    def write_arrow(self, query_string: str, path: str) -> StructType:
        """A result as Arrow streams below ``path``, in any store, written by the executors; gives the rows' schema."""
        df = self.query(query_string)
        arrow.write(df, path)
        return df.schema

    def get_filtered_bitmap(self, table_name: str, filter_expression: str = "") -> set[int]:
        """The row ids that a filter selects."""
        return {r[0] for r in self.filtered_rows(table_name, filter_expression).toLocalIterator()}

    def filtered_rows(self, table_name: str, filter_expression: str = "") -> DataFrame:
        """The same as a DataFrame, for tables of any size."""
        own = self._table(table_name)
        if ROW not in own.df.columns:
            own.df = with_rows(own.df)
        chosen = Binder(self.tables, self.strict).predicate(parse(filter_expression or "true"), own.scan()).column()
        return own.df.where(chosen).select(F.col(ROW).alias("row_id"))

    def _reference(self, table_name: str, sequence_name: str, alphabet: Alphabet) -> str:
        own = self._table(table_name)
        require(own.kind_of(sequence_name) == alphabet.kind, f"The table '{table_name}' has no {alphabet.title} sequence '{sequence_name}'", InputError)
        return own.references[sequence_name]

    def get_nucleotide_reference_sequence(self, table_name: str, sequence_name: str) -> str:
        return self._reference(table_name, sequence_name, NUCLEOTIDE)

    def get_amino_acid_reference_sequence(self, table_name: str, sequence_name: str) -> str:
        return self._reference(table_name, sequence_name, AMINO_ACID)

    def print_all_data(self, table_name: str) -> None:
        own = self._table(table_name)
        own.scan().result().show(own.df.count(), truncate=False)

    def info(self) -> dict:
        """The sizes of bitmap indexes are null: there are none."""
        own = self.tables.get(DEFAULT)
        return {"version": VERSION, "sequenceCount": own.df.count() if own else 0, "horizontalBitmapsSize": None, "verticalBitmapsSize": None}

    def lineage_definition(self, column: str) -> str:
        own = self._table(DEFAULT)
        require(own.kind_of(column), f"The column {column} does not exist in this instance.")
        require(own.kind_of(column) == "DICTIONARY_ENCODED", f"The column {column} is not of type indexed-string.")
        require(column in own.lineage_texts, f"The column {column} does not have a lineageTree defined.")
        return own.lineage_texts[column]

    # ------------------------------------------------------------ states

    def save_checkpoint(self, save_directory: str) -> Folder:
        """Write ``<directory>/<timestamp>/``, in any store: Parquet for each table, the schema, and the data version last."""
        if not save_directory or not save_directory.strip():
            raise ValueError("save_directory cannot be empty")
        root = Folder(self.spark, save_directory)
        stamp = max([self.version, int(time.time()), *[s.timestamp + 1 for s in states(root)]])
        path = root / str(stamp)
        schema = {}
        for name, own in self.tables.items():
            own.df.write.option("compression", "zstd").parquet((path / "tables" / name).path)
            schema[name] = {
                "fields": [[f.name, f.kind] for f in own.fields], "primaryKey": own.primary_key, "references": own.references, "lineages": own.lineage_texts,
                "lenient": sorted(own.lenient_lineages), "trees": {c: [t.names, t.parent, t.length] for c, t in own.trees.items()},
            }
        (path / "schema.json").write_text(json.dumps(schema))
        (path / "data_version.yaml").write_text(f"timestamp: {stamp}\nserializationVersion: {FORMAT}\n")
        return path

    def _load(self, path: Folder) -> None:
        if not path.exists():
            raise FileNotFoundError(f"Database file not found: {path.path}")
        found = state_of(path) or latest_state(path)
        if found is None:
            raise RuntimeError(f"Failed to load database from '{path.path}'")
        self.version = found.timestamp
        for name, s in json.loads((found.path / "schema.json").read_text()).items():
            df = self.spark.read.parquet((found.path / "tables" / name).path)
            trees = {c: Tree(*t) for c, t in s["trees"].items()}
            lineages = {c: LineageTree.from_yaml(t) for c, t in s["lineages"].items()}
            self.tables[name] = Table(name, df, [Field(*f) for f in s["fields"]], s["primaryKey"], s["references"], lineages, s["lineages"], trees, set(s["lenient"]))

    def __repr__(self) -> str:
        return "Database()"

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> bool:
        return False


def state_of(path: Folder) -> State | None:
    """A saved state of this format, if the folder is one: its name is its timestamp."""
    if not re.fullmatch("[0-9]+", path.name) or "data_version.yaml" not in path.names():
        return None
    own = dict(m.groups() for m in re.finditer(r"(?m)^(\w+):\s*(\S+)\s*$", (path / "data_version.yaml").read_text()))
    if own.get("timestamp") != path.name or own.get("serializationVersion") != str(FORMAT):
        return None
    return State(path, int(path.name))


def states(root: Folder) -> list[State]:
    return sorted(filter(None, (state_of(root / n) for n in root.names())), key=lambda s: -s.timestamp)


def latest_state(root: Folder) -> State | None:
    return next(iter(states(root)), None)
