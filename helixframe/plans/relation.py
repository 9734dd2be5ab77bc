"""What the binder passes on: a DataFrame with typed fields, its order, and the table scan below it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from helixframe.catalog.table import Table

#: Column kinds (fixed values) and their Spark types.
SPARK_TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(), "DICTIONARY_ENCODED": T.StringType(), "DATE32": T.DateType(), "BOOL": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(),
    "FLOAT": T.DoubleType(), "NUCLEOTIDE_SEQUENCE": T.StringType(), "AMINO_ACID_SEQUENCE": T.StringType(), "ZSTD_COMPRESSED_STRING": T.StringType(),
}
#: Kinds that a query sees as plain strings.
SEEN_AS_STRING = ("NUCLEOTIDE_SEQUENCE", "AMINO_ACID_SEQUENCE", "ZSTD_COMPRESSED_STRING")
#: The hidden place of a row in its table.
ROW = "__row"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str

    @property
    def shown(self) -> str:
        return "STRING" if self.kind in SEEN_AS_STRING else self.kind


@dataclass(frozen=True)
class Order:
    name: str
    ascending: bool = True
    hidden: bool = False


@dataclass
class Relation:
    df: DataFrame
    fields: list[Field]
    order: list[Order] = field(default_factory=list)
    scan: Table | None = None  # the table, while this is a scan with filters at most
    hidden: tuple[str, ...] = ()  # columns that ride along and are never shown

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def but(self, **changes) -> Relation:
        return replace(self, **changes)

    def column(self, name: str):
        return F.col(quoted(name))

    def result(self) -> DataFrame:
        """What a client gets: the shown fields, in the relation's order where it has one."""
        return self.df.select(*[self.column(n) for n in self.names])

    def order_metadata(self) -> list[dict[str, str]]:
        return [
            {"field": o.name, "order": "ascending" if o.ascending else "descending", "nullPlacement": "atStart" if o.ascending else "atEnd"} for o in self.order if not o.hidden
        ]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
