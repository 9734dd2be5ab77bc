"""Operators on sequence columns: mutations and insertions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.catalog.table import Table, insertions
from helixframe.functions.alphabets import Alphabet
from helixframe.plans.relation import quoted

#: Fields of the result in output order (fixed values).
MUTATION_FIELDS = (
    ("mutationFrom", "STRING"), ("mutationTo", "STRING"), ("sequenceName", "STRING"), ("position", "INT32"), ("proportion", "FLOAT"), ("coverage", "INT32"), ("count", "INT32"),
)
INSERTION_FIELDS = (("position", "INT32"), ("insertedSymbols", "STRING"), ("sequenceName", "STRING"), ("count", "INT32"))
#: References up to this length are exploded to symbols; longer ones are counted in numpy inside each task.
EXPLODED = 64


def exploded_counts(df: DataFrame, name: str, alphabet: Alphabet) -> DataFrame:
    """(position, symbol, n) of the valid symbols, by exploding each sequence."""
    each = df.select(F.posexplode(F.split(F.col(quoted(name)), "")).alias("k", "symbol")).where(F.col("symbol").isin(list(alphabet.mutations)))
    return each.groupBy((F.col("k") + 1).alias("position"), "symbol").agg(F.count(F.lit(1)).alias("n"))


def tallied_counts(df: DataFrame, name: str, alphabet: Alphabet, length: int) -> DataFrame:
    """The same for long sequences: a task keeps one table of positions by symbols and hands it on once.

    What is exchanged follows tasks x length, not rows x length.
    """
    letters = alphabet.mutations

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(256, len(letters), np.uint8)
        code[[ord(x) for x in letters]] = np.arange(len(letters))
        total = np.zeros((len(letters), length), np.int64)
        some = False
        for b in batches:
            text = b.column(0).drop_null()
            some = some or len(text) > 0
            for k in range(0, len(text), max(1, (8 << 20) // length)):
                part = text.slice(k, max(1, (8 << 20) // length)).cast(pa.large_string())
                _, off, data = part.buffers()
                first = np.frombuffer(off, np.int64, 1, part.offset * 8)[0]
                grid = code[np.frombuffer(data, np.uint8, len(part) * length, first)].reshape(len(part), length)
                for s in range(len(letters)):
                    total[s] += np.count_nonzero(grid == s, axis=0)
        if some:
            s, p = np.nonzero(total)
            symbols = pa.array([letters[i] for i in s], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(p + 1, pa.int32()), symbols, pa.array(total[s, p])], ["position", "symbol", "n"])

    each = df.select(F.col(quoted(name)).alias("s")).mapInArrow(tally, "position int, symbol string, n long")
    return each.groupBy("position", "symbol").agg(F.sum("n").alias("n"))


def mutations(df: DataFrame, table: Table, names: list[str], alphabet: Alphabet, proportion: float, fields: list[str]) -> DataFrame:
    """Symbols that differ from the reference in more than the least proportion of the rows that cover a position.

    Coverage counts valid symbols alone; a symbol is reported if its count is at least ceil(coverage * proportion), and at least 1.
    """
    spark, parts = df.sparkSession, []
    for rank, name in enumerate(names):
        reference = table.references[name]
        counts = exploded_counts(df, name, alphabet) if len(reference) <= EXPLODED else tallied_counts(df, name, alphabet, len(reference))
        covered = counts.withColumn("coverage", F.sum("n").over(Window.partitionBy("position")))
        symbol_rank = reduce(lambda c, s: c.when(F.col("symbol") == s[1], s[0]), enumerate(alphabet.mutations), F.when(F.lit(False), -1))
        own = spark.createDataFrame([(k + 1, s) for k, s in enumerate(reference)], "position int, mutationFrom string")
        least = F.ceil(F.col("coverage").cast("double") * F.lit(float(proportion)))
        parts.append(
            covered.join(F.broadcast(own), "position")  # one row for each position of the reference
            .where((F.col("symbol") != F.col("mutationFrom")) & (F.col("n") >= F.greatest(least, F.lit(1))))
            .select(
                "mutationFrom", F.col("symbol").alias("mutationTo"), F.lit(name).alias("sequenceName"), F.col("position").cast("int").alias("position"),
                (F.col("n") / F.col("coverage")).alias("proportion"), F.col("coverage").cast("int").alias("coverage"), F.col("n").cast("int").alias("count"),
                F.lit(rank).alias("__s"), symbol_rank.alias("__m"),
            )
        )
    if not parts:
        empty = "mutationFrom string, mutationTo string, sequenceName string, position int, proportion double, coverage int, count int"
        return spark.createDataFrame([], empty).select(*fields)
    return reduce(DataFrame.unionByName, parts).orderBy("__s", "position", "__m").select(*fields)


def insertion_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """How many rows have each insertion."""
    parts = []
    for rank, name in enumerate(names):
        each = df.select(F.explode(F.array_distinct(F.col(quoted(insertions(name))))).alias("x")).select("x.*")
        parts.append(each.groupBy("pos", "ins").agg(F.count(F.lit(1)).alias("n")).withColumn("__s", F.lit(rank)).withColumn("sequenceName", F.lit(name)))
    if not parts:
        return df.sparkSession.createDataFrame([], "position int, insertedSymbols string, sequenceName string, count int")
    out = reduce(DataFrame.unionByName, parts).orderBy("__s", "pos", "ins")
    return out.select(F.col("pos").cast("int").alias("position"), F.col("ins").alias("insertedSymbols"), "sequenceName", F.col("n").cast("int").alias("count"))
