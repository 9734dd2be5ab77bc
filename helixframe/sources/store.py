"""Folders in whatever store Spark reads: small texts on the driver's side, and tables written between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOW33 = (1 << 33) - 1


class Folder:
    """A path and the file system it lies in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/") or "/"
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    @property
    def name(self) -> str:
        return self._at.getName()

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def names(self) -> list[str]:
        """What lies in the folder; nothing if there is no such folder."""
        if not self.exists() or not self._fs.getFileStatus(self._at).isDirectory():
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._at)]

    def read_text(self) -> str:
        stream = self._fs.open(self._at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        stream = self._fs.create(self._at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names; without one, a folder of this machine, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder(spark: SparkSession) -> str:
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="scratch-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that lost executors cost nothing already done."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: Sequence[Column], name: str, rank: str = "rank") -> tuple[DataFrame, int]:
    """``df``, written in the order of the keys (without keys: as it is), with each row's place from 0; and the number of rows.

    A range exchange, and offsets from the row counts of its parts: no task sees more than its part.
    """
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    line = written(df.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in line.groupBy(part.alias("part")).count().collect())  # one number for each part
    begins = accumulate([0, *[n for _, n in counts]])
    offsets = df.sparkSession.createDataFrame([(int(p), int(o)) for (p, _), o in zip(counts, begins, strict=False)], "__part long, __offset long")
    out = line.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(rank, F.col("__offset") + F.col("__at").bitwiseAND(F.lit(_LOW33))).drop("__part", "__offset", "__at"), sum(n for _, n in counts)
