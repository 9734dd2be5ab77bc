"""Arrow streams in the store: each file is one stream, made and opened on the executors, so that no row passes the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A stream that has grown to this many bytes is ended, and the next one begun.
FILE_BYTES = 16 << 20
#: What ends a stream.
_END = b"\xff\xff\xff\xff\0\0\0\0"


def write(df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """All rows as files of one Arrow stream each; the end of a stream is what Spark's text writer puts after a row."""
    schema = to_arrow_schema(df.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([memoryview(out.getvalue())[: -len(_END)]], pa.binary())], ["value"])

        sink = None
        for b in batches:
            if sink is None:
                out = pa.BufferOutputStream()
                sink = pa.ipc.new_stream(out, schema)
            sink.write_table(pa.Table.from_batches([b]).cast(schema))
            if out.tell() >= file_bytes:
                yield ended()
                sink = None
        if sink is not None:
            yield ended()

    packed = df.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", _END.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a folder of such files."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                if len(own := content.as_buffer()):
                    yield from pa.ipc.open_stream(own)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, schema)
