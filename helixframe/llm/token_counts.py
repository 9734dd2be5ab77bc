"""Token counts by scanning flat token streams for end-of-document identifiers.

A stream is a run of fixed-width identifiers with no index: documents follow each other, each ended by a
separator.  ``write_streams`` makes such files, ``scan_files`` reads these or any others.  A scan cuts a file into blocks of fixed size that pay no heed to document
ends, looks at each block alone (one vectorised comparison), and yields the tokens before the first separator, between separators, and after
the last one.  A prefix scan over the blocks of a stream then carries open tokens into the document that a later
block closes, and numbers the documents.  Spark reads a file of up to 2 GB as one row; the files written here have at most some 16 MB.

Edge cases: null and empty texts are documents of 0 tokens; separators spelled in a text are ordinary text to the
tokenizer, so they never end a document; tokens after the last separator of a stream form a last, unended document
(``ended`` false); an empty table has no streams.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import NULL_ID, chunks, ids_of, scratch

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The identifier that the vocabulary leaves free for the end of a document.
SEPARATOR = 50256
#: Tokens of a block; bytes of text that become one row of a file, and bytes of a file, which is read as a whole.
BLOCK, PIECE_BYTES, STREAM_BYTES = 1 << 18, 1 << 20, 16 << 20
_ENCODERS: dict = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The public tokenizer's encoder, loaded once in each Python worker."""
    key = folder, vocabulary
    if key not in _ENCODERS:
        import importlib.util

        import tiktoken

        spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
        public = importlib.util.module_from_spec(spec)
        sys.dont_write_bytecode = True
        spec.loader.exec_module(public)
        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def write_streams(df: DataFrame, path: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, stream_bytes: int = STREAM_BYTES) -> None:
    """Tokenize documents into flat files under ``path``: identifiers of two bytes, each document ended by the separator, nothing else.

    Spark's text writer writes them, with the separator's two bytes as what ends a row, so they can lie in any store.  ``kind=tokens/stream=N`` has a
    stream's file, ``kind=ids/stream=N`` the documents' ids in order, which say nothing of where one ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stream = encoder(folder, vocabulary), TaskContext.get().partitionId() << 20
        end = np.array([separator], "<u2")
        ids: list[np.ndarray] = []
        written_, seq = 0, 0

        def row(kind: str, seq: int, value: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([stream], pa.int64()), pa.array([seq], pa.int64()), pa.array([value], pa.binary())], ["kind", "stream", "seq", "value"])

        for b in batches:
            for c in chunks(b, most=PIECE_BYTES):
                held = []
                for text in c.column("text").to_pylist():
                    held += [np.array(enc.encode_ordinary(text), "<u2"), end]
                value = np.concatenate(held[:-1]).tobytes()  # the writer adds the last separator
                yield row("tokens", seq, value)
                ids.append(ids_of(c.column("doc_id")))
                written_, seq = written_ + len(value), seq + 1
                if written_ >= stream_bytes:
                    yield row("ids", 0, np.concatenate(ids).astype("<i8").tobytes())
                    ids, written_, seq, stream = [], 0, 0, stream + 1
        if ids:
            yield row("ids", 0, np.concatenate(ids).astype("<i8").tobytes())

    pieces = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind string, stream long, seq long, value binary")
    pieces = pieces.sortWithinPartitions("kind", "stream", "seq").select("kind", "stream", F.col("value").cast("string").alias("value"))
    ended = int(separator).to_bytes(2, "little").decode("latin-1")
    pieces.write.partitionBy("kind", "stream").option("lineSep", ended).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def _scan(tokens: np.ndarray, separator: int) -> tuple[int, int, int, list[int]]:
    """(separators, tokens before the first, tokens after the last, lengths between); without one, all tokens come after."""
    at = np.flatnonzero(tokens == separator)
    if not len(at):
        return 0, 0, len(tokens), []
    return len(at), int(at[0]), len(tokens) - int(at[-1]) - 1, (np.diff(at) - 1).tolist()


_SCANNED = "stream string, block int, ends int, head long, tail long, inner array<long>"


def scan_files(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """Each block of the flat files alone: its separators, and the tokens around them; a stream for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                data = content.as_buffer()
                if data.size % width:
                    raise ValueError(f"{name}: {data.size} bytes are no whole number of identifiers")
                flat = np.frombuffer(data, dtype)
                rows = [_scan(flat[k : k + block], separator) for k in range(0, len(flat), block)]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), *cols], ["stream", "block", "ends", "head", "tail", "inner"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SCANNED)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, ordinal, doc_id) from the files of ids; the writer has ended each with two bytes."""
    for b in batches:
        for name, content in zip(b.column("path"), b.column("content"), strict=True):
            ids = np.frombuffer(content.as_buffer(), "<i8", (content.as_buffer().size - 2) // 8)
            for k in range(0, len(ids), 100_000):
                part = ids[k : k + 100_000]
                doc = pa.array(part, mask=part == NULL_ID)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part), pa.string()), pa.array(np.arange(k, k + len(part))), doc], ["path", "ordinal", "doc_id"])


def stitched(scanned: DataFrame) -> DataFrame:
    """(stream, ordinal, n_tokens, ended) of every document: a prefix scan over each stream's blocks.

    A stream's blocks meet in one task as a few numbers each; the lengths inside a block don't pass the scan.
    """
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("stream").orderBy(F.col("block").desc())
    summed = (
        scanned.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("open", F.coalesce(F.sum("tail").over(before), F.lit(0)))
        # tails up to the last block with a separator, less that block's own tail, are closed already
        .withColumn("closed", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("open"))).over(before), F.lit(0)))
        .withColumn("carried", F.col("open") - F.col("closed"))
        .withColumn("is_last", F.row_number().over(last) == 1)
    )
    end = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail"))
    sizes = F.concat(
        F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>")),
        F.when(F.col("is_last") & (end > 0), F.array(end)).otherwise(F.array().cast("array<long>")),
    )
    return summed.select("stream", "first", "ends", F.posexplode(sizes).alias("k", "n_tokens")).select(
        "stream", (F.col("first") + F.col("k")).cast("long").alias("ordinal"), "n_tokens", (F.col("k") < F.col("ends")).alias("ended")
    )


def token_counts(df: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, block: int = BLOCK, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """(doc_id, n_tokens, stream, ordinal): documents are tokenized into flat files, and those are scanned."""
    spark = df.sparkSession
    path = scratch(spark, "tokens")
    write_streams(df, path, folder, vocabulary, stream_bytes=stream_bytes)
    number = lambda c: F.regexp_extract(c, "/stream=([0-9]+)/", 1).cast("long").alias("stream")
    if df.isEmpty():
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "stream", "ordinal")]).limit(0)
    names = spark.read.format("binaryFile").load(f"{path}/kind=ids").select("path", "content").mapInArrow(_named, "path string, ordinal long, doc_id long")
    found = stitched(scan_files(spark, f"{path}/kind=tokens", block=block)).where("ended")
    return names.select(number("path"), "ordinal", "doc_id").join(found.withColumn("stream", number("stream")), ["stream", "ordinal"]).select("doc_id", "n_tokens", "stream", "ordinal")
