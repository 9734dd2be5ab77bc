"""WARC archives: writing records, reading them back, and reassembling segmented records.

Records are written as WARC/1.1 by Spark's text writer: a row is one record or segment, and the writer's separator is the
blank line that ends it, so archives can lie in any store that Spark can write to (gzip, one member for each file).
Bodies are framed by chunked transfer coding.  A block longer than ``segment_bytes`` is cut: the first segment is the
record itself, the others are ``continuation`` records that name its id.

An archive has at most ``FILE_RECORDS`` records, so a reader's memory is bounded by them.  Reading unzips and parses each archive record by record by ``Content-Length``, checks block digests, groups segments by their origin's id (an
exchange by id, sorted by segment number, streamed), verifies that none is missing and that their lengths sum to
``WARC-Segment-Total-Length``, undoes the chunked framing, and verifies the payload's digest.  A record that fails
raises ValueError.  Segments of one record may lie in different archives.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the largest id is a response and the
others are ``revisit`` records without payload.  Edge cases: null html is the empty payload; a null url gives no target
URI; rows that repeat an id and payload are written and returned as often as they occur, all with one role; a null id
sorts lowest; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import scratch, written

END = b"\r\n\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK = 4 << 10
#: Records of one archive, which is read as a whole.
FILE_RECORDS = 4_000


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding of a payload."""
    out = [b"%x\r\n%b\r\n" % (len(p), p) for k in range(0, len(payload), size) if (p := payload[k : k + size])]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body ends inside a size line")
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        begin = line + 2
        if body[begin + size : begin + size + 2] != b"\r\n":
            raise ValueError("chunked body is shorter than its sizes say")
        out.append(body[begin : begin + size])
        at = begin + size + 2


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def records(name: str, url: str | None, payload: bytes, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record of one page, in segments where it is long; ``refers_to`` makes it a revisit."""
    fields = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record("revisit", fields, http)
        return
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record("response", fields, block)
        return
    cuts = list(range(0, len(block), segment_bytes))
    yield _record("response", [*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])
    for n, k in enumerate(cuts[1:], 2):
        own = [("WARC-Record-ID", f"<{name}:{n}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(n))]
        if n == len(cuts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record("continuation", own, block[k : k + segment_bytes])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor().compress
    for b in batches:
        html = b.column("html").to_pylist()
        cols = [b.column("page_id"), b.column("url"), b.column("digest"), pa.array([len(x) for x in html], pa.int64()), pa.array([pack(x) for x in html], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "digest", "size", "packed"])


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write pages (page_id, url, html) as archives under ``path``."""
    own = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    # written, so that the join below it reads two plain exchanges, and a payload that many pages share can be split
    last = written(own.groupBy("digest").agg(F.max("page_id").alias("last")), "payloads")
    older = (F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("last"))
    packed = own.mapInArrow(_pack, "page_id long, url string, digest binary, size long, packed binary")  # what the join moves
    rows = packed.join(last, "digest").select("page_id", "url", "packed", "digest", F.when(older, F.col("last")).alias("refers"), older.alias("older"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out: list[bytes] = []
            size = 0
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "packed", "digest", "refers", "older")]
            for page, url, packed, digest, refers, old in zip(*cols, strict=True):
                name = lambda p: f"urn:page:{p}:{digest.hex()}"  # noqa: B023, E731
                for r in records(name(page), url, unpack(packed), name(refers) if old else None, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def pieces(data: bytes) -> Iterator[bytes]:
    """An archive's bytes, unzipped a megabyte at a time; gzip with a member for the file or one for each record."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    unzip, at = zlib.decompressobj(31), 0
    while at < len(data):
        part = unzip.unconsumed_tail or data[at : at + (1 << 20)]
        if not unzip.unconsumed_tail:
            at += len(part)
        yield unzip.decompress(part, 1 << 20)
        if unzip.eof:
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)
    while unzip.unconsumed_tail:
        yield unzip.decompress(unzip.unconsumed_tail, 1 << 20)


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive; one record is held at a time."""
    held = b""
    more = True
    while held or more:
        while more and (head := held.find(END)) < 0:
            part = next(parts, None)
            more, held = part is not None, held + (part or b"")
        if not held:
            return
        if (head := held.find(END)) < 0:
            raise ValueError("an archive ends inside a record's header")
        lines = held[:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = head + 4 + int(fields["content-length"])
        rest = [held]
        size = len(held)
        while size < end + 4 and (part := next(parts, None)) is not None:
            rest.append(part)
            size += len(part)
        held = b"".join(rest)
        if end > len(held):
            raise ValueError("an archive ends inside a record's block")
        yield fields, held[head + 4 : end]
        held = held[end + 4 :]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The payload of a whole response block, without its HTTP header and framing; its digest is verified."""
    head, _, body = block.partition(END)
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if (want := fields.get("warc-payload-digest")) and want != f"sha1:{base32_sha1(payload)}":
        raise ValueError(f"payload digest of {fields['warc-record-id']} is wrong")
    return payload


_FIELDS = "origin string, segment int, total long, kind string, digest string, refers string, packed binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record or segment of the archives under ``path``, its block packed by zstd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for f, block in parse(pieces(content.as_py())):
                    if (want := f.get("warc-block-digest")) and want != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"block digest of {f['warc-record-id']} is wrong")
                    total = f.get("warc-segment-total-length")
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), int(f.get("warc-segment-number", 0)), total and int(total), f["warc-type"], f.get("warc-payload-digest"), f.get("warc-refers-to"), pack(block)))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows, _FIELDS)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _FIELDS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _FIELDS)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _TYPES[t]) for k, t in enumerate(kinds)], list(names))


_WHOLE = "record_id string, kind string, digest string, refers string, copies int, payload binary"


def reassembled(segments: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each distinct record, with its payload (or, without ``payloads``, only what describes it).

    ``copies`` says how often the record stands in the archives.  Only one record's segments are held at a time.
    """
    fields = _WHOLE if payloads else _WHOLE.replace("payload binary", "payload_bytes long")

    def whole(rows: list[tuple]) -> tuple | None:
        origin, _, _, kind, digest, refers, packed = rows[0]
        unpack = zstandard.ZstdDecompressor().decompress
        copies = sum(r[1] == rows[0][1] for r in rows)
        if kind == "revisit":
            return origin, kind, digest, refers, copies, None
        if kind != "response":
            raise ValueError(f"segments of {origin} have no first one")
        block = unpack(packed)
        if rows[0][1]:
            own = {r[1]: r for r in rows}
            if sorted(own) != list(range(1, len(own) + 1)):
                raise ValueError(f"a segment of {origin} is missing")
            block = b"".join(unpack(own[n][6]) for n in range(1, len(own) + 1))
            if own[len(own)][2] != len(block):
                raise ValueError(f"segments of {origin} have {len(block)} bytes, not {own[len(own)][2]}")
        payload = payload_of({"warc-record-id": origin, "warc-payload-digest": digest or ""}, block)
        return origin, kind, digest, refers, copies, payload if payloads else len(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                if held and held[0][0] != row[0]:
                    out.append(whole(held))
                    held = []
                held.append(row)
            if out:
                yield _batch(out, fields)
        if held:
            yield _batch([whole(held)], fields)

    return segments.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(run, fields)


def round_trip(pages: DataFrame, min_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES, path: str | None = None) -> DataFrame:
    """Write pages, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, min_revisit, segment_bytes)
    all_ = reassembled(read_segments(spark, path), payloads=False)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")
    sizes = all_.where("kind = 'response'").select(F.col("record_id").alias("refers"), F.col("payload_bytes").alias("found"))
    return (
        all_.join(sizes, "refers", "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            page("record_id").alias("page_id"),
            F.coalesce("payload_bytes", "found").alias("payload_bytes"),
            F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            page("refers").alias("refers_to"),
        )
    )
