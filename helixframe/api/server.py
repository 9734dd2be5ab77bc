"""A thin HTTP front: queries, health, info and lineage definitions, with hot reload of saved states.

A request keeps the database it began with; a reload swaps in the next one for later requests.
"""

from __future__ import annotations

import base64
import io
import json
import threading
import uuid
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.catalog.database import Database, latest_state
from helixframe.errors import IllegalQuery, NotLoaded
from helixframe.sources import arrow
from helixframe.sources.ndjson import to_json_lines
from helixframe.sources.store import Folder, scratch

ARROW = "application/vnd.apache.arrow.stream"
#: Where a result's Arrow streams lie in the store: for results of any size, which executors write and clients read side by side.
ARROW_FILES = "application/vnd.helixframe.arrow-files+json"
#: Seconds that a query may take, and between two looks for a newer state.
TIMEOUT, POLL = 120, 2


class Active:
    """The database that new requests use."""

    def __init__(self, database: Database | None = None):
        self._database = database

    def get(self) -> Database:
        database = self._database
        if database is None:
            raise NotLoaded("Database not initialized yet.")
        return database

    def set(self, database: Database) -> None:
        self._database = database

    def watch(self, root: str, spark, stop: threading.Event) -> None:
        """Load newer states of a directory until stopped."""
        while not stop.wait(POLL):
            self.reload(root, spark)

    def reload(self, root: str, spark) -> None:
        """Load the newest state of a directory, if it is newer than what there is."""
        found = latest_state(Folder(spark, root))
        if found and (self._database is None or found.timestamp > self._database.version):
            self.set(Database(found.path.path, spark))


class Handler(BaseHTTPRequestHandler):
    active: Active
    protocol_version = "HTTP/1.1"

    def log_message(self, *_) -> None:
        pass

    def _send(self, status: int, body: bytes, kind: str, **headers: str) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.send_header("X-Request-Id", self.headers.get("X-Request-Id") or str(uuid.uuid4()))
        for name, value in headers.items():
            self.send_header(name.replace("_", "-"), value)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def _stream(self, pieces: Iterator[bytes], kind: str, **headers: str) -> None:
        """A body of unknown length, a piece at a time; what fails before the first piece is still told as an error."""
        first = next(pieces, b"")
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.send_header("Transfer-Encoding", "chunked")
        self.send_header("X-Request-Id", self.headers.get("X-Request-Id") or str(uuid.uuid4()))
        for name, value in headers.items():
            self.send_header(name.replace("_", "-"), value)
        self.end_headers()
        try:
            for piece in chain([first], pieces):
                if piece:
                    self.wfile.write(b"%x\r\n%b\r\n" % (len(piece), piece))
            self.wfile.write(b"0\r\n\r\n")
        except Exception:  # too late for a status: the client sees that the body breaks off
            self.close_connection = True

    def _error(self, status: int, title: str, message: str, **headers: str) -> None:
        self._send(status, json.dumps({"error": title, "message": message}).encode(), "application/json", **headers)

    def _answer(self) -> None:
        route = self.path.split("?")[0].rstrip("/") or "/"
        length = int(self.headers.get("Content-Length") or 0)
        body = self.rfile.read(length).decode() if length else ""
        allowed = {"/query": "POST", "/health": "GET", "/info": "GET"}
        if route.startswith("/lineageDefinition/"):
            allowed[route] = "GET"
        if route not in allowed:
            return self._error(404, "Not found", f"Resource {route} does not exist")
        if self.command != allowed[route]:
            return self._error(405, "Method not allowed", f"{self.command} is not allowed on resource {route}")
        try:
            database = self.active.get()
            version = str(database.version)
            if route == "/query":
                return self._query(database, body)
            if route == "/health":
                return self._send(200, b'{"status": "UP"}', "application/json", data_version=version)
            if route == "/info":
                return self._send(200, json.dumps(database.info()).encode(), "application/json", data_version=version)
            return self._send(200, database.lineage_definition(route.rpartition("/")[2]).encode(), "application/yaml", data_version=version)
        except NotLoaded as e:
            return self._error(503, "Service Temporarily Unavailable", str(e), Retry_After="60")
        except IllegalQuery as e:
            return self._error(400, "Bad request", str(e))
        except Exception as e:  # whatever a plan can raise is told to the client
            return self._error(500, "Internal server error", str(e).split("\n")[0])

    do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = _answer

    def _query(self, database: Database, text: str) -> None:
        relation = database.relation(text)
        more = {"data_version": str(database.version), "result_ordering": json.dumps(relation.order_metadata())}
        spark = database.spark
        if self.headers.get("Accept") == ARROW_FILES:  # an export takes the time that its size needs
            return self._send(200, arrow_files(relation.result()), ARROW_FILES, **more)
        tag = f"query-{uuid.uuid4()}"
        timer = threading.Timer(TIMEOUT, spark.interruptTag, [tag])
        spark.addTag(tag)
        timer.start()
        try:
            df = relation.result()
            if self.headers.get("Accept") == ARROW:
                return self._stream(arrow_stream(df), ARROW, **more)
            return self._stream(json_stream(df), "application/x-ndjson", **more)
        finally:
            timer.cancel()
            spark.removeTag(tag)


def json_stream(df: DataFrame) -> Iterator[bytes]:
    """Lines of JSON, a few thousand at a time; the driver holds one partition of the result."""
    held: list[str] = []
    for r in to_json_lines(df).toLocalIterator():
        held.append(r[0])
        if len(held) == 4096:
            yield ("\n".join(held) + "\n").encode()
            held = []
    if held:
        yield ("\n".join(held) + "\n").encode()


def arrow_stream(df: DataFrame) -> Iterator[bytes]:
    """The Arrow stream format: batches are packed where they are computed, and passed on one by one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema) as sink:
                sink.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["packed"])

    schema = to_arrow_schema(df.schema)
    out = io.BytesIO()
    sink = pa.ipc.new_stream(out, schema)
    for r in df.mapInArrow(pack, "packed binary").toLocalIterator():
        sink.write_table(pa.ipc.open_stream(r[0]).read_all().cast(schema))
        yield out.getvalue()
        out.seek(0)
        out.truncate()
    sink.close()
    yield out.getvalue()


def arrow_files(df: DataFrame) -> bytes:
    """Write the result as Arrow streams to the shared folder; the answer is their folder, and the schema as an Arrow message."""
    path = scratch(df.sparkSession, "result")
    arrow.write(df, path)
    schema = base64.b64encode(to_arrow_schema(df.schema).serialize()).decode()
    return json.dumps({"path": path, "schema": schema}).encode()


def serve(active: Active, port: int = 8081, host: str = "") -> ThreadingHTTPServer:
    """A server on its own thread; ``shutdown()`` ends it."""
    server = ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"active": active}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
