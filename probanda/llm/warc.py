"""WARC archives: one gzip member per record, written in tasks and read back sequentially."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import qualified

#: A new archive starts after so many compressed bytes.
ARCHIVE_BYTES = 32 << 20
#: Payloads of fewer bytes are never written as revisits.
LEAST_BYTES = 100
#: Compressed bytes that the reader asks for at once, and plain bytes that it gets from them at a time.
READ_BYTES, PLAIN_BYTES = 1 << 17, 1 << 20
VERSION = b"WARC/1.1"


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest page_id with the same payload, where that is another page
    and the payload has ``least`` bytes or more. Null html counts as empty; null ids and urls stay null, and rows without an id are responses; rows that repeat an
    id are rows each; an empty table gives an empty one; other columns are not read, so their names cannot clash. Digests are summed up before they are shuffled; equal payloads never meet in one task
    as a group, since the join can split them."""
    body = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    first = rows.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(first, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "payload", "digest", F.when(F.col("_first") < F.col("page_id"), F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own. A revisit has no block; its digest and length are those of the full payload."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.insert(2, ("WARC-Target-URI", url.encode("unicode_escape").decode("ascii").replace(" ", "\\x20")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    raw = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` as archives under ``folder``; the result, once it is run, lists them: path, records, bytes.

    A row without an id has the record id <urn:page:>; a null url gives no target. An empty table gives no archive. Each attempt of a task writes files of its own names, so a retried task leaves no half archive among those listed.
    Write the result as a table before reading from it.
    """

    root = qualified(rows.sparkSession, "/").rstrip("/")

    def run(batches):
        store, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"{root}{folder}")
        store.create_dir(path, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")], strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                page_id, url, payload, digest, refers_to = row
                data = record(page_id, url, payload, digest, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield listed(f"{folder}/{name}", n, size)
        if out is not None:
            out.close()
            yield listed(f"{folder}/{name}", n, size)

    def listed(path, n, size):
        return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return rows.mapInArrow(run, "path string, records long, bytes long")


class Framed:
    """Plain bytes of a stream of gzip members, decompressed as they are asked for."""

    def __init__(self, stream):
        self.stream, self.plain, self.pressed, self.unpack = stream, bytearray(), b"", None

    def _more(self) -> bool:
        if self.unpack is None or self.unpack.eof:
            self.pressed = (self.unpack.unused_data if self.unpack is not None else b"") or self.pressed or self.stream.read(READ_BYTES)
            if not self.pressed:
                return False
            self.unpack = zlib.decompressobj(31)
        elif not self.pressed:
            self.pressed = self.stream.read(READ_BYTES)
            if not self.pressed:
                raise EOFError("the archive ends inside a member")
        self.plain += self.unpack.decompress(self.pressed, PLAIN_BYTES)
        self.pressed = self.unpack.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        while (at := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                if self.plain:
                    raise EOFError("the archive ends inside a line")
                return None
        found = bytes(self.plain[:at])
        del self.plain[: at + 2]
        return found

    def take(self, n: int):
        """The next n bytes, in parts."""
        while n:
            if not self.plain and not self._more():
                raise EOFError("the archive ends inside a block")
            part = bytes(self.plain[:n])
            del self.plain[: len(part)]
            n -= len(part)
            if part:
                yield part


def records(stream):
    """(headers, payload) of each record; lengths and digests that don't fit raise ValueError."""
    frame = Framed(stream)
    while (first := frame.line()) is not None:
        if first != VERSION:
            raise ValueError(f"no record starts here: {first[:40]!r}")
        head = {}
        while line := frame.line():
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        digest, parts = hashlib.sha256(), []
        for part in frame.take(int(head["content-length"])):
            digest.update(part)
            parts.append(part)
        if b"".join(frame.take(4)) != b"\r\n\r\n":
            raise ValueError("the record is longer than its length says")
        if head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha256:{digest.hexdigest()}":
            raise ValueError(f"digest of {head['warc-record-id']} doesn't match")
        yield head, b"".join(parts)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the listed archives (column path): page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload
    (null for revisits) if asked for. Repeated records give a row each; an empty list gives an empty table. Each archive is read once, from start to end, in bounded memory; digests are verified."""

    root = qualified(archives.sparkSession, "/").rstrip("/")

    def run(batches):
        number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"{root}{uri}")
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for head, payload in records(stream):
                        url = head.get("warc-target-uri")
                        rows.append((number(head["warc-record-id"]), None if url is None else url.encode("ascii").decode("unicode_escape"), head["warc-type"], int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:"), number(head.get("warc-refers-to")), payload if payloads and head["warc-type"] == "response" else None))
                        size += len(payload)
                        if len(rows) >= 2000 or size >= 8 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield frame(rows)

    # ids stay integers: a data frame would make those of columns with nulls floats
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])]

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(zip(*rows, strict=True), fields, strict=False)], names=[n for n, _ in fields])

    # an archive a task, as far as tasks go; a number given here is kept by adaptive execution
    spread = archives.select("path").repartition(min(max(archives.count(), 1), 10_000), "path")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads)
