"""WARC archives: write, read, and resolve records with equal payloads to revisits.

Archives are gzip files of one member a record, so that every record can be read by
its place alone. ``write_records`` and ``write_deduplicated`` return an index, a table
(file, offset, length) that Spark commits: files of lost or repeated tasks are in no
index and are never read. Reading splits the index by place, not by file.

1. ``read_headers`` reads archives, hashes every payload and gives a row of headers.
2. ``resolve`` shuffles these rows by payload digest: of the responses with equal
   payloads the smallest key is the original, the others become revisits of it, and
   records that were revisits already are joined to it. Minima combine before the
   shuffle. Digests with more than ``1 / HOT_SHARE`` of the rows, fewer than
   ``HOT_SHARE``, are joined by broadcast; any other has a small share of the rows.
3. ``write_deduplicated`` writes archives with fresh headers (new record ids, references
   to the new ids). Payloads are copied from the old files by place and never shuffled.

Null payloads are empty. Payloads below ``least_bytes`` stay responses. A null key comes
after all others and is left out of the headers. Of repeated keys with one payload one
record is the response. Null addresses are left out; control characters in addresses are
percent-encoded. Very long payloads are held one at a time. Revisits whose payload no
response holds stay as they are. Empty tables give empty archives. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetally.llm.common import slices, stash

INDEX = "file string, offset long, length long"
HEADERS = (
    "file string, offset long, length long, type string, record_id string, key long, url string, date string, "
    "http string, payload_bytes long, digest string, refers_to long, refers_id string"
)
#: A file is closed at this size, and a task reads about as much.
FILE_BYTES, TASK_BYTES = 1 << 28, 1 << 27
#: Payload digests with more than one in so many rows are joined by broadcast.
HOT_SHARE = 1000
_CONTROL = re.compile("[\x00-\x20\x7f]")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def open_shared(path: str, mode: str):
    """A file of the shared folder, which may be mounted or a store that Arrow knows."""
    path = re.sub("^file:/+", "/", path)
    if "://" not in path:
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return store.open_output_stream(inner) if "w" in mode else store.open_input_file(inner)


def record(headers: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """One gzip member: the headers that have a value, and the block."""
    lines = [f"{name}: {value}\r\n" for name, value in headers if value is not None]
    head = "".join(["WARC/1.1\r\n", *lines, f"Content-Length: {len(block)}\r\n\r\n"]).encode()
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(head) + gzip.compress(block) + gzip.compress(b"\r\n\r\n") + gzip.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one record; header names in lower case."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    if not version.startswith("WARC/") or len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError(f"broken WARC record {headers.get('warc-record-id')}")
    return headers, block


def _address(url: str | None) -> str | None:
    return None if url is None else _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)


class _Archive:
    """Files of one task; every record's place is returned."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.file, self.path, self.at = folder, most, None, None, 0

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.file is None or self.at >= self.most:
            self.close()
            self.path, self.at = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0
            self.file = open_shared(self.path, "wb")
        self.file.write(member)
        place = (self.path, self.at, len(member))
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class _Members:
    """Records by place; the last file stays open."""

    def __init__(self):
        self.path, self.file, self.at = None, None, 0

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            self.path, self.file, self.at = path, open_shared(path, "rb"), 0
        if offset != self.at:
            self.file.seek(offset)
        self.at = offset + length
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def write_records(
    frame: DataFrame,
    folder: str,
    *,
    key_column: str = "key",
    url_column: str = "url",
    payload_column: str = "payload",
    content_type: str = "text/html; charset=utf-8",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a response record for every row below ``folder``; returns the index."""
    schema, date = _arrow(INDEX), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder, file_bytes)
        for batch in slices(batches):
            places = []
            for key, url, payload in zip(*(batch.column(c) for c in range(3)), strict=True):
                payload = payload.as_py() or b""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n"
                headers = [
                    ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                    ("WARC-Target-URI", _address(url.as_py())),
                    ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
                    ("X-Record-Key", key.as_py()), ("Content-Type", "application/http; msgtype=response"),
                ]
                places.append(archive.add(record(headers, http.encode() + payload)))
            yield _batch(places, schema)
        archive.close()

    rows = frame.select(
        F.col(key_column).cast("long"), F.col(url_column).cast("string"), F.col(payload_column).cast("binary")
    )
    return stash(rows.mapInArrow(write, INDEX), "warc-index")


def _by_place(index: DataFrame) -> DataFrame:
    """The rows in order of place, in tasks of about ``TASK_BYTES``."""
    session = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(session.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return index.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")


def _row(place: tuple[str, int, int], member: bytes) -> tuple:
    headers, block = parse(member)
    head, _, payload = block.partition(b"\r\n\r\n")
    size, digest = len(payload), headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if headers["warc-type"] == "revisit":
        sizes = re.findall(r"(?im)^content-length:\s*(\d+)\s*$", head.decode("utf-8", "replace"))
        size = int(sizes[0]) if sizes else None
    else:
        found = hashlib.sha256(payload).hexdigest()
        if digest not in (None, found):
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not have its digest")
        digest = found
    key, refers = headers.get("x-record-key"), headers.get("x-refers-to-key")
    return (
        *place, headers["warc-type"], headers.get("warc-record-id"), None if key is None else int(key),
        headers.get("warc-target-uri"), headers.get("warc-date"), head.decode("utf-8", "replace"), size, digest,
        None if refers is None else int(refers), headers.get("warc-refers-to"),
    )


def read_headers(index: DataFrame) -> DataFrame:
    """A row (``HEADERS``) for every record; the payload of a response must have its digest."""
    schema = _arrow(HEADERS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = _Members()
        for batch in slices(batches):
            places = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            yield _batch([_row(place, members.read(*place)) for place in places], schema)
        members.close()

    return _by_place(index.select("file", "offset", "length")).mapInArrow(read, HEADERS)


def resolve(headers: DataFrame, *, least_bytes: int = 100) -> DataFrame:
    """``headers`` with ``original``: the record that a revisit refers to, null for responses.

    ``original`` has the fields key, record_id, url and date. ``headers`` are read more than once.
    """
    long = (F.col("payload_bytes") >= least_bytes) & F.col("digest").isNotNull()
    order = F.struct(F.col("key").isNull().alias("none"), "key", "record_id", "url", "date")
    first = F.min(F.when(F.col("type") == "response", order))
    originals = stash(
        headers.filter(long).groupBy("digest").agg(first.alias("first"), F.count("*").alias("rows")), "originals"
    ).filter("first IS NOT NULL")
    bound = headers.count() // HOT_SHARE
    hot = F.broadcast(originals.filter(F.col("rows") > bound).drop("rows"))
    rest = headers.filter(long).join(hot.select("digest"), "digest", "left_anti")
    joined = (
        headers.filter(long).join(hot, "digest")
        .unionByName(rest.join(originals.filter(F.col("rows") <= bound).drop("rows"), "digest", "left"))
        .unionByName(headers.filter(~F.coalesce(long, F.lit(False))).withColumn("first", F.lit(None).cast(originals.schema["first"].dataType)))
    )
    own = F.col("first.record_id").eqNullSafe(F.col("record_id"))
    return joined.withColumn("original", F.when(F.col("first").isNotNull() & ~own, F.col("first").dropFields("none"))).drop("first")


def _fresh(record_id: str) -> str:
    """The id of a record's successor; the same whichever task asks."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id)}>"


def write_deduplicated(resolved: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every record of ``resolved`` below ``folder`` with fresh headers; returns the index."""
    schema = _arrow(INDEX)

    def headers_of(row: dict, revisit: bool) -> list[tuple]:
        original = row["original"] or {}
        return [
            ("WARC-Type", "revisit" if revisit else row["type"]), ("WARC-Record-ID", _fresh(row["record_id"])),
            ("WARC-Date", row["date"]), ("WARC-Target-URI", row["url"]), ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
            ("WARC-Refers-To", _fresh(original["record_id"]) if original else row["refers_id"]),
            ("WARC-Refers-To-Target-URI", original.get("url")), ("WARC-Refers-To-Date", original.get("date")),
            ("X-Refers-To-Key", original["key"] if original else row["refers_to"]),
            ("X-Record-Key", row["key"]), ("Content-Type", "application/http; msgtype=response"),
        ]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, members = _Archive(folder, file_bytes), _Members()
        for batch in slices(batches):
            places = []
            for row in batch.to_pylist():
                revisit = row["original"] is not None or row["type"] == "revisit"
                if revisit:
                    block = (row["http"] + "\r\n\r\n").encode()
                else:
                    _, block = parse(members.read(row["file"], row["offset"], row["length"]))
                places.append(archive.add(record(headers_of(row, revisit), block)))
            yield _batch(places, schema)
        archive.close()
        members.close()

    return stash(_by_place(resolved).mapInArrow(write, INDEX), "warc-index")


def deduplicate(index: DataFrame, folder: str, *, least_bytes: int = 100) -> DataFrame:
    """Archives below ``folder`` that hold every payload of the archives in ``index`` once; returns their index."""
    return write_deduplicated(resolve(stash(read_headers(index), "warc-headers"), least_bytes=least_bytes), folder)
