"""WARC: a writer, and a normaliser of archives that are one gzip stream.

An archive compressed as a whole can only be read from its start.  The normaliser inflates
such a stream once, in bounded pieces, writes every record as a gzip member of its own and
puts a sidecar beside the archive: one JSON line a record with its offset, length, id and
type, so that a reader seeks to any record.  Streams of several members are read alike.

Pages become records: of equal payloads of at least ``LEAST_BYTES`` bytes the one with the
smallest page id is a response, the others revisit it without a payload; smaller payloads are
all responses.  Reading back hashes what the archives hold; a revisit takes its size from the
response that it names.

Files are written by tasks through the shared folder's file system under names of their own,
and only names that a finished task returned are read, so a task that is run again does no
harm.  Null html: an empty payload.  Null url: no target.  A null page id is written under a
random record id, is never the smallest and reads back as null.  Rows that repeat a page id
and payload are alike, so all are responses if one is.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

LEAST_BYTES = 100
LEVEL = 3
ARCHIVE_BYTES = 256 << 20  # of records, before compression
PIECE = 1 << 20
SMALL_ROWS = 1_000_000
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def record(kind: str, record_id: str, target: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One record: its header, an HTTP response, and the two closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    if target:
        fields["WARC-Target-URI"] = " ".join(target.split())
    if refers_to:
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": REVISIT}
    fields["Content-Length"] = str(len(block))
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_header(stream: BinaryIO) -> tuple[bytes, dict[str, str]] | None:
    """The next record's header, as it stands and by lower-case field; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("a WARC record was expected")
    raw, fields, name = [line], {}, ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        raw.append(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:  # a folded field
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return b"".join([*raw, b"\r\n"]), fields


def pieces(stream: BinaryIO, size: int) -> Iterator[bytes]:
    while size:
        got = stream.read(min(size, PIECE))
        if not got:
            raise EOFError("the archive ends within a record")
        size -= len(got)
        yield got


def normalise(source: BinaryIO, archive: BinaryIO, index: BinaryIO, level: int = LEVEL) -> int:
    """Rewrite a gzipped WARC stream record by record; returns the number of records."""
    n = at = 0
    with gzip.GzipFile(fileobj=source) as stream:
        while (found := read_header(stream)) is not None:
            raw, fields = found
            press = zlib.compressobj(level, zlib.DEFLATED, 31)
            size = 0

            def put(data: bytes) -> None:
                nonlocal size
                if data:
                    archive.write(data)
                    size += len(data)

            put(press.compress(raw))
            for piece in pieces(stream, int(fields["content-length"])):
                put(press.compress(piece))
            put(press.compress(b"\r\n\r\n") + press.flush())
            line = {"offset": at, "length": size, "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "target": fields.get("warc-target-uri")}
            index.write(json.dumps(line).encode() + b"\n")
            at += size
            n += 1
    return n


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Tasks write (page_id, url, html, digest, first_id) as archives of one stream each."""
    system, top = _open(folder)
    system.create_dir(top, recursive=True)
    out = press = name = None
    size = n = 0
    done: list[tuple[str, int]] = []

    def end() -> None:
        out.write(press.flush())
        out.close()
        done.append((name, n))

    for batch in batches:
        for page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out, press = system.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            own = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
            payload = (html or "").encode()
            revisit = first is not None and page != first
            data = record("revisit" if revisit else "response", own, url, payload, digest, f"urn:page:{first}" if revisit else None)
            out.write(press.compress(data))
            size += len(data)
            n += 1
            if size >= ARCHIVE_BYTES:
                end()
                out = None
    if out is not None:
        end()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["name", "records"])


def _normalise(batches: Iterator[pa.RecordBatch], source: str, target: str) -> Iterator[pa.RecordBatch]:
    (system, top), (out, to) = _open(source), _open(target)
    out.create_dir(to, recursive=True)
    for batch in batches:
        names, counts = [], []
        for name in batch.column(0).to_pylist():
            own = f"{uuid.uuid4().hex}.warc.gz"
            with system.open_input_stream(f"{top}/{name}", compression=None) as src, out.open_output_stream(f"{to}/{own}", compression=None) as archive:
                with out.open_output_stream(f"{to}/{own}.idx", compression=None) as index:
                    counts.append(normalise(src, archive, index))
            names.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["name", "records"])


def _page(urn: str | None) -> int | None:
    _, found, number = (urn or "").strip("<>").partition("urn:page:")
    return int(number) if found else None


READ = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long"


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Every record by its place in the sidecar."""
    system, top = _open(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows = []
            with system.open_input_file(f"{top}/{name}") as archive, system.open_input_stream(f"{top}/{name}.idx", compression=None) as index:
                for line in index.read().splitlines():
                    at = json.loads(line)
                    archive.seek(at["offset"])
                    member = gzip.GzipFile(fileobj=pa.BufferReader(archive.read(at["length"])))
                    _, fields = read_header(member)
                    block = member.read(int(fields["content-length"]))
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    kind = fields["warc-type"]
                    stated = fields["warc-payload-digest"].removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else stated
                    if digest != stated:
                        raise ValueError(f"{name} at {at['offset']}: the payload does not fit its digest")
                    rows.append((_page(fields["warc-record-id"]), kind, len(payload) if kind == "response" else None, digest, _page(fields.get("warc-refers-to")), name, at["offset"]))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in READ.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _spread(names: DataFrame) -> DataFrame:
    """A task for each archive."""
    return names.select("name").repartition(max(1, names.count()))


def normalise_archives(names: DataFrame, source: str, target: str) -> DataFrame:
    """Normalise the archives ``name`` of folder ``source`` into ``target``: (name, records)."""
    return _spread(names).mapInArrow(lambda bs: _normalise(bs, source, target), "name string, records long")


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives, read at the offsets of their sidecars."""
    return _spread(names).mapInArrow(lambda bs: _read(bs, folder), READ)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """Write the pages, normalise the archives: (their names and record counts, their folder)."""
    scratch = Scratch(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"),
    )
    groups = pages.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    copies = scratch.save(groups.where("n > 1 and first_id is not null").select("digest", "first_id"))
    if copies.count() <= SMALL_ROWS:
        copies = F.broadcast(copies)
    marked = pages.join(copies, "digest", "left").select("page_id", "url", "html", "digest", "first_id")
    raw, made = scratch.path(), scratch.path()
    written = scratch.save(marked.mapInArrow(lambda bs: _write(bs, raw), "name string, records long"))
    names = scratch.save(normalise_archives(written, raw, made))
    scratch.remove(raw)
    return names, made


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset) as the
    archives of ``pages`` hold them."""
    names, folder = archive_pages(pages, id_col, url_col, html_col)
    found = Scratch(pages.sparkSession).save(read_archives(names, folder))
    named = found.where(f"record_type = 'response' and payload_bytes >= {LEAST_BYTES}").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    named = named.toDF("named_id", "named_digest", "full_bytes")
    same = (F.col("refers_to") == F.col("named_id")) & (F.col("payload_digest") == F.col("named_digest"))
    revisits = found.where("record_type = 'revisit'").join(named, same, "left").withColumn("payload_bytes", F.col("full_bytes"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]
    return found.where("record_type = 'response'").select(names).union(revisits.select(names))
