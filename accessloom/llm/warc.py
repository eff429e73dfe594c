"""WARC archives: one gzip member per record, written by tasks and read back as a stream."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from accessloom.llm import common
from accessloom.session import cut_lineage

# Fixed values of the format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

MANIFEST = "path string, records long, bytes long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", record_id or "")
    return int(found[1]) if found else None


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.partition(":")[2]).hex()


def encode(page_id, url, payload: bytes, record_type: str, refers_to, date: str) -> bytes:
    """One record as one gzip member. A revisit keeps the HTTP head and both digests, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if record_type == "response" else b"")
    fields = [
        ("WARC-Type", record_type), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")), ("Content-Type", HTTP_TYPE),
        ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    if record_type == "revisit":
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _record_id(refers_to))]
    text = f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(wbits=31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _members(stream, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """The gzip members of a stream in turn with their offsets, decompressed piece by piece; holds one at a time."""
    offset, read, pending = 0, 0, b""
    while True:
        if not pending:
            pending = stream.read(chunk)
            read += len(pending)
            if not pending:
                return
        unpacker, parts = zlib.decompressobj(wbits=31), []
        while not unpacker.eof:
            parts.append(unpacker.decompress(pending))
            pending = unpacker.unused_data
            if not unpacker.eof:
                pending = stream.read(chunk)
                read += len(pending)
                if not pending:
                    raise ValueError(f"archive ends inside the record at byte {offset}")
        yield offset, b"".join(parts)
        offset = read - len(pending)


def decode(member: bytes, where: str) -> tuple:
    """A record's row, framed by its content length; wrong framing or a wrong digest is an error."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if not mark or not lines[0].startswith("WARC/") or "Content-Length" not in fields:
        raise ValueError(f"no record head at {where}")
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length does not fit at {where}")
    if _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest does not fit at {where}")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "response" and _digest(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest does not fit at {where}")
    length = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    return (_page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, _page_of(fields.get("WARC-Refers-To")),
            length, _hex(fields["WARC-Payload-Digest"]), payload if kind == "response" else None)


def planned(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages as rows to archive: page_id, url, payload, record_type, refers_to.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the response, the others revisit
    it. Rows without page_id count as smallest; if all of a group lack it, or rows repeat the largest, each of those is a
    response. A null html is an empty payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    groups = cut_lineage(
        keyed.where(F.octet_length("payload") >= least).groupBy("digest").agg(
            F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").drop("n"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return keyed.join(groups, "digest", "left").select(
        "page_id", "url", "payload", refers.alias("refers_to")).withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes planned rows to archives of about ``archive_bytes`` and returns their manifest, itself a stored table.

    Each task writes files of names of its own and the manifest lists only those of tasks that ended, so a lost or
    repeated task leaves at most an unlisted file. An empty table gives an empty manifest.
    """
    def archive(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "record_type", "refers_to"))):
                member = encode(*row, date)
                if out is not None and size + len(member) > archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
                    out = None
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    ordered = rows.select("page_id", "url", "payload", "record_type", "refers_to")
    return cut_lineage(ordered.mapInArrow(archive, MANIFEST))


def read(manifest: DataFrame, archives: int, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per record of the listed archives, each read from start to end by one task; see RECORD for the columns."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def records(batches):
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for paths in batches:
            for path in paths.column("path").to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(place, compression=None) as stream:
                    for offset, member in _members(stream):
                        rows.append(decode(member, f"{path}, byte {offset}"))
                        held += len(member)
                        if held >= batch_bytes:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()

    return manifest.select("path").repartition(max(1, archives)).mapInArrow(records, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Archives pages (page_id, url, html; other columns are ignored) and reads the archives back, one row per page."""
    folder = folder or common.new_folder(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder
    manifest = write(planned(pages, least), folder)
    return read(manifest, manifest.count())
