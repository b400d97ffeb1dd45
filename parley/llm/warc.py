"""WARC archives: a writer, and a reader whose tasks take byte ranges.

An archive is a row of gzip members, one record each. A reading task scans its range for gzip's magic bytes, accepts a
candidate only if the member's start decodes to WARC headers, follows members from there on, and owns the records that
start inside its range, reading past the range's end to finish the last one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import scratch

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
MAX_TASKS = 20_000
#: Up to so many revisits (some 60 bytes each) are sent to all executors; beyond, a join shuffles the pages.
BROADCAST_ROWS = 200_000
_CHUNK = 1 << 18
_DATE = "1970-01-01T00:00:00Z"
_URN = "urn:x-page:"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member. Nothing in it depends on the time or the machine."""
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=level, mtime=0)


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """A response that holds the page, or a revisit that holds only the HTTP headers and what it refers to."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    if refers_to is None:
        return record("response", fields, http + payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record("revisit", [*fields, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{_URN}{refers_to}>")], http)


def file_system(uri: str):
    """(file system, path) of a shared folder or file: any that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row below `folder`; returns (path, n_bytes) of the archives, one for each task that had rows.

    Of rows with equal payloads of `min_revisit_bytes` or more, that with the largest id is a response and the others
    revisit it; rows that tie for the largest id are all responses, and so are rows without an id. A null html is an
    empty payload; a null url leaves the field out. A task writes a file of its own name each time it runs, and only files
    of tasks that succeeded are in the result, so a lost executor leaves no record out or doubled.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = own.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes
    last = own.where(long_enough).groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last")
    # Only pages that revisit another are joined to the texts, by id and digest, so that no digest's pages meet in one task.
    revisits = own.where(long_enough).select("page_id", "digest").join(last.select("digest", "last"), "digest").where("page_id < last").select("page_id", "digest", F.col("last").alias("refers_to")).distinct()
    revisits = scratch.write_and_read(revisits, "revisits")
    few = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = own.join(F.broadcast(revisits) if few else revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size = None, f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    system, at = file_system(folder)
                    system.create_dir(at, recursive=True)
                    out = system.open_output_stream(f"{at}/{path.rpartition('/')[2]}", compression=None)
                    size += out.write(record("warcinfo", [("WARC-Record-ID", "<urn:x-archive>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(page_id, url, html, refers_to))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "n_bytes"])

    return scratch.write_and_read(rows.mapInArrow(save, "path string, n_bytes long"), "archives")


class _Window:
    """Bytes of a file from an offset on, read as they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, offset: int, length: int) -> bytes:
        if not self.at <= offset or offset + length > self.at + len(self.held):
            keep = self.held[offset - self.at :] if self.at <= offset < self.at + len(self.held) else b""
            self.held = keep + self.file.read_at(min(max(length, _CHUNK), max(0, self.size - offset - len(keep))), offset + len(keep))
            self.at = offset
        return self.held[offset - self.at : offset - self.at + length]


def _member(window: _Window, offset: int) -> tuple[dict, bytes, int] | None:
    """(headers, block, offset after) of the member at an offset; None if no WARC headers decode there."""
    unzip, data, at, headers = zlib.decompressobj(31), [], offset, None
    text = b""
    while not unzip.eof and at < window.size:
        chunk = window.get(at, min(_CHUNK, window.size - at))
        try:
            got = unzip.decompress(chunk)
        except zlib.error as e:
            if headers is None:
                return None
            raise OSError(f"the record at byte {offset} is damaged") from e
        at += len(chunk) - len(unzip.unused_data)
        data.append(got)
        if headers is None:
            text += got
            if not text.startswith(b"WARC/1."[: len(text)]):
                return None
            head, found, _ = text.partition(b"\r\n\r\n")
            if found:
                headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                if "WARC-Type" not in headers or not headers.get("Content-Length", "").isdigit():
                    return None
                skip = len(head) + 4
    if headers is None:
        return None
    whole = b"".join(data)
    block = whole[skip : skip + int(headers["Content-Length"])]
    if not unzip.eof or len(block) != int(headers["Content-Length"]):
        raise OSError(f"the record at byte {offset} ends early")
    return headers, block, at


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    window, at = _Window(file, size), start
    while at < end:
        if found := window.get(at, 3) == MAGIC and _member(window, at):
            yield at, found[0], found[1]
            at = found[2]
            continue
        part = window.get(at + 1, min(_CHUNK, size - at - 1))
        hit = part.find(MAGIC)
        at = at + 1 + hit if hit >= 0 else at + 1 + max(len(part) - 2, 0) if at + 1 + len(part) < size else end


_PAGE = re.compile(rf"<{_URN}(-?\d*)>")


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES, max_tasks: int = MAX_TASKS) -> DataFrame:
    """One row per page record in archives (path, n_bytes): what the record says and where it lies.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, path, offset. A response's payload is hashed and
    must have the digest that its header names. Byte ranges are dealt to tasks evenly, whatever the files' sizes; beyond
    `max_tasks` ranges a task reads several.
    """
    ranges = archives.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    n = archives.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 0
    ranges = ranges.repartition(max(1, min(n, max_tasks)), F.xxhash64("path", "start"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, path string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string() if x.endswith(" string") else pa.int64() for x in schema.split(", ")]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_bytes, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = file_system(path)
                with system.open_input_file(at) as file:
                    rows = [(*page_row(h, block, offset), path) for offset, h, block in records(file, n_bytes, start, min(start + split_bytes, n_bytes)) if h["WARC-Type"] in ("response", "revisit")]
                if rows:
                    yield table_of(rows)

    return ranges.select("path", "n_bytes", "start").mapInArrow(scan, schema)


def page_row(headers: dict, block: bytes, offset: int) -> tuple:
    """What a response or revisit record says of its page."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != said):
        raise OSError(f"the payload at byte {offset} has not the digest {said}")
    number = lambda field: int(m[1]) if (m := _PAGE.match(headers.get(field, ""))) and m[1] else None
    return number("WARC-Record-ID"), headers.get("WARC-Target-URI"), size, said, headers["WARC-Type"], number("WARC-Refers-To"), offset


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write archives to the shared folder and read them back: a row per row of `pages`."""
    folder = scratch.fresh(pages.sparkSession, "warc")
    return read(write(pages, folder, min_revisit_bytes), split_bytes)
