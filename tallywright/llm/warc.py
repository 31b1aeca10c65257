"""WARC archives: one gzip member a record, written and read sequentially."""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm._store import materialize, new_path, small_side

CHUNK = 1 << 16
_DATE = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_uri(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member: a response, or a revisit that keeps the HTTP headers only."""
    told = digest(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{told}",
        f"WARC-Block-Digest: sha1:{digest(hashlib.sha1(block).digest())}",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_uri(refers_to)}")
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(whole) + squeeze.flush()


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source: BinaryIO, held: bytes):
        self.source, self.inflate, self.ready, self.held = source, zlib.decompressobj(31), b"", held

    def more(self) -> bool:
        """Decompress at most CHUNK more bytes; False at the member's end."""
        while not self.inflate.eof:
            data = self.held or self.inflate.unconsumed_tail or self.source.read(CHUNK)
            if not data:
                raise ValueError("archive ends inside a record")
            self.held = b""
            if got := self.inflate.decompress(data, CHUNK):
                self.ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > 1 << 20:
                raise ValueError("record header of over 1 MB")
            if not self.more():
                raise ValueError("record header without end")
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise ValueError("record shorter than its Content-Length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines if ":" in line)}


def read_records(source: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order, in bounded memory.

    Each member is inflated in pieces; the block is framed by Content-Length,
    and its digest (and a response's payload digest) is compared while it
    streams by. A record that is cut, too long or altered raises ValueError.
    `payloads` keeps the bytes of the payload; without it only its length and
    digest remain.
    """
    held = source.read(CHUNK)
    while held:
        member = _Member(source, held)
        version, head = _fields(member.until(b"\r\n\r\n"))
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        block, http, inner, body, size = hashlib.sha1(), b"", hashlib.sha1(), [], 0
        inside = "application/http" not in head.get("content-type", "")
        for part in member.take(int(head["content-length"])):
            block.update(part)
            if not inside:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, part, inside = http[:at], http[at + 4 :], True
            inner.update(part)
            size += len(part)
            if payloads:
                body.append(part)
        if b"".join(member.take(4)) != b"\r\n\r\n" or member.ready or member.more():
            raise ValueError("record longer than its Content-Length")
        if head["warc-block-digest"] != f"sha1:{digest(block.digest())}":
            raise ValueError(f"block digest of {head['warc-record-id']} differs")
        kind, told = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
        length = int(_fields(http)[1].get("content-length", size)) if http else size
        if kind == "response" and (told != digest(inner.digest()) or length != size):
            raise ValueError(f"payload digest of {head['warc-record-id']} differs")
        yield {
            "record_type": kind,
            "page_id": head["warc-record-id"],
            "url": head.get("warc-target-uri"),
            "payload_digest": told,
            "payload_bytes": length,
            "refers_to": head.get("warc-refers-to"),
        } | ({"payload": b"".join(body)} if payloads else {})
        held = member.inflate.unused_data + member.held or source.read(CHUNK)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there; s3a is how Hadoop names what others call s3."""
    return fs.FileSystem.from_uri("s3" + folder.removeprefix("s3a") if folder.startswith("s3a://") else folder)


def write_archives(pages: DataFrame, folder: str, rotate: int = 64 << 20) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives; returns the table of their paths.

    Each task streams its rows into files of its own in `folder` (a URI that
    pyarrow.fs opens, or s3a) and begins another file after `rotate` bytes. Names are
    unique to the attempt and only a successful task's names get into the
    table, so files of a failed or repeated attempt are never read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for page, url, html, refers in zip(batch.page_id, batch.url, batch.html, batch.refers_to, strict=True):
                if out is None:
                    name = f"{base}/part-{task.partitionId():05d}-{task.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(name, compression=None), 0, 0
                data = encode_record(
                    None if pd.isna(page) else int(page),
                    url if isinstance(url, str) else None,
                    html.encode() if isinstance(html, str) else b"",
                    None if pd.isna(refers) else int(refers),
                )
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= rotate:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [name], "records": [count]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "records": [count]})

    # As strings: beside a null, pandas would turn whole numbers to floats.
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return pages.select("url", "html", *ids).mapInPandas(write, "path string, records long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in `manifest`, a task reading whole archives one after another."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _open(folder)
        for batch in batches:
            for path, want in zip(batch.path, batch.records, strict=True):
                rows, seen = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for record in read_records(source):
                        rows.append(record)
                        seen += 1
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows)
                            rows = []
                if seen != want:
                    raise ValueError(f"{path} has {seen} records, not {want}")
                if rows:
                    yield pd.DataFrame(rows)

    got = manifest.mapInPandas(
        read,
        "record_type string, page_id string, url string, payload_digest string, payload_bytes long, refers_to string",
    )
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return got.withColumn("page_id", number("page_id")).withColumn(
        "refers_to", F.when(F.col("refers_to").isNotNull(), number("refers_to"))
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archive pages (page_id, url, html), later copies as revisits, and return what the archives say.

    Of pages with equal payloads the one with the largest page_id is the
    response and the rest are revisits of it. Null html is the empty payload;
    rows with the same page_id as their response are responses too (a repeated
    row is a repeated record). A row without page_id comes back without one: a
    revisit where a page with an id has its payload, else a response. Other
    columns are ignored. An empty table gives an empty result.

    The first pass reads html for its SHA-1 only and keeps the digests that
    occur more than once; the second hands each task its rows in place, so html
    is never shuffled while those digests are few enough to broadcast.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    pages = pages.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    copies = materialize(
        pages.groupBy("sha")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", "response"),
        "copies",
    )
    planned = pages.join(small_side(copies, 200_000), "sha", "left").withColumn(
        "refers_to", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response"))
    )
    folder = new_path(spark, "warc")
    manifest = materialize(write_archives(planned, folder), "manifest")
    files = max(1, manifest.count())
    return read_archives(manifest.repartition(min(files, 10_000)), folder)
