"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Each record is a gzip member of its own. The writer gives a record whose payload another record carries too,
and which has ``MIN_REVISIT`` bytes at least, as ``revisit`` of the one with the smallest id; payloads that are
shorter are always ``response``. Digests are bare lower-case hex SHA-256 of the full payload.

The reader checks each member (gzip CRC, version line, Content-Length, payload digest). After a failed check it
searches for the next gzip member or version line that parses, goes on from there, and logs the bytes between
as a quarantined gap: file, offset, length, reason.
"""

from __future__ import annotations

import base64
import hashlib
import io
import logging
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.records import open_uri
from vellum.llm.shared import over, stage, task, work_path

MIN_REVISIT = 100
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
#: Originals up to this many rows (16 bytes each) are broadcast to the writer; more are joined by shuffle.
BROADCAST_ROWS = 500_000
MANIFEST = "path string, n_records long, n_bytes long"
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes

    @property
    def body(self) -> bytes:
        """The payload without the headers of a captured HTTP exchange."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.payload.partition(b"\r\n\r\n")[2]
        return self.payload


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class Salvage:
    """The records and the gaps of one archive, in order of offset."""

    data: bytes
    gaps: list[Gap] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._hits = {MAGIC: -1, b"WARC/1.": -1}

    def __iter__(self) -> Iterator[Record]:
        at, end, bad = 0, len(self.data), None
        while at < end:
            got = self._records(at)
            if isinstance(got, str):
                if bad is None:
                    bad = (at, got)
                at = self._next(at + 1)
                continue
            if bad:
                self.gaps.append(Gap(bad[0], at - bad[0], bad[1]))
                bad = None
            found, after, reason = got
            yield from found
            if reason:  # what is left of a member whose first records are sound
                self.gaps.append(Gap(at, after - at, f"{reason} after {len(found)} records of a member"))
            at = after
        if bad:
            self.gaps.append(Gap(bad[0], end - bad[0], bad[1]))

    def _next(self, at: int) -> int:
        """The next magic number or version line; each pattern's last hit is remembered, so damage is searched once."""
        for pattern, hit in self._hits.items():
            if hit < at:
                found = self.data.find(pattern, at)
                self._hits[pattern] = found if found >= 0 else len(self.data)
        return min(self._hits.values())

    def _records(self, at: int) -> tuple[list[Record], int, str | None] | str:
        """The records of what starts at ``at``, where it ends, and why some of it, if any, couldn't be read; or why nothing could."""
        if self.data.startswith(b"WARC/1.", at):
            got = self._parse(self.data, at, at)
            return got if isinstance(got, str) else ([got[0]], got[1], None)
        if not self.data.startswith(MAGIC, at):
            return "neither member nor version line"
        inflate = zlib.decompressobj(31)
        body, view, pos = io.BytesIO(), memoryview(self.data), at
        try:
            while not inflate.eof:
                if pos >= len(self.data):
                    return "truncated member"
                body.write(inflate.decompress(view[pos : pos + (1 << 16)]))
                pos += 1 << 16
        except zlib.error:
            return "damaged member"
        end = min(pos, len(self.data)) - len(inflate.unused_data)
        raw, inside, found = body.getvalue(), 0, []
        while inside < len(raw):  # an archive compressed as one stream is one member of many records
            got = self._parse(raw, inside, at)
            if isinstance(got, str):
                return (found, end, got) if found else got
            found.append(got[0])
            inside = got[1]
        return (found, end, None) if found else "empty member"

    def _parse(self, raw: bytes, start: int, offset: int) -> tuple[Record, int] | str:
        cut = raw.find(b"\r\n\r\n", start)
        if cut < 0:
            return "no end of headers"
        lines = raw[start:cut].split(b"\r\n")
        if not re.fullmatch(rb"WARC/1\.\d", lines[0]):
            return "no version line"
        headers: dict[str, str] = {}
        for line in lines[1:]:
            k, colon, v = line.partition(b":")
            if not colon:
                return "damaged header"
            headers[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        n = headers.get("content-length", "")
        if not (n.isascii() and n.isdigit()):
            return "no content length"
        begin, end = cut + 4, cut + 4 + int(n)
        if raw[end : end + 4] != b"\r\n\r\n":
            return "content length"
        record = Record(offset, headers, raw[begin:end])
        if headers.get("warc-type") == "response" and not same_digest(headers.get("warc-payload-digest", ""), record.body):
            return "payload digest"
        return record, end + 4


def same_digest(named: str, payload: bytes) -> bool:
    """Whether a digest, ``algorithm:value`` in hexadecimal or base 32 or a bare SHA-256, is the payload's; one of an unknown algorithm isn't checked."""
    algorithm, colon, value = named.rpartition(":")
    algorithm = algorithm.lower() if colon else "sha256"
    if not value or algorithm not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    digest = hashlib.new(algorithm, payload)
    return value.lower() in (digest.hexdigest(), base64.b32encode(digest.digest()).decode().rstrip("=").lower())


def quoted(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; a revisit carries the digest and length of the payload, not the payload."""
    revisit = refers_to is not None
    name = "null" if key is None else str(key)
    lines = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quoted(url)}", "Content-Type: text/html", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    text = VERSION + "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n"
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(text) + squeeze.compress(body) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A record for each row, one archive for each task; returns the manifest ``(path, n_records, n_bytes)``.

    Null html is the empty payload; null url is an empty header. Of rows with equal payload and equal smallest
    id, all are ``response``: a row never refers to its own id. A row with null id is always a ``response`` and
    never an original. Payload texts aren't shuffled while the revisits fit ``BROADCAST_ROWS``; the digests of
    all rows are grouped with partial sums on the map side, so a payload that a third of all rows share is no
    hot group.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("k"), F.col(url_col).alias("u"), F.coalesce(F.col(html_col), F.lit("")).alias("p"))
    rows = rows.withColumn("d", F.when(F.octet_length("p") >= MIN_REVISIT, F.sha2("p", 256)))
    first = rows.where("d is not null and k is not null").groupBy("d").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("d", "first")
    first = stage(first, "originals")
    small = first.count() <= BROADCAST_ROWS
    if small:
        marked = rows.join(F.broadcast(first), "d", "left")
    else:  # payloads too short to be revisited have no digest, and stay where they are
        none = rows.where("d IS NULL").withColumn("first", F.lit(None).cast("long"))
        marked = rows.where("d IS NOT NULL").join(first.hint("shuffle_hash"), "d", "left").select("k", "u", "p", "d", "first").unionByName(none.select("k", "u", "p", "d", "first"))
    marked = marked.select("k", "u", "p", F.when(F.col("k") > F.col("first"), F.col("first")).alias("ref"))

    @task
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/pages-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.gz"
        out, n, size, date = None, 0, 0, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        for batch in batches:
            for k, u, p, ref in zip(*(c.to_pylist() for c in batch.columns)):
                payload = p.encode("utf-8", "surrogatepass")
                raw = record_bytes(k, u, payload, hashlib.sha256(payload).hexdigest(), ref, date)
                out = out or open_uri(path, "wb")
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return stage(marked.mapInArrow(write, MANIFEST), "manifest")


READ = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, gap_bytes long, reason string"


def scan_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives and one for each quarantined gap, which has ``gap_bytes`` and ``reason``.

    Length and digest of a response are those of the payload that was read; a revisit has no payload and tells its
    original's. ``page_id`` and ``refers_to`` are null for records that this module didn't write; ``record_id`` has their names.
    """
    files = max(1, manifest.count())
    key = re.compile(r"<urn:page:(-?\d+)>")
    names = [x.split()[0] for x in READ.split(", ")]

    def read(batch: pa.RecordBatch):
        for path in batch.column("path").to_pylist():
            with open_uri(path, "rb") as f:
                archive = Salvage(f.read())
            rows = []
            for r in archive:
                h = r.headers
                own, other = key.fullmatch(h.get("warc-record-id", "")), key.fullmatch(h.get("warc-refers-to", ""))
                if h.get("warc-type") == "revisit":
                    told = h.get("x-payload-length", "")
                    size, digest = int(told) if told.isdigit() else None, h.get("warc-payload-digest", "").rpartition(":")[2]
                else:
                    size, digest = len(r.body), hashlib.sha256(r.body).hexdigest()
                rows.append((own and int(own[1]), h.get("warc-record-id"), h.get("warc-target-uri"), size, digest, h.get("warc-type"), other and int(other[1]), path, r.offset, None, None))
            rows += [(*(None,) * 7, path, g.offset, g.length, g.reason) for g in archive.gaps]
            yield {n: [row[i] for row in rows] for i, n in enumerate(names)}

    return manifest.select("path").repartitionByRange(min(files, 100_000), "path").mapInArrow(over(READ, read), READ)


def read_archives(manifest: DataFrame, gaps: bool = False) -> DataFrame:
    """The records of the archives as ``scan_archives`` gives them; with ``gaps`` the gaps ``(path, offset, length, reason)`` instead."""
    rows = scan_archives(manifest)
    if gaps:
        return rows.where("reason IS NOT NULL").select("path", "offset", F.col("gap_bytes").alias("length"), "reason")
    return rows.where("reason IS NULL").drop("gap_bytes", "reason")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back, once; gaps, of which there should be none, are logged."""
    rows = stage(scan_archives(write_archives(pages, work_path(spark, "warc"))), "archive")
    gaps = rows.where("reason IS NOT NULL").agg(F.count("*").alias("n"), F.sum("gap_bytes").alias("bytes")).first()
    if gaps.n:
        logging.getLogger(__name__).warning("%d gaps of %d bytes in the archives", gaps.n, gaps.bytes)
    return rows.where("reason IS NULL").drop("gap_bytes", "reason")
