"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Reading: every archive is cut into byte ranges, one row a range. A task scans its range for the gzip
magic, takes a candidate for a member only if its first bytes inflate to a WARC header block, and owns
the records that start inside its range; the last one is read on past the range's end. After a record
the scan goes on at its end, so magic bytes inside a member are not looked at.

Writing: each task appends its records to archives of its own under a name that no other attempt has,
and reports what it has finished; Spark commits those reports, so files of lost attempts are never read.

Defined cases: header blocks and records may be of any length, a record is held in memory once; an HTTP
length that is no number is taken from the payload; a null html is an empty payload; rows that share page_id and payload are all responses;
a page without an id is a response without one, and nothing refers to it; an empty table gives no
archive and no record; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, materialise, split_uri, text_slices

MAGIC = b"\x1f\x8b\x08"
#: Bytes of one range of an archive, and about the bytes after which a writer begins another archive.
RANGE = 4 << 20
ARCHIVE = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to=None) -> bytes:
    """One record, inflated. A revisit keeps the HTTP header, whose Content-Length is the payload's."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda x: f"<urn:page:{'none-' + uuid.uuid4().hex if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_pages(pages: DataFrame, folder: str | None = None, revisit_from: int = 0) -> DataFrame:
    """Archive (page_id, url, html); returns the finished archives (path, bytes, records).

    Of pages with equal payloads of at least ``revisit_from`` bytes the one with the smallest id is the
    response. Digests alone are grouped, with partial sums; the join that brings a page its response's
    id is a plain equi-join that adaptive execution can split where one digest has many pages.
    """
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    firsts = keyed.where(F.col("size") >= revisit_from).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("first_sha"), "first_id")
    flagged = keyed.join(firsts, keyed["sha"] == firsts["first_sha"], "left").select(
        "page_id", "url", "html", F.when((F.col("page_id") > F.col("first_id")) & (F.col("size") >= revisit_from), F.col("first_id")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = split_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

        for part in text_slices(batches, "html"):
            for row in part.to_pylist():
                if out is None:
                    name, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}", compression=None)
                payload = row["html"].encode()
                member = gzip_member(record(row["page_id"], row["url"], payload, digest(payload), row["refers_to"]))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialise(flagged.mapInArrow(write, "path string, bytes long, records long"), "warc-archives")


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of the WARC header block at the start of ``data`` and where its block begins."""
    if not data.startswith(b"WARC/"):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


class Window:
    """Bytes of a file from some place on, read in pieces as they are asked for and dropped behind."""

    def __init__(self, f, size: int, at: int, piece: int = 1 << 20):
        self.f, self.size, self.at, self.piece, self.data = f, size, at, piece, b""

    def get(self, start: int, n: int) -> bytes:
        if not self.at <= start <= self.at + len(self.data):  # a place that was dropped, or one that was skipped to
            self.at, self.data = start, b""
        if start + n > self.at + len(self.data) and self.at + len(self.data) < self.size:
            end = self.at + len(self.data)
            self.f.seek(end)
            self.data += self.f.read(min(max(self.piece, start + n - end), self.size - end))
        return self.data[start - self.at : start - self.at + n]

    def drop(self, upto: int) -> None:
        if upto - self.at >= self.piece:
            self.data, self.at = self.data[upto - self.at :], upto


def member_at(window: Window, start: int) -> tuple[bytes, int] | None:
    """The inflated record and end of the member at ``start``, if a WARC record is there.

    What does not begin with ``WARC/`` is no record; a header block may be of any length.
    """
    z, out, at, head = zlib.decompressobj(31), [], start, bytearray()
    checked = False
    while not z.eof:
        piece = window.get(at, 64 << 10)
        if not piece:
            return None
        try:
            got = z.decompress(piece)
        except zlib.error:
            return None
        at += len(piece) - len(z.unused_data)
        out.append(got)
        if not checked:
            seen = max(0, len(head) - 3)
            head += got
            if not b"WARC/".startswith(head[:5]) and not head.startswith(b"WARC/"):
                return None
            if z.eof or head.find(b"\r\n\r\n", seen) >= 0:
                if parse_header(bytes(head)) is None:
                    return None
                checked = True
        else:
            window.drop(at)
    return (b"".join(out), at) if checked else None


def scan_range(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the records that start in [start, end)."""
    window, at = Window(f, size, start), start
    while at < end:
        data = window.get(at, 256 << 10)
        if not data:
            return
        hit = data.find(MAGIC)
        if hit < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
        elif at + hit >= end:
            return
        elif found := member_at(window, at + hit):
            yield at + hit, found[0]
            at = found[1]
        else:
            at += hit + 1
        window.drop(at)


def read_records(archives: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Records of archives (path, bytes): path, offset, type, ids, url, payload digest and length, payload.

    The payload of a revisit is null, its length that of the HTTP header.
    """
    starts = F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {range_bytes}L)")
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    spark = archives.sparkSession
    ranges = ranges.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                store, path = split_uri(r["path"])
                with store.open_input_file(path) as f:
                    for at, data in scan_range(f, r["bytes"], r["start"], min(r["start"] + range_bytes, r["bytes"])):
                        fields, body = parse_header(data)
                        block = data[body : body + int(fields["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        length = int(said[0]) if said and said[0].isdigit() else len(payload)
                        kind = fields["warc-type"]
                        rows.append({"path": r["path"], "offset": at, "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": length, "payload": payload if kind == "response" else None})
                        held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(read, "path string, offset long, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary")


def page_digests(records: DataFrame) -> DataFrame:
    """The contract's columns; a response's digest and length are taken from its payload, not its header."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [d if p is None else digest(p) for d, p in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)]
            n = [k if p is None else len(p) for k, p in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sha, pa.string()), pa.array(n, pa.int64())], names=["record_type", "record_id", "refers", "payload_digest", "payload_bytes"])

    columns = records.select("record_type", "record_id", F.col("refers_to").alias("refers"), "payload_digest", "payload_bytes", "payload")
    read = columns.mapInArrow(check, "record_type string, record_id string, refers string, payload_digest string, payload_bytes long")

    def page(c: str):
        return F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")

    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers").alias("refers_to"))
