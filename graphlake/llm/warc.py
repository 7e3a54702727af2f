"""WARC archives packed in ZIP files: a writer, and a reader that never extracts.

The reader parses a ZIP's end record, its ZIP64 records and its central directory, locates the stored archive
members and the indexes, turns index lines into byte ranges of the file, and reads just those ranges.
Folders are reached through Arrow's file systems, so any shared store that Arrow knows will do.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import Scratch, if_small, table

INDEX, ARCHIVE = "indexes/index.cdxj", "archive/data.warc.gz"
#: Fixed values of the ZIP format: signatures of the end record, ZIP64 locator and end record, directory entry, local header.
EOCD, LOCATOR64, EOCD64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED = 0, 8


@dataclass(frozen=True)
class Packing:
    """least: bytes from which equal payloads are stored once; archive: payload bytes after which a new file begins; level: of gzip; span: bytes of an archive that are read together; tasks: most reading tasks, which then read several spans."""

    least: int = 100
    archive: int = 64 << 20
    level: int = 1
    span: int = 4 << 20
    tasks: int = 50_000
    date: str = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    compressed: int
    size: int
    start: int  # of its data


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _at(f, start: int, n: int) -> bytes:
    f.seek(start)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"the archive ends within a range of {n} bytes at {start}")
    return got


def directory(f, size: int) -> list[Member]:
    """The members of a ZIP file of ``size`` bytes, from its central directory; ZIP64 records are followed."""
    tail = _at(f, max(0, size - 65_557), min(size, 65_557))
    k = tail.rfind(EOCD)
    while k >= 0 and (len(tail) < k + 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(EOCD, 0, k)  # the signature may occur in a comment
    if k < 0:
        raise ValueError("no end of a central directory: not a ZIP file, or a truncated one")
    end = size - len(tail) + k
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        where = _at(f, end - 20, 20) if end >= 20 else b""
        if where[:4] == LOCATOR64:
            wide = _at(f, struct.unpack_from("<Q", where, 8)[0], 56)
            if wide[:4] != EOCD64:
                raise ValueError("the ZIP64 locator does not lead to a ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", wide, 32)
    raw, at, out = _at(f, start, length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("a broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        local = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # 8-byte values of just the fields that overflow, in this order
                v = e + 4
                if full == 0xFFFFFFFF:
                    full, v = struct.unpack_from("<Q", extra, v)[0], v + 8
                if packed == 0xFFFFFFFF:
                    packed, v = struct.unpack_from("<Q", extra, v)[0], v + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", extra, v)[0]
            e += 4 + n
        head = _at(f, local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        n_name2, n_extra2 = struct.unpack_from("<HH", head, 26)
        out.append(Member(name, method, packed, full, local + 30 + n_name2 + n_extra2))
        at += 46 + n_name + n_extra + n_comment
    return out


def content(f, m: Member) -> bytes:
    raw = _at(f, m.start, m.compressed)
    if m.method == STORED:
        return raw
    if m.method == DEFLATED:
        return zlib.decompress(raw, -15)
    raise ValueError(f"{m.name}: compression method {m.method}")


def _index_line(line: bytes, fields: list[str] | None) -> tuple[str, int, int | None]:
    """(file name, offset, length or None) of a line with JSON, or of a classic one whose header names its fields: g, V and S."""
    if fields is None:
        # The JSON is the whole line, or follows a key, or a key and a timestamp; keys hold no blanks, but may hold braces.
        for n in range(3):
            rest = line.strip().split(None, n)[n:]
            if rest and rest[0].startswith(b"{"):
                try:
                    x = json.loads(rest[0])
                except ValueError:  # a key that begins like JSON
                    continue
                return x["filename"], int(x["offset"]), int(x["length"])
        raise ValueError(f"an index line without JSON and without a header before it: {line[:80]!r}")
    values = dict(zip(fields, line.decode().split(), strict=False))
    if len(values) < len(fields) or not {"g", "V"} <= values.keys():
        raise ValueError(f"an index line that does not have the fields of its header: {line[:80]!r}")
    return values["g"], int(values["V"]), int(values["S"]) if values.get("S", "-") != "-" else None


def index_ranges(f, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) in the file of every record that an index names, in index order.

    Index lines hold JSON, or are classic ones below a `` CDX`` header; a classic line without a length ends where the next indexed
    record of its file begins.  Empty lines and lines of comment (``!``) hold no record; any other line and a file without an index
    are errors, so no record is left out in silence.
    """
    members = {m.name: m for m in directory(f, size)}
    indexes = [m for name, m in members.items() if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))]
    if not indexes:
        raise ValueError("the archive has no index: no member indexes/*.cdx, *.cdxj or either with .gz")
    for m in indexes:
        raw, fields, found = content(f, m), None, []
        for line in (gzip.decompress(raw) if m.name.endswith(".gz") else raw).splitlines():
            if line.lstrip().startswith(b"CDX ") and (line[:1] == b" " or b"{" not in line):
                fields = line.decode().split()[1:]
            elif line.strip() and not line.startswith(b"!"):
                found.append(_index_line(line, fields))
        starts: dict[str, list[int]] = {}
        for name, start, n in found:
            starts.setdefault(name, []).append(start)
        for at in starts.values():
            at.sort()
        for name, start, n in found:
            to = members.get(name) or members.get(f"archive/{name}")
            if to is None or to.method != STORED:
                raise ValueError(f"{name} is not a stored member")
            if n is None:
                after = bisect_right(starts[name], start)
                n = (starts[name][after] if after < len(starts[name]) else to.size) - start
            if start + n > to.size:
                raise ValueError(f"an index range ends beyond {to.name}")
            yield to.start + start, n


def build_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed.  A revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=~-._", errors="surrogatepass"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}, rest


def parse_record(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (None in a revisit) of an uncompressed record.

    A stored payload must have the digest and the length that its headers state.
    """
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record at this range")
    warc, rest = _headers(raw)
    http, body = _headers(rest[: int(warc["content-length"])])
    number = lambda urn: None if urn is None or urn == "<urn:page:None>" else int(urn[10:-1])
    digest, n = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
    revisit = warc["warc-type"] == "revisit"
    if not revisit and (len(body) != n or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"{warc['warc-record-id']}: the payload is damaged")
    url = warc.get("warc-target-uri")
    return {"page_id": number(warc["warc-record-id"]), "url": None if url is None else unquote(url, errors="surrogatepass"), "record_type": warc["warc-type"], "refers_to": number(warc.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": n, "payload": None if revisit else body}


def pack(target, records: Iterator[tuple[bytes, bytes]], level: int) -> int:
    """Writes (index key, record) pairs as a ZIP of a stored archive member and its index; returns the number of records."""
    n, lines = 0, []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as out:
            at = 0
            for key, raw in records:
                packed = gzip.compress(raw, level, mtime=0)
                out.write(packed)
                lines.append(key + b" " + json.dumps({"filename": ARCHIVE, "offset": str(at), "length": str(len(packed))}).encode())
                at, n = at + len(packed), n + 1
        z.writestr(zipfile.ZipInfo(INDEX), b"\n".join(lines))
    return n


def _write(folder: str, p: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, bytes, int]]:
            for b in batches:
                cols = (b.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))
                for row in zip(*cols, strict=True):
                    page, url, html, digest, refers = (x.as_py() for x in row)
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    kind = "response" if refers is None else "revisit"
                    raw = build_record(kind, page, url, payload, digest, refers, p.date)
                    yield f"urn:page:{page} {p.date}".encode(), raw, len(raw)

        source, first = rows(), None
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        while (first := next(source, None)) is not None:

            def some(head=first) -> Iterator[tuple[bytes, bytes]]:
                held = 0
                while head is not None:
                    yield head[:2]
                    held += head[2]
                    head = next(source, None) if held < p.archive else None

            # A task that runs twice writes other names; only the files of the run that counts are in the returned table.
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as target:
                n = pack(target, some(), p.level)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, p: Packing = Packing()) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html) and returns (path, records), to be evaluated once.

    Of rows with equal payloads of ``least`` bytes or more the one of the smallest page_id is a response (all of
    its rows, if repeated) and the others revisit it.  Null html: an empty payload; null url: no target
    header; null page_id: always a response, as it can neither refer nor be referred to.  An empty table
    writes no archive.  Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    same = rows.where(F.octet_length("html") >= p.least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    # Written, so that the join has plain exchanges on both sides and a hot digest can be split.
    same = if_small(Scratch(pages.sparkSession, "same").write(same.where("first < last").select("digest", "first"), "same"), F.lit(80))
    out = rows.join(same, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    return out.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(folder, p), "path string, records bigint")


def list_records(archives: DataFrame) -> DataFrame:
    """(path, start, length) of every indexed record of archives(path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = _fs(path)
                with fs.open_input_file(at) as f:
                    ranges = list(index_ranges(f, f.size()))
                if ranges:
                    starts, lengths = zip(*ranges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["path", "start", "length"])

    return archives.where("path is not null").select("path").mapInArrow(run, "path string, start bigint, length bigint")


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def read_records(ranges: DataFrame, p: Packing = Packing(), payloads: bool = True) -> DataFrame:
    """The records at ranges(path, start, length), each read by its range; payloads: whether to return these.  The ranges are read twice, so a written table serves best."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    names = names if payloads else names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, f = None, None
        for b in batches:
            got: dict[str, list] = {n: [] for n in names}
            held = 0

            def batch(got=got) -> pa.RecordBatch:
                kinds = {"url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}
                return pa.RecordBatch.from_arrays([pa.array(got[n], kinds.get(n, pa.int64())) for n in names], names)

            for path, start, n in zip(*(b.column(c).to_pylist() for c in ("path", "start", "length")), strict=True):
                if path != open_path:
                    if f is not None:
                        f.close()
                    fs, at = _fs(path)
                    open_path, f = path, fs.open_input_file(at)
                raw = _at(f, start, n)
                x = parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                for k in names:
                    got[k].append(x[k])
                held += len(x["payload"] or b"") if payloads else 1
                if held >= p.span:
                    yield batch()
                    held, got = 0, {n: [] for n in names}
            yield batch(got)
        if f is not None:
            f.close()

    # By the bytes to be read, not by those of the ranges, which are few.
    total = ranges.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(ranges.sparkSession.sparkContext.defaultParallelism, -(-total // p.span)), p.tasks)
    spans = ranges.repartition(tasks, F.col("path"), F.floor(F.col("start") / p.span)).sortWithinPartitions("path", "start")
    return spans.mapInArrow(run, RECORD if payloads else RECORD.rpartition(",")[0])


def op6_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes pages as archives into the shared folder and reads these back: page_id, payload_bytes, payload_digest, record_type, refers_to; see write_archives for odd rows."""
    scratch = Scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    written = scratch.write(write_archives(pages, f"{scratch.path}/archives"), "manifest")
    ranges = scratch.write(list_records(written), "ranges")
    return read_records(ranges, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
