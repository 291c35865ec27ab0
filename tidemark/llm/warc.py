"""WARC records in ZIP archives: written as stored members with an index, read back in ranges without extraction.

An archive has members archive/part-N.warc.gz, each a run of records that are gzip members of their own, and
indexes/index.tsv, a line per record: member, offset in it, length. The reader parses the end record, the ZIP64 locator
and end record and the central directory, finds where each stored member's bytes begin, and reads records by range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sealed, new_path, store

INDEX = "indexes/index.tsv"
#: Bytes of a member and of an archive from which the next one begins.
MEMBER_BYTES, ARCHIVE_BYTES = 16 << 20, 256 << 20
#: Records that one reading task gets as a unit; ranges closer than GAP are read at once, up to SPAN bytes.
RECORDS, GAP, SPAN = 2_000, 64 << 10, 8 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, payload: bytes, digest: str, record_id: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has the response's HTTP head, with its length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", " ".join(uri.split())), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 3, mtime=0)


class Record(NamedTuple):
    kind: str
    record_id: str
    uri: str
    refers_to: str | None
    digest: str
    payload_bytes: int
    payload: bytes | None


def parse_record(raw: bytes) -> Record:
    """A gzip member as a record; a response's payload must have the stated digest."""
    head, _, block = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    f = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(f["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    if f["WARC-Type"] == "revisit":
        payload = None
    elif len(payload) != length or payload_digest(payload) != digest:
        raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't match its digest")
    return Record(f["WARC-Type"], f["WARC-Record-ID"], f["WARC-Target-URI"], f.get("WARC-Refers-To"), digest, length, payload)


class Member(NamedTuple):
    name: str
    method: int
    offset: int  # of its local header
    size: int


class Archive:
    """A ZIP file read by ranges. source: size() and read_at()-like file from pyarrow."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def directory(self) -> list[Member]:
        """The central directory, by the ZIP64 end record where there is one."""
        tail_at = max(0, self.size - 65_557)
        tail = self.at(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, end + 10)
        locator = tail_at + end - 20
        if locator >= 0 and (loc := self.at(locator, 20))[:4] == b"PK\x06\x07":
            far = self.at(struct.unpack_from("<Q", loc, 8)[0], 56)
            if far[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator says")
            count, length, offset = struct.unpack_from("<QQQ", far, 32)
        raw, p, out = self.at(offset, length), 0, []
        for _ in range(count):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            method, (packed, full), (n_name, n_extra, n_note) = struct.unpack_from("<H", raw, p + 10)[0], struct.unpack_from("<II", raw, p + 20), struct.unpack_from("<HHH", raw, p + 28)
            start = struct.unpack_from("<I", raw, p + 42)[0]
            name = raw[p + 46 : p + 46 + n_name].decode()
            extra, q = raw[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, q)
                if tag == 1:  # ZIP64: those of the three that are all ones, in this order
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    start = wide.pop(0) if start == 0xFFFFFFFF else start
                q += 4 + n
            out.append(Member(name, method, start, packed))
            p += 46 + n_name + n_extra + n_note
        return out

    def begin(self, m: Member) -> int:
        """Where a stored member's bytes begin: past its local header, whose extra field may differ from the directory's."""
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{m.name} isn't stored")
        h = self.at(m.offset, 30)
        if h[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {m.name}")
        return m.offset + 30 + sum(struct.unpack_from("<HH", h, 26))


def _filesystem(path: str):
    """(file system, path in it) of a path or URI, also off the local machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _write(folder: str):
    def save(fs, base: str, members: list[tuple[str, bytes]], lines: list[str]) -> None:
        members = [*members, (INDEX, "".join(lines).encode())]
        # Moved when whole: what has the name of an archive is one.
        mine = f"{base}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(mine) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
            for name, data in members:
                z.writestr(zipfile.ZipInfo(name), data)
        fs.move(mine, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _filesystem(folder)
        fs.create_dir(root)
        # Attempts of a task may get their rows in another order, so each has archives of its own; the manifest says whose count.
        part, attempt, n, made = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, []
        members, lines, buf, total = [], [], io.BytesIO(), 0

        def roll():
            nonlocal buf, total
            if buf.tell():
                total += buf.tell()
                members.append((f"archive/part-{len(members):05d}.warc.gz", buf.getvalue()))
                buf = io.BytesIO()

        def close():
            nonlocal members, lines, total, n
            roll()
            if members:
                name = f"part-{part:06d}-{attempt}-{n:05d}.zip"
                save(fs, f"{root}/{name}", members, lines)
                made.append((f"{folder}/{name}", len(lines)))
                members, lines, total, n = [], [], 0, n + 1

        for b in batches:
            for uri, html, digest, rid, ref in zip(*(b.column(c).to_pylist() for c in ("uri", "html", "digest", "rid", "ref")), strict=True):
                raw = record("response" if ref is None else "revisit", uri or "", html or b"", digest, rid, ref)
                lines.append(f"archive/part-{len(members):05d}.warc.gz\t{buf.tell()}\t{len(raw)}\n")
                buf.write(raw)
                if buf.tell() >= MEMBER_BYTES:
                    roll()
                if total >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([k for _, k in made], pa.int64())], names=["path", "records"])

    return run


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row into archives in folder; returns their manifest (path, records), which is stored.

    Of records with equal payloads of at least min_bytes, that with the smallest id is response and the others are
    revisits of it; rows that share the smallest id are all responses, and so is a row with a null id. The payload is
    the html in UTF-8; null is empty. A null url is empty. The folder must be one that all executors share.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    s = Sealed(pages, id_col, url_col, html_col)
    html = F.coalesce(s[html_col].cast("binary"), F.lit(b""))
    p = s.df.select(s[id_col].cast("long").alias("id"), s[url_col].alias("uri"), html.alias("html"))
    sha = F.sha1("html")
    ids = store(p.where(F.octet_length("html") >= min_bytes).select("id", F.unhex(sha).alias("sha")), "payloads")
    first = store(ids.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"), "first-payloads")
    again = ids.join(first, "sha").where("id > first").select("id", "sha", "first").distinct()
    both = p.withColumn("sha", F.unhex(sha)).join(again, ["id", "sha"], "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    rid = F.coalesce(name(F.col("id")), F.lit("<urn:page:>"))
    rows = both.select("uri", "html", _base32("sha").alias("digest"), rid.alias("rid"), name(F.col("first")).alias("ref"))
    return store(rows.mapInArrow(_write(folder), "path string, records long"), "warc-manifest")


def _base32(sha):
    """Base 32 of a 20-byte digest: 32 letters, from four parts of 40 bits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(4):
        n = F.conv(F.hex(F.substring(sha, 1 + 5 * i, 5)), 16, 10).cast("long")
        out += [F.substring(letters, F.shiftright(n, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*out)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From archives to units of at most RECORDS records: path, offsets and lengths in the file."""
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, p = _filesystem(path)
            with fs.open_input_file(p) as f:
                a = Archive(f, f.size())
                members = {m.name: m for m in a.directory()}
                begins = {n: a.begin(m) for n, m in members.items()}
                lines = a.at(begins[INDEX], members[INDEX].size).decode().splitlines()
            where = []
            for line in lines:
                name, offset, length = line.split("\t")
                if int(offset) + int(length) > members[name].size:
                    raise ValueError(f"{path}: the index goes past {name}")
                where.append((begins[name] + int(offset), int(length)))
            for i in range(0, len(where), RECORDS):
                o, n = zip(*where[i : i + RECORDS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([list(o)], pa.list_(pa.int64())), pa.array([list(n)], pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])


def _ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(first, past last, offset, bytes) of runs of near ranges."""
    i = 0
    while i < len(offsets):
        j, end = i + 1, offsets[i] + lengths[i]
        while j < len(offsets) and end <= offsets[j] <= end + GAP and offsets[j] + lengths[j] - offsets[i] <= SPAN:
            end = offsets[j] + lengths[j]
            j += 1
        yield i, j, offsets[i], end - offsets[i]
        i = j


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offsets, lengths in zip(*(b.column(c).to_pylist() for c in ("path", "offsets", "lengths")), strict=True):
                fs, p = _filesystem(path)
                with fs.open_input_file(p) as f:
                    for i, j, at, n in _ranges(offsets, lengths):
                        f.seek(at)
                        raw = f.read(n)
                        rows = [parse_record(raw[offsets[k] - at : offsets[k] - at + lengths[k]]) for k in range(i, j)]
                        cols = [pa.array([getattr(r, c) for r in rows], t) for c, t in (("kind", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()))]
                        cols.append(pa.array([r.payload if payloads else None for r in rows], pa.binary()))
                        yield pa.RecordBatch.from_arrays(cols, names=["record_type", "record_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload"])

    return run


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in manifest.path: record_type, record_id, url, refers_to, payload_digest,
    payload_bytes (of the full payload, for revisits too) and payload (null for revisits, or if not asked for).

    Archives are opened and their indexes read first; records are then dealt out in units, and read by range. A response
    whose payload has another digest than stated is an error. An empty manifest gives no rows.
    """
    units = manifest.select("path").mapInArrow(_index, "path string, offsets array<long>, lengths array<long>")
    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    units = units.repartition(int(n), F.xxhash64("path", F.col("offsets")[0]))
    return units.mapInArrow(_read(payloads), "record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def page_of(record_id):
    """The page's id in a record's name; null where it has none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
