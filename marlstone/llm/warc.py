"""WARC records in ZIP packages: written once, then range-read through the packages' directories."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import only, partitions, shared_folder, sliced, written

#: Members of a package (fixed values).
DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: A package is closed when its records reach so many bytes.
PACKAGE_BYTES = 48 << 20
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 4 << 20
#: Payloads under so many bytes are stored each time.
LEAST_REVISIT = 100
#: Repeated digests (about 100 bytes each) up to which their table is broadcast; more meet the pages
#: by a shuffle, in which each digest is dealt to so many tasks.
BROADCAST_DIGESTS, SALTS = 200_000, 32
#: Package bytes that a task reads back, on average.
TASK_BYTES = 256 << 20
_NO16, _NO32 = 0xFFFF, 0xFFFFFFFF


# ---- packages -------------------------------------------------------------------------------


def package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members. ``zip64`` forces the large forms, which big ones get anyway."""
    out, central = io.BytesIO(), io.BytesIO()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), out.tell()
        big = zip64 or len(data) >= _NO32 or at >= _NO32
        size = _NO32 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out.write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        fields = (b"PK\x01\x02", 45, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _NO32 if big else at)
        central.write(struct.pack("<4s6H3I5H2I", *fields) + raw + extra)
    at, directory, n = out.tell(), central.getvalue(), len(members)
    out.write(directory)
    if zip64 or n >= _NO16 or at >= _NO32:
        end = out.tell()
        out.write(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(directory), at))
        out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        out.write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, _NO16, _NO16, _NO32, _NO32, 0))
    else:
        out.write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, n, n, len(directory), at, 0))
    return out.getvalue()


class Package:
    """A ZIP file's stored members, located through its directories and read by ranges.

    ``read(offset, length)`` gives bytes of the file, ``size`` is its length. Nothing is extracted;
    compressed or encrypted members are listed, but can't be read by ranges.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self._read, self.size = read, size
        self.members = {name: place for name, *place in self._directory()}

    def _directory(self) -> Iterator[tuple[str, int, int, int]]:
        tail_at = max(0, self.size - 65557)
        tail = self._read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") > len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        n, length, start = struct.unpack("<10xH2I", tail[at : at + 20])
        if _NO16 == n or _NO32 in (length, start):
            mark, where = struct.unpack("<4s4xQ4x", self._read(tail_at + at - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("the ZIP64 locator is missing")
            mark, n, length, start = struct.unpack("<4s28x3Q", self._read(where, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("the ZIP64 end of central directory is missing")
        raw, at = self._read(start, length), 0
        for _ in range(n):
            mark, flags, method, packed, plain, named, extras, comment, offset = struct.unpack("<4s4x2H8x2I3H8xI", raw[at : at + 46])
            if mark != b"PK\x01\x02":
                raise ValueError("a central directory entry is damaged")
            name = raw[at + 46 : at + 46 + named].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + named : at + 46 + named + extras]
            at += 46 + named + extras + comment
            while len(extra) >= 4:
                kind, size = struct.unpack("<2H", extra[:4])
                if kind == 1:
                    wide = iter(struct.unpack(f"<{size // 8}Q", extra[4 : 4 + size // 8 * 8]))
                    plain, packed, offset = (next(wide) if x == _NO32 else x for x in (plain, packed, offset))
                extra = extra[4 + size :]
            yield name, offset, packed, -1 if flags & 1 else method

    def locate(self, name: str) -> tuple[int, int]:
        """(offset in the file, length) of a stored member's bytes."""
        offset, length, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored plainly")
        mark, named, extras = struct.unpack("<4s22x2H", self._read(offset, 30))
        if mark != b"PK\x03\x04":
            raise ValueError(f"the local header of {name} is damaged")
        return offset + 30 + named + extras, length

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        at, size = self.locate(name)
        length = size - start if length is None else length
        if start < 0 or start + length > size:
            raise ValueError(f"the range leaves {name}")
        return self._read(at + start, length)


# ---- records --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Record:
    """One page as a WARC record. A revisit has no payload; its header names length and digest."""

    page_id: int | None
    url: str
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None

    @property
    def kind(self) -> str:
        return "response" if self.refers_to is None else "revisit"

    def raw(self) -> bytes:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        block = http + (self.payload or b"") if self.kind == "response" else http
        heads = [
            ("WARC-Type", self.kind),
            ("WARC-Record-ID", f"<urn:page:{'' if self.page_id is None else self.page_id}>"),
            ("WARC-Target-URI", "".join(self.url.splitlines())),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha-256:{self.payload_digest}"),
            ("Payload-Length", str(self.payload_bytes)),
        ]
        if self.kind == "revisit":
            heads.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
            heads.append(("WARC-Refers-To", f"<urn:page:{self.refers_to}>"))
        heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
        lines = "".join(f"{k}: {v}\r\n" for k, v in heads)
        return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"

    @classmethod
    def parse(cls, raw: bytes) -> Record:
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        heads = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(heads["Content-Length"])]
        payload = block.partition(b"\r\n\r\n")[2] if heads["WARC-Type"] == "response" else None
        number = lambda x: int(d) if (d := x.removeprefix("<urn:page:").removesuffix(">")) else None
        digest = heads["WARC-Payload-Digest"].removeprefix("sha-256:")
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {heads['WARC-Record-ID']} doesn't have its digest")
        refers = number(heads["WARC-Refers-To"]) if "WARC-Refers-To" in heads else None
        return cls(number(heads["WARC-Record-ID"]), heads["WARC-Target-URI"], payload, int(heads["Payload-Length"]), digest, refers)


def packed(records: list[bytes], keys: list[str], zip64: bool = False) -> bytes:
    """A package of records, each a gzip member of its own, with an index of their ranges."""
    data, lines, at = [], [], 0
    for raw, key in zip(records, keys, strict=True):
        data.append(gzip.compress(raw, 6, mtime=0))
        lines.append(f"{key} {json.dumps({'offset': at, 'length': len(data[-1])})}\n")
        at += len(data[-1])
    about = json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode()
    return package([(DATA, b"".join(data)), (INDEX, "".join(lines).encode()), (ABOUT, about)], zip64)


def read_records(archive: Package, wanted: set[str] | None = None) -> Iterator[tuple[Record, int, int]]:
    """(record, offset, length) of the index's entries, or of those whose key is wanted."""
    ranges = []
    for line in archive.read(INDEX).decode().splitlines():
        key, _, entry = line.partition(" ")
        if wanted is None or key in wanted:
            found = json.loads(entry)
            ranges.append((found["offset"], found["length"]))
    ranges.sort()
    k = 0
    while k < len(ranges):
        last = k
        while last + 1 < len(ranges) and ranges[last + 1][0] == sum(ranges[last]) and sum(ranges[last + 1]) - ranges[k][0] <= READ_BYTES:
            last += 1
        start = ranges[k][0]
        some = archive.read(DATA, start, sum(ranges[last]) - start)
        for offset, length in ranges[k : last + 1]:
            yield Record.parse(gzip.decompress(some[offset - start : offset - start + length])), offset, length
        k = last + 1


def open_package(uri: str):
    """(package, its file) at a URI of any store that ``pyarrow.fs`` reads."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    file = store.open_input_file(path)
    return Package(lambda at, n: file.read_at(n, at), file.size()), file


# ---- operators ------------------------------------------------------------------------------


def with_first(pages: DataFrame, least: int = LEAST_REVISIT, most_broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): of equal payloads of
    ``least`` bytes or more, all but the smallest page_id refer to it. Only digests that repeat are
    gathered; all copies of one are never sent to one task with their payloads."""
    rows = only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").drop("n"))
    if groups.count() <= most_broadcast:  # the pages stay where they are
        joined = rows.join(F.broadcast(groups), "payload_digest", "left")
    else:
        salted = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt"], "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(later, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages as WARC packages to ``folder`` (a URI; by default below the shared folder)
    and gives (archive, records, bytes) of the packages that count: a task that was repeated leaves
    packages that no row names."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        held: list[bytes] = []
        keys: list[str] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, keys, size
            if held:
                store.create_dir(f"{root}/packages", recursive=True)
                name = f"packages/{uuid.uuid4().hex}.wacz"
                data = packed(held, keys)
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], ["archive", "records", "bytes"]
                )
            held, keys, size = [], [], 0

        for batch in sliced(batches):
            for page, url, payload, n, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = Record(page, url, payload, n, digest, refers).raw()
                held.append(raw)
                keys.append("-" if page is None else str(page))
                size += len(raw)
                if size >= PACKAGE_BYTES:
                    yield from close()
        yield from close()

    table = with_first(pages).mapInArrow(write, "archive string, records long, bytes long")
    table.write.parquet(f"{folder}/manifest")
    return spark.read.schema(table.schema).parquet(f"{folder}/manifest")


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def read_packages(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the packages in column ``archive``, checked against its digest.

    Packages are dealt by ranges of their names to as many tasks as there are shuffle partitions, or
    more where their column ``bytes`` says so. A revisit has a null payload; ``payloads=False`` leaves all of them out of the result. A damaged
    package or a wrong digest is an error. No packages give no rows; other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                archive, file = open_package(uri)
                with file:
                    rows = []
                    for r, offset, length in read_records(archive):
                        rows.append((r.page_id, r.url, r.payload if payloads else None, r.payload_bytes, r.payload_digest, r.kind, r.refers_to, uri, offset, length))
                        if len(rows) >= 128:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    listed = archives.where("archive IS NOT NULL")
    size = F.sum("bytes") if "bytes" in archives.columns else F.lit(None).cast("long")
    found = listed.agg(F.count("*").alias("n"), size.alias("bytes")).first()
    tasks = max(1, min(found.n, max(partitions(archives.sparkSession), (found.bytes or found.n * PACKAGE_BYTES) // TASK_BYTES)))
    # rows of a list are tiny, so the number of tasks is stated: adaptive execution would join them to one
    return listed.select("archive").repartitionByRange(tasks, "archive").mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), *[pa.string()] * 2, pa.int64(), pa.string(), *[pa.int64()] * 2)
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """All pages written as packages and read back: one row per page, without the payloads.

    Null html counts as empty, a null url too; very long html is a record like others (a package is
    closed behind it); of repeated rows with one id all are kept, and all
    are responses or revisits alike; null ids are never referred to; an empty table gives no rows;
    other columns are ignored.
    """
    return read_packages(write_packages(pages, folder), payloads=False).drop("payload")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` through WARC packages."""
    rows = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of the whole result.
SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f"""
