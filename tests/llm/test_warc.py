import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.llm import warc
from marlstone.llm.warc import Package, Record, archive_pages, package, packed, read_packages, read_records, write_packages


def opened(data, log=None):
    def read(at, n):
        if log is not None:
            log.append((at, n))
        assert 0 <= at and at + n <= len(data)
        return data[at : at + n]

    return Package(read, len(data))


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    members = [("a/b.bin", bytes(range(256)) * 10), ("é.txt", b""), ("z", b"PK\x05\x06 inside")]
    data = package(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    mine = opened(data)
    assert [(n, mine.read(n)) for n in mine.members] == members
    assert mine.read("a/b.bin", 250, 12) == members[0][1][250:262]
    with pytest.raises(ValueError):
        mine.read("a/b.bin", 2500, 100)


def test_other_writers_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("x"), b"stored")
        z.writestr("y", b"deflated" * 100, zipfile.ZIP_DEFLATED)
        with z.open("w", "w", force_zip64=True) as f:
            f.write(b"wide")
        z.comment = b"note"
    mine = opened(out.getvalue())
    assert mine.read("x") == b"stored" and mine.read("w") == b"wide" and "y" in mine.members
    with pytest.raises(ValueError):
        mine.read("y")
    with pytest.raises(ValueError):
        opened(b"no package at all")


def test_records_round_trip_by_ranges():
    r = random.Random(1)
    records = []
    for i in range(300):
        body = r.randbytes(r.randint(0, 3000)) + b"\r\n\r\n"
        digest = hashlib.sha256(body).hexdigest()
        records.append(Record(i, f"http://x/{i}\r\nx: é", body, len(body), digest, None) if i % 3 else Record(i, "u", None, len(body), digest, 7))
    data, log = packed([x.raw() for x in records], [str(i) for i in range(300)]), []
    archive = opened(data, log)
    got = [x for x, _, _ in read_records(archive)]
    assert [(g.page_id, g.payload, g.payload_bytes, g.payload_digest, g.refers_to) for g in got] == [(x.page_id, x.payload, x.payload_bytes, x.payload_digest, x.refers_to) for x in records]
    log.clear()
    assert [x.page_id for x, _, _ in read_records(archive, {"5", "200"})] == [5, 200]
    assert sum(n for _, n in log) < len(data) / 4 + archive.locate(warc.INDEX)[1]


def test_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 20000)
    pages = [None, "", "short", "short", "x" * 100, "x" * 100, "y" * 99, "y" * 99, "é" * 50, "é" * 50, "long " * 50000] + [f"<p>{i % 9}</p>" * 40 for i in range(200)]
    df = spark.createDataFrame([(i, f"http://e/{i}" if i % 2 else None, h, "c") for i, h in enumerate(pages)] + [(None, "u", "x" * 100, "c")], "page_id long, url string, html string, payload string")
    got = {g.page_id: g for g in archive_pages(df).collect()}
    first = {}
    for i, h in enumerate(pages):
        raw = (h or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        refers = first.setdefault(digest, i) if len(raw) >= 100 else i
        want = (len(raw), digest, "response", None) if refers == i else (len(raw), digest, "revisit", refers)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert len(got) == len(pages) + 1 and got[None].refers_to == 4
    full = {g.page_id: g.payload for g in read_packages(write_packages(df)).collect()}
    assert bytes(full[10]) == pages[10].encode() and full[5] is None
    assert archive_pages(df.limit(0)).count() == 0


def test_repeated_ids_long_payloads_and_shuffled_digests(spark, monkeypatch):
    rows = [(1, "a", "p" * 150), (1, "b", "p" * 150), (2, "c", "p" * 150), (3, "d", "é" * 3_000_000), (None, "e", "p" * 150), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((g.page_id or 0, g.payload_bytes, g.record_type, g.refers_to) for g in archive_pages(df).collect())
    assert got == [(0, 0, "response", None), (0, 150, "revisit", 1), (1, 150, "response", None), (1, 150, "response", None), (2, 150, "revisit", 1), (3, 6_000_000, "response", None)]
    monkeypatch.setattr(warc.with_first, "__defaults__", (100, 0))  # as for too many repeated digests to broadcast
    assert sorted((g.page_id or 0, g.payload_bytes, g.record_type, g.refers_to) for g in archive_pages(df).collect()) == got


def test_many_tasks_read_many_packages(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 5000)
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 100) for i in range(200)], "page_id long, url string, html string").repartition(3)
    archives = write_packages(df)
    n = archives.count()
    per = read_packages(archives, payloads=False).groupBy(F.spark_partition_id().alias("t")).agg(F.countDistinct("archive").alias("n")).collect()
    assert n > 20 and len(per) >= 6 and max(r.n for r in per) <= n / 3
    monkeypatch.setattr(warc, "TASK_BYTES", 6000)  # more tasks than shuffle partitions where the packages are large
    assert read_packages(archives, payloads=False).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
