import base64
import hashlib
import io
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from wireloom.llm import warc

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "http://e/", "é" * 50_000)]
PAGES += [(0, "http://late/", "<p>one</p>"), (7, "http://g/", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (5, "http://e/", "é" * 50_000), (None, "u", "alone"), (None, "v", "<p>one</p>")]


def want():
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        least = first.get(h or "")
        again = least is not None and i != least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


def test_records_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload", "2 AS sha").repartition(3)
    written = warc.write_packages(pages)
    assert sum(r.records for r in written.collect()) == len(PAGES)
    rows = warc.read_packages(written).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == want()
    texts = {(r.page_id, bytes(r.payload).decode()) for r in rows if r.record_type == "response"}
    assert (5, "é" * 50_000) in texts and (None, "alone") in texts


def test_small_payloads_are_never_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    rows = warc.read_packages(warc.write_packages(pages, least=3)).collect()
    assert {r.page_id: r.record_type for r in rows} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_packages(warc.write_packages(pages)).count() == 0


def test_a_package_is_a_zip_with_stored_members():
    records = [warc.record(i, "http://x/", b"payload %d" % i, None) for i in range(5)]
    with zipfile.ZipFile(io.BytesIO(warc.package(records))) as z:
        assert z.testzip() is None
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert z.read(warc.ARCHIVE) == b"".join(records)


def test_zip64_places_are_read():
    data = b"".join(warc.record(i, "http://x/", b"payload", None) for i in range(3))
    name = warc.ARCHIVE.encode()
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    central += name + extra
    at = len(local) + len(data)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = local + data + central + end64 + locator + end
    file = io.BytesIO(whole)
    assert warc.members(file, len(whole)) == {warc.ARCHIVE: (0, len(data), 0)}
    (start, length), = warc.ranges_of(file, len(whole))
    assert len(list(warc.parse(whole[start : start + length]))) == 3


def test_damage_is_reported(spark, tmp_path):
    records = [warc.record(1, "http://x/", b"payload", None)]
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no zip at all" * 9), 117)
    with pytest.raises(ValueError):
        list(warc.parse(records[0][:-9]))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.ARCHIVE, records[0])
    with pytest.raises(ValueError):
        warc.ranges_of(packed, len(packed.getvalue()))


def test_packages_without_index_and_plain_archives(spark, tmp_path):
    import gzip

    plain = b"".join(gzip.decompress(warc.record(i, "http://x/", b"p%d" % i, None)) for i in range(4))
    path = os.path.join(tmp_path, "other.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("data/other.warc", plain)
    rows = warc.read_packages(spark.createDataFrame([(path,)], "path string")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in rows) == [(i, b"p%d" % i) for i in range(4)]


def test_the_bytes_decide_how_many_tasks_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 5_000)
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://a.org/', id) as url", "repeat(sha2(cast(id as string), 512), 3) as html")
    records = warc.read_packages(warc.write_packages(pages))
    assert records.select("page_id").distinct().count() == 400
    assert records.select(F.spark_partition_id().alias("p")).distinct().count() > 3
