"""Web archives packaged as ZIP files: written, and read by ranges.

A package holds an archive of separately compressed WARC records and an index
with the place of each record, both stored, not compressed again. The reader
looks at a package's end, follows the ZIP64 locator where there is one, takes
the members' places from the central directory, reads the index, cuts the
records into ranges of a few megabytes, deals the ranges out, and reads each
with one ranged request; nothing is unpacked to disk and no package is read
whole. A package without an index is read member by member, as one range each.

Records with equal payloads become one response, of the row with the least id,
and revisits of it. Null and empty payloads are payloads of no bytes. Rows that
share id and payload with the response are responses too; a null id is never
least unless all are null, and then all are responses. An empty table gives no
package and an empty result. Columns beside the three used are ignored.

Packages are written by the tasks to the shared folder under names of their own;
the list of those that count is what the finished tasks return, so a lost
executor or a second attempt leaves a file behind but never a record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from wireloom.functions.shipping import ship
from wireloom.llm.text import quoted
from wireloom.sources.staging import materialize, staging_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes after which a task begins another package, and bytes of one ranged read.
PACKAGE_BYTES = 32_000_000
RANGE_BYTES = 4_000_000
#: Bytes that one task reads, and packages whose directories one task looks at.
TASK_BYTES = 12_000_000
LOCATED_PACKAGES = 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ZIP64 = 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page, url: str | None, payload: bytes, first) -> bytes:
    """One record; ``first`` is the id of the response that it revisits, or None."""
    block = HTTP if first is not None else HTTP + payload
    head = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", _urn(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else "".join(c for c in url if c not in "\r\n")),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Profile", None if first is None else PROFILE),
        ("WARC-Refers-To", None if first is None else _urn(first)),
        ("Page-Id", page),
        ("Page-Refers-To", first),
        ("Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def package(records: list[bytes]) -> bytes:
    place, lines = 0, []
    for r in records:
        lines.append(json.dumps({"offset": place, "length": len(r)}))
        place += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(ARCHIVE), b"".join(records))
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
    return out.getvalue()


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(root)
        waiting: list[bytes] = []
        size = 0

        def put() -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.zip"
            where.create_dir(folder, recursive=True)
            with where.open_output_stream(name) as file:
                file.write(package(waiting))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{root}/{name.rsplit('/', 1)[1]}"]), pa.array([len(waiting)], pa.int64())], ["path", "records"]
            )

        for batch in batches:
            pages, firsts = batch.column("id").to_pylist(), batch.column("first").to_pylist()
            for page, first, url, payload in zip(pages, firsts, batch.column("url").to_pylist(), batch.column("payload")):
                waiting.append(record(page, url, payload.as_py(), first))
                size += len(waiting[-1])
                if size >= PACKAGE_BYTES:
                    yield put()
                    waiting, size = [], 0
        if waiting:
            yield put()

    return run


def write_packages(
    pages: DataFrame, root: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0
) -> DataFrame:
    """Writes a record per row; returns the finished packages, ``path, records``.
    Payloads of fewer than ``least`` bytes are never revisited."""
    root = root or staging_path(pages.sparkSession, "packages")
    root = root if "://" in root or root.startswith("/") else root.replace(":", "://", 1)
    payload = F.coalesce(F.col(quoted(html)), F.lit("")).cast("binary")
    base = pages.select(F.col(quoted(key)).alias("id"), F.col(quoted(url)).alias("url"), payload.alias("payload"))
    base = base.withColumn("sha", F.unhex(F.sha1("payload")))
    twice = (
        base.filter(F.length("payload") >= least)
        .groupBy("sha")
        .agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    marked = base.join(materialize(twice, "warc-equal"), "sha", "left")
    first = F.when(F.col("least_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("least_id")), F.col("least_id"))
    rows = marked.select("id", "url", "payload", first.alias("first"))
    return materialize(rows.mapInArrow(_writer(root), "path string, records bigint"), "warc-packages")


def _uint(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


def members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """``name: (offset of the local header, bytes, compression)`` from the central directory."""

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, size - 22 - 0xFFFF)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = _uint(tail, end + 10, 2), _uint(tail, end + 12, 4), _uint(tail, end + 16, 4)
    if count == 0xFFFF or ZIP64 in (length, start):
        place = tail_at + end - 20
        locator = at(place, 20) if place >= 0 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("a ZIP64 file without locator")
        big = at(_uint(locator, 8, 8), 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("a ZIP64 locator that points nowhere")
        count, length, start = _uint(big, 32, 8), _uint(big, 40, 8), _uint(big, 48, 8)
    directory, p, out = at(start, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, packed, plain = _uint(directory, p + 10, 2), _uint(directory, p + 20, 4), _uint(directory, p + 24, 4)
        names, extras, comment = struct.unpack_from("<HHH", directory, p + 28)
        offset = _uint(directory, p + 42, 4)
        name = directory[p + 46 : p + 46 + names].decode("utf-8", "replace")
        extra, q = directory[p + 46 + names : p + 46 + names + extras], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # only what overflowed is there, in this order
                r = q + 4
                for which in ("plain", "packed", "offset"):
                    value = {"plain": plain, "packed": packed, "offset": offset}[which]
                    if value == ZIP64:
                        value, r = _uint(extra, r, 8), r + 8
                    if which == "plain":
                        plain = value
                    elif which == "packed":
                        packed = value
                    else:
                        offset = value
            q += 4 + n
        out[name] = (offset, packed, method)
        p += 46 + names + extras + comment
    return out


def data_start(file, offset: int) -> int:
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("a broken local header")
    return offset + 30 + _uint(head, 26, 2) + _uint(head, 28, 2)


def ranges_of(file, size: int) -> list[tuple[int, int]]:
    """Stretches of whole records of the stored archive members."""
    found = members(file, size)
    archives = [n for n in found if n.endswith((".warc.gz", ".warc"))]
    for n in archives:
        if found[n][2] != 0:
            raise ValueError(f"{n} is compressed in the package, its records can't be located")
    out: list[tuple[int, int]] = []
    index = found.get(INDEX) if ARCHIVE in archives and found.get(INDEX, (0, 0, 1))[2] == 0 else None
    for n in archives:
        start, length = data_start(file, found[n][0]), found[n][1]
        if n == ARCHIVE and index:
            file.seek(data_start(file, index[0]))
            begin = end = 0
            for line in file.read(index[1]).splitlines():
                entry = json.loads(line)
                if end > begin and (entry["offset"] != end or end - begin >= RANGE_BYTES):
                    out.append((start + begin, end - begin))
                    begin = entry["offset"]
                elif end == begin:
                    begin = entry["offset"]
                end = entry["offset"] + entry["length"]
            if end > begin:
                out.append((start + begin, end - begin))
        elif length:
            out.append((start, length))
    return out


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            where, name = fs.FileSystem.from_uri(path)
            with where.open_input_file(name) as file:
                found = ranges_of(file, file.size())
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                ["path", "offset", "length"],
            )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a stretch of records, plain or gzipped one by one."""
    while data:
        if data[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            plain = unpack.decompress(data) + unpack.flush()
            if not unpack.eof:
                raise ValueError("a record is cut off")
            data = unpack.unused_data
            rest = None
        else:
            plain, rest = data, True
        while plain:
            end = plain.index(b"\r\n\r\n")
            lines = plain[:end].decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(headers["content-length"])
            yield headers, plain[end + 4 : end + 4 + length]
            plain = plain[end + 8 + length :]
        if rest:
            return


RECORD = "page_id {kind}, target string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}"


def _reader(kind: str):
    number = kind in ("tinyint", "smallint", "int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as file:
                    file.seek(offset)
                    data = file.read(length)
                rows = [_row(h, b, number) for h, b in parse(data) if h.get("warc-type") in ("response", "revisit")]
                for i in range(0, len(rows), 1000):
                    columns = list(zip(*rows[i : i + 1000]))
                    types = [pa.int64() if number else pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64() if number else pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types)], ["page_id", "target", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    )

    return run


def _row(headers: dict[str, str], block: bytes, number: bool) -> tuple:
    response = headers["warc-type"] == "response"
    payload = block.partition(b"\r\n\r\n")[2] if response else None
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if response and stated and digest(payload) != stated:
        raise ValueError(f"a payload is damaged: {headers.get('warc-record-id')}")
    own, first = headers.get("page-id"), headers.get("page-refers-to")
    return (
        int(own) if number and own is not None else own,
        headers.get("warc-target-uri"),
        payload,
        len(payload) if response else int(headers["payload-length"]) if "payload-length" in headers else None,
        digest(payload) if response else stated or None,
        headers["warc-type"],
        int(first) if number and first is not None else first,
    )


def read_packages(packages: DataFrame, kind: str = "bigint") -> DataFrame:
    """One row per response or revisit record of the packages in column ``path``."""
    paths = packages.select("path")
    located = paths.repartition(max(1, math.ceil(packages.count() / LOCATED_PACKAGES)))
    ranges = materialize(located.mapInArrow(_locate, "path string, offset bigint, length bigint"), "warc-ranges")
    total = ranges.agg(F.sum("length")).first()[0] or 0
    # a range is a few bytes here and megabytes in the archive: the number of tasks follows the latter
    dealt = ranges.repartition(max(1, math.ceil(total / TASK_BYTES)))
    wide = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    return dealt.mapInArrow(_reader(kind), RECORD.format(kind=wide))


ship(__name__)
