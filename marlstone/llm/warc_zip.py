"""WARC archives packaged in ZIP: a writer, and a reader that fetches records by range.

An archive is a ZIP that holds WARC files (``archive/*.warc`` or ``.warc.gz``, a gzip member a
record) as stored members and, beside them, indexes (``indexes/*.cdx``, ``.cdxj``, either may be
gzipped): lines ``key timestamp {"filename": ..., "offset": ..., "length": ...}``.  The reader takes
the end of the file, the central directory (and the ZIP64 records where sizes or counts need them),
the indexes, and then each record's bytes: nothing is extracted.  Where the indexes don't cover a
WARC member to its last byte, the member is walked record by record instead, so none is passed over.

Files are opened with ``pyarrow.fs`` by URI, so any store that it knows will do.  Each task writes
archives of its own under new names and reports them; only those of tasks that ended well are in the
manifest, so tasks may be lost and run again (what a lost task wrote stays in the folder, unread).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_split, new_path, parallelism, tidy, write_table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of records after which a task starts another archive.
ARCHIVE_BYTES = 32_000_000
_M16, _M32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; with ``zip64``, or where a number needs it, ZIP64 records are written."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, size, at = name.encode(), zlib.crc32(data), len(data), len(out)
        wide = zip64 or size >= _M32 or at >= _M32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = _M32 if wide else size
        out += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, _M32 if wide else at) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or n >= _M16 or at >= _M32:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
        out += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, _M16, _M16, _M32, _M32, 0)
    else:
        out += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, len(central), at, 0)
    return bytes(out)


class StoredZip:
    """Members of a ZIP by range: ``fetch(offset, size)`` reads bytes of a file of ``size`` bytes.

    ``members`` are the stored ones, which ranges are read of; ``deflated`` can be read as wholes alone.
    """

    def __init__(self, fetch, size: int) -> None:
        self.fetch = fetch
        tail_at = max(0, size - _M16 - 22 - 20)
        tail = fetch(tail_at, size - tail_at)
        # The record whose comment ends the file: a comment may hold the signature too.
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        _, _, _, _, n, length, at, _ = struct.unpack_from("<4sHHHHIIH", tail, end)
        if (n == _M16 or length == _M32 or at == _M32) and end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            where = struct.unpack_from("<Q", tail, end - 12)[0]
            record = fetch(where, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record is missing")
            n, length, at = struct.unpack_from("<Q8xQQ", record, 24)[0], *struct.unpack_from("<QQ", record, 40)
        self.members: dict[str, tuple[int, int]] = {}  # name -> (local header, size)
        self.deflated: dict[str, tuple[int, int]] = {}
        raw, p = fetch(at, length), 0
        for _ in range(n):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("central directory is damaged")
            method = struct.unpack_from("<H", raw, p + 10)[0]
            packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, p + 20)
            header = struct.unpack_from("<I", raw, p + 42)[0]
            name = raw[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
            q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
            while q + 4 <= stop:
                tag, k = struct.unpack_from("<HH", raw, q)
                if tag == 1:  # ZIP64: those of the three that did not fit, in this order
                    r = q + 4
                    if plain == _M32:
                        plain, r = struct.unpack_from("<Q", raw, r)[0], r + 8
                    if packed == _M32:
                        packed, r = struct.unpack_from("<Q", raw, r)[0], r + 8
                    if header == _M32:
                        header = struct.unpack_from("<Q", raw, r)[0]
                q += 4 + k
            if method == 0:
                self.members[name] = (header, plain)
            elif method == 8:
                self.deflated[name] = (header, packed)
            p = stop + n_note

    def start(self, name: str) -> int:
        """Where the member's bytes start; local headers may differ in length from central ones."""
        header = (self.members.get(name) or self.deflated[name])[0]
        local = self.fetch(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: local header is missing")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        if name in self.deflated:
            if at or size is not None:
                raise ValueError(f"{name}: is deflated, no ranges of it can be read")
            return zlib.decompress(self.fetch(self.start(name), self.deflated[name][1]), -15)
        whole = self.members[name][1]
        size = whole - at if size is None else size
        if at < 0 or size < 0 or at + size > whole:
            raise ValueError(f"{name}: no such range")
        return self.fetch(self.start(name) + at, size)


def _walk(read, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, record) of a WARC file, plain or of gzip members, without an index; ``read(at, n)`` reads it."""
    step, at = 1 << 20, 0
    while at < size:
        if read(at, min(2, size - at)) == b"\x1f\x8b":
            unpack, parts, p = zlib.decompressobj(31), [], at
            while not unpack.eof:
                if p >= size:
                    raise ValueError(f"record at {at} is cut off")
                data = read(p, min(step, size - p))
                parts.append(unpack.decompress(data))
                p += len(data)
            yield at, b"".join(parts)
            at = p - len(unpack.unused_data)
            continue
        head, lead = b"", 0
        while head.find(b"\r\n\r\n", lead) < 0:
            if at + len(head) >= size:
                if lead == len(head):
                    return
                raise ValueError(f"record at {at} is cut off")
            head += read(at + len(head), min(4096, size - at - len(head)))
            lead = len(head) - len(head.lstrip(b"\r\n"))
        start = head.index(b"\r\n\r\n", lead) + 4
        found = re.search(rb"(?im)^content-length:\s*(\d+)", head[:start])
        if not found or at + start + int(found[1]) > size:
            raise ValueError(f"record at {at} is cut off")
        n = start - lead + int(found[1])
        yield at + lead, read(at + lead, n)
        at += lead + n


def records(archive: StoredZip) -> Iterator[tuple[str, int, bytes]]:
    """(member, place in it, record) of all WARC members, by the indexes where they cover a member."""
    names = [*archive.members, *archive.deflated]
    wanted = [x for x in names if re.search(r"(^|/)archive/.+\.warc(\.gz)?$", x)] or [x for x in names if re.search(r"\.warc(\.gz)?$", x)]
    places: dict[str, dict[int, int]] = {}
    for name in names:
        if not re.search(r"(^|/)indexes/.+\.cdxj?(\.gz)?$", name):
            continue
        raw = archive.read(name)
        while raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        for line in raw.decode("utf-8", "replace").splitlines():
            at = line.find("{")
            if at < 0:
                continue
            entry = json.loads(line[at:])
            if {"filename", "offset", "length"} <= entry.keys():
                places.setdefault(entry["filename"].rpartition("/")[2], {})[int(entry["offset"])] = int(entry["length"])
    for name in wanted:
        if name in archive.deflated:
            raise ValueError(f"{name}: is deflated, its records can't be read by range")
        base, size = archive.start(name), archive.members[name][1]
        found, end = sorted(places.get(name.rpartition("/")[2], {}).items()), 0
        for at, n in found:
            end = at + n if at == end else -1
        if end == size:
            for at, n in found:
                raw = archive.fetch(base + at, n)
                yield name, at, gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        else:
            for at, raw in _walk(lambda p, n, base=base: archive.fetch(base + p, n), size):
                yield name, at, raw


def record(kind: str, page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has the HTTP head, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record; names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda x: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in x.decode("utf-8", "surrogateescape").split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if not block.startswith(b"HTTP/"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest (path, records).

    Of pages with equal payloads of at least ``least_bytes`` bytes that with the largest page_id is a
    response and the others revisit it; smaller payloads are all responses.  Defined cases: a null
    html or url is empty; repeated rows of the largest page_id are responses each; a page with a null
    page_id is a revisit of its payload's largest page_id, or a response if all are null.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    pages = pages.withColumn("sha", F.sha1("payload"))
    chosen = pages.where(F.length("payload") >= least_bytes).groupBy(F.col("sha").alias("s")).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    chosen = write_table(chosen, "warc-repeats")
    pages = pages.withColumn("sha", F.when(F.length("payload") >= least_bytes, F.col("sha")))
    total = chosen.agg(F.sum("n")).first()[0] or 0
    rows = join_split(pages, "sha", chosen, "s", "n", total, F.xxhash64("url", "page_id")).select("page_id", "url", "payload", "largest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def close(data: list, index: list) -> pa.RecordBatch:
            raw = zip_stored([(DATA, b"".join(data)), (INDEX, "\n".join(index).encode())])
            path = f"{folder}/{uuid.uuid4().hex}.zip"
            store, at = _open(path)
            if getattr(store, "type_name", "") == "local":
                store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as out:
                out.write(raw)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], names=["path", "records"])

        data, index, at = [], [], 0
        for batch in batches:
            for page_id, url, payload, largest in zip(*(batch.column(i) for i in range(4)), strict=True):
                page_id, largest = page_id.as_py(), largest.as_py()
                first = largest is None or largest == page_id
                body = gzip.compress(record("response" if first else "revisit", "" if page_id is None else page_id, url.as_py(), payload.as_py(), None if first else largest), 1)
                data.append(body)
                url = url.as_py().replace("\r", "%0D").replace("\n", "%0A")
                entry = {"url": url, "filename": DATA.rpartition("/")[2], "offset": str(at), "length": str(len(body))}
                index.append(f"{url.replace(' ', '%20')} 19700101000000 {json.dumps(entry)}")
                at += len(body)
                if at >= ARCHIVE_BYTES:
                    yield close(data, index)
                    data, index, at = [], [], 0
        if index:
            yield close(data, index)

    return write_table(rows.mapInArrow(tidy(run), "path string, records bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record_id, refers_to_id, path,
    member, at): every record of the archives of ``manifest`` (path).

    ``payload_bytes`` and ``payload_digest`` are of the full payload; a response's are computed, and must agree
    with its SHA-1 field if it has one; a revisit's are what its fields say.  ``payload`` is null for revisits,
    and without ``payloads``.  page_id and refers_to are null for records that this writer didn't name;
    record_id and refers_to_id are the records' own names.  A damaged record raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "record_id", "refers_to_id", "path", "member", "at"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        mine = re.compile(r"<urn:page:(-?\d+)>").fullmatch
        number = lambda x: int(found[1]) if x and (found := mine(x)) else None
        whole = lambda x: x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if x is not None else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _open(path)
                with store.open_input_file(at) as f:
                    archive = StoredZip(lambda o, n, f=f: f.read_at(n, o), f.size())
                    rows, size = [], 0
                    for member, o, raw in records(archive):
                        warc, http, payload = parse(raw)
                        kind, told = warc.get("warc-type"), warc.get("warc-payload-digest", "")
                        if kind == "revisit":
                            total = int(http["content-length"]) if "content-length" in http else None
                            sha = told.removeprefix("sha1:") or None
                        else:
                            total, sha = len(payload), digest(payload)
                            if kind == "response" and told.startswith("sha1:") and "transfer-encoding" not in http and told[5:].upper() != sha:
                                raise ValueError(f"{path}: {member}: record at {o} is damaged")
                        ids = [whole(warc.get(k)) for k in ("warc-record-id", "warc-refers-to")]
                        rows.append((number(ids[0]), whole(warc.get("warc-target-uri")), kind, number(ids[1]), total, sha, payload if payloads and kind != "revisit" else None, *ids, path, member, o))
                        size += len(payload) if payloads else 200
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, record_id string, refers_to_id string, path string, member string, at bigint"
    return manifest.select("path").repartition(parallelism(manifest.sparkSession)).mapInArrow(tidy(run), schema)


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
