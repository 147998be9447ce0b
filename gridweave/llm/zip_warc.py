"""WARC records inside ZIP archives, written and range-read by many tasks.

An archive holds two stored members: ``archive/data.warc.gz`` (one gzip member
per record) and ``indexes/index.cdxj`` (one line per record: place, length).
The reader parses the end record, the ZIP64 locator and the central directory,
finds the members and the index, and reads ranges of records where they lie;
nothing is extracted.

Archives go to a folder that driver and executors share, through the file
system named by its URI.  A task writes under a name of its own and lists the
file in the manifest, a written table; files of lost attempts are in no
manifest and are never read.

Defined results: a null payload is empty; rows without an id are written and
read back without one; of equal payloads of at least ``least`` bytes all rows
with the largest id are responses (also when repeated), the others revisit it,
and rows of a payload that no id has are all responses; an empty table makes no
archive; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.session import cut

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of compressed records in one archive, and in one range that a task reads.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
#: Repeated payloads up to which their table is sent to every executor.
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Signatures and lengths of the ZIP format.
END, END64, PLACE64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
RECORDS = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def typed(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``(page_id, url, body, record_type, refers_to)``; only digests of repeated payloads are gathered."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body")).withColumn("_sha", F.sha1("body"))
    again = cut(rows.where(F.length("body") >= least).groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(again, "_sha", "left").select(
        "page_id", "url", "body", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    return None if name is None or name == "<urn:x-page:none>" else int(name[len("<urn:x-page:"):-1])


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(page_id, url, body: bytes, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head of its payload only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + (body if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(body)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(2, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The columns of one record; a response's digest is that of the bytes read and has to be the stated one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and digest(body) != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and size != len(body):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is cut short")
    url = fields.get("WARC-Target-URI")
    return {"page_id": _id(fields["WARC-Record-ID"]), "url": url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url) if url else url,
            "record_type": kind, "payload": body if kind == "response" else None, "payload_bytes": size,
            "payload_digest": stated, "refers_to": _id(fields.get("WARC-Refers-To"))}


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of ``typed`` rows below a shared folder; returns the manifest ``(path, records)``."""
    def run(parts):
        import pyarrow as pa

        def archives() -> Iterator[tuple[str, int]]:
            todo = (tuple(r.values()) for p in parts for i in range(0, p.num_rows, 100) for r in p.slice(i, 100).to_pylist())
            row = next(todo, None)
            while row is not None:
                path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
                system, place = _open(path)
                lines, at = [], 0
                with system.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                    with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                        while row is not None and at < ARCHIVE_BYTES:
                            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                            packed = packer.compress(record(*row)) + packer.flush()
                            member.write(packed)
                            lines.append(json.dumps({"offset": at, "length": len(packed)}))
                            at += len(packed)
                            row = next(todo, None)
                    with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                        member.write("".join(f"{line}\n" for line in lines).encode())
                yield path, len(lines)

        for path, n in archives():
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    system, place = _open(folder)
    system.create_dir(place, recursive=True)
    return cut(rows.select("page_id", "url", "body", "record_type", "refers_to").mapInArrow(run, "path string, records bigint"))


def directory(file, size: int) -> list[dict]:
    """Entries of the central directory of a ZIP file, ZIP64 or not, by range reads."""
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    place = tail_at + end - 20
    if place >= 0 and (hint := read(place, 20))[:4] == PLACE64:
        head = read(struct.unpack("<Q", hint[8:16])[0], 56)
        if head[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", head[32:56])
    data, at, out = read(start, length), 0, []
    for _ in range(count):
        if data[at:at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", data[at + 10:at + 12])
        packed, plain, name_n, extra_n, note_n = struct.unpack("<IIHHH", data[at + 20:at + 34])
        local, = struct.unpack("<I", data[at + 42:at + 46])
        name = data[at + 46:at + 46 + name_n].decode()
        extra = data[at + 46 + name_n:at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: those of the three that did not fit, in this order
                wide = [struct.unpack("<Q", extra[4 + i:12 + i])[0] for i in range(0, n - 7, 8)]
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n:]
        head = read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        begin = local + 30 + sum(struct.unpack("<HH", head[26:30]))
        out.append({"name": name, "stored": method == 0, "start": begin, "length": packed})
        at += 46 + name_n + extra_n + note_n
    return out


def ranges(path: str) -> list[tuple[str, int, int]]:
    """Ranges of whole records of one archive; one range for an archive without an index."""
    system, place = _open(path)
    with system.open_input_file(place) as f:
        entries = {e["name"]: e for e in directory(f, f.size())}
        data = entries.get(DATA)
        if data is None or not data["stored"]:
            raise ValueError(f"{path} has no stored member {DATA}")
        index = entries.get(INDEX)
        if index is None:
            return [(path, data["start"], data["length"])]
        if not index["stored"]:
            raise ValueError(f"the index of {path} is compressed")
        f.seek(index["start"])
        lines = [json.loads(x) for x in f.read(index["length"]).decode().splitlines()]
    out: list[tuple[str, int, int]] = []
    for x in lines:
        at = data["start"] + x["offset"]
        if out and out[-1][1] + out[-1][2] == at and out[-1][2] + x["length"] <= RANGE_BYTES:
            out[-1] = (path, out[-1][1], out[-1][2] + x["length"])
        else:
            out.append((path, at, x["length"]))
    return out


def records(path: str, start: int, length: int) -> Iterator[bytes]:
    """The records of one range, unpacked one by one."""
    system, place = _open(path)
    with system.open_input_file(place) as f:
        f.seek(start)
        left, data = length, b""
        unpack = zlib.decompressobj(31)
        out: list[bytes] = []
        while left or data:
            if not data:
                data = f.read(min(left, 1 << 20))
                if not data:
                    raise ValueError(f"{path} ends early")
                left -= len(data)
            out.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                yield b"".join(out)
                data, out, unpack = unpack.unused_data, [], zlib.decompressobj(31)


#: Bytes of archives that a reading task takes.
TASK_BYTES = 32 << 20


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Records of the archives of a manifest's ``path`` column."""
    def places(parts):
        import pandas as pd

        for p in parts:
            for path in p["path"]:
                yield pd.DataFrame(ranges(path), columns=["path", "start", "length"])

    def run(parts):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in parts:
            for r in batch.to_pylist():
                some, size = [], 0
                for raw in records(r["path"], r["start"], r["length"]):
                    some.append(parsed(raw))
                    size += len(raw)
                    if size > RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    # Explicit numbers of tasks: the rows are few and small, but each stands for an archive or a range of one.
    paths = manifest.select("path").distinct()
    found = cut(paths.repartition(max(1, paths.count()), "path").mapInPandas(places, "path string, start bigint, length bigint"))
    size = found.agg(F.sum("length").alias("bytes"), F.count("*").alias("ranges"), F.countDistinct("path").alias("paths")).first()
    tasks = max(1, min(size.ranges, max(2 * size.paths, (size.bytes or 0) // TASK_BYTES)))
    return found.repartition(tasks, "path", "start").mapInArrow(run, RECORDS)
