import base64
import hashlib
import io
import struct
import zipfile

import pytest

from gridweave.llm import queries
from gridweave.llm import zip_warc as zw

ROWS = [(1, "http://a/ b\r\n%", "<p>é</p>", "x"), (2, None, None, "x"), (3, "http://c", "", None), (4, "u", "<p>é</p>", "x"), (4, "u", "<p>é</p>", "x"),
        (None, "v", "<p>é</p>", "x"), (5, "w", "long " * 300_000, "x"), (6, "q", "WARC/1.1\r\n\r\n\r\n\r\nPK\x05\x06", "x"), (None, "n", "only without id", "x")]


def want(rows, least=0):
    top = {}
    for i, _, t, _ in rows:
        b = (t or "").encode()
        if len(b) >= least and i is not None:
            top[b] = max(i, top.get(b, i))
    out = []
    for i, _, t, _ in rows:
        b = (t or "").encode()
        to = top.get(b)
        again = to is not None and to != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, tmp_path, least, monkeypatch):
    monkeypatch.setattr(zw, "RANGE_BYTES", 400)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string").repartition(2)
    back = zw.read(spark, zw.write(zw.typed(pages, least), f"file://{tmp_path}/a"))
    assert back.rdd.getNumPartitions() >= len(list(tmp_path.glob("a/*.zip")))  # an archive is a task's work, or several tasks'
    got = back.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS, least)
    text = {(i, t or "") for i, _, t, _ in ROWS}
    assert {(r.page_id, r.payload.decode()) for r in got if r.record_type == "response"} <= text
    assert {r.url for r in got} == {u for _, u, _, _ in ROWS}
    for p in tmp_path.glob("a/*.zip"):  # any ZIP tool can open them
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None and z.namelist() == [zw.DATA, zw.INDEX]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert zw.read(spark, zw.write(zw.typed(pages), f"file://{tmp_path}/a")).collect() == []


def test_zip64_directory():
    """Sizes and places beyond 32 bits come from the ZIP64 records."""
    name, far = b"big", 5 << 32
    extra = struct.pack("<HHQQQ", 1, 24, far, far, 7)
    local = b"PK\x03\x04" + b"\0" * 22 + struct.pack("<HH", 3, 0) + name
    entry = b"PK\x01\x02" + b"\0" * 6 + struct.pack("<H", 0) + b"\0" * 8 + struct.pack("<IIHHH", 2**32 - 1, 2**32 - 1, 3, len(extra), 0) + b"\0" * 8 + struct.pack("<I", 2**32 - 1) + name + extra
    start = 7 + len(local)
    end64 = b"PK\x06\x06" + b"\0" * 20 + struct.pack("<QQQQ", 1, 1, len(entry), start)
    tail = b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(entry), 1) + b"PK\x05\x06" + b"\xff" * 16 + struct.pack("<H", 4) + b"note"
    data = b"\0" * 7 + local + entry + end64 + tail
    assert zw.directory(io.BytesIO(data), len(data)) == [{"name": "big", "stored": True, "start": 7 + len(local), "length": far}]


def test_without_index_and_broken(tmp_path):
    body = zw.record(9, None, b"abc", "response", None)
    import gzip
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(zw.DATA, gzip.compress(body) * 2)
    (path, start, n), = zw.ranges(f"file://{tmp_path}/a.zip")
    assert [zw.parsed(r)["page_id"] for r in zw.records(path, start, n)] == [9, 9]
    with pytest.raises(ValueError):
        zw.parsed(body.replace(b"abc", b"abd"))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.url, r.html, None) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op4_zip_warc"](spark, sf).collect()), key=str) == want(pages)
