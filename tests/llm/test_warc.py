import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from vecspark.llm import warc
from vecspark.llm.queries import QUERIES


def expected(rows, min_bytes=0):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        if i is not None and len(b) >= min_bytes:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, b in data:
        revisit = len(b) >= min_bytes and b in first and first[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


def got(df, key="page_id"):
    return sorted(((r[key], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_query(spark, sf_dir):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert got(QUERIES["op7_warc"](spark, sf_dir)) == expected(rows)


def test_edges(spark):
    pages = [(1, "u1", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "http://x/ y\n", ""), (4, "u", None), (5, "u", "é😀\r\n\r\nWARC/1.1\r\n"), (5, "u", "é😀\r\n\r\nWARC/1.1\r\n"), (6, "u", "z" * 3_000_000), (0, "u", "z" * 3_000_000), (None, "u", "<p>a</p>"), (None, None, None), (7, "u", "\x00\x1a\n")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, payload string, original int")
    rows = [(p[0], p[2]) for p in pages]
    assert got(warc.archive(df), "record_id") == expected(rows)
    assert got(warc.archive(df, min_bytes=10), "record_id") == expected(rows, 10)
    assert warc.archive(df.limit(0)).count() == 0


def test_archives_hold_the_payloads_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "body " * 50 + str(i % 3)) for i in range(30)], "page_id long, url string, html string")
    warc.write(warc.resolve(warc.records(df)), f"file://{tmp_path}/w", per_file=7)
    files = list(Path(tmp_path, "w").glob("*.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert len(files) > 1 and text.count(b"WARC-Type: response") == 3 and text.count(b"WARC-Type: revisit") == 27 and text.count(b"body body") == 3 * 25
    back = {r["record_id"]: r for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    assert {i for i, r in back.items() if r["payload"] is not None} == {0, 1, 2}
    assert all(bytes(back[i]["payload"]).decode() == "body " * 50 + str(i) for i in range(3)) and back[29]["refers_to"] == 2 and back[29]["url"] == "http://h/29"
    # a corrupt payload does not pass
    one = next(f for f in files if b"WARC-Type: response" in gzip.decompress(f.read_bytes()))
    bad = gzip.compress(gzip.decompress(one.read_bytes()).replace(b"body body", b"bodx body"))
    with pytest.raises(ValueError, match="not the one of its digest"):
        list(warc.parse(bad))
