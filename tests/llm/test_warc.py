import base64
import hashlib
import time

import pytest

from tidegrid.llm import warc
from tidegrid.llm.common import scratch

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
TEXTS = [
    None, "", "<p>x</p>", "<p>x</p>", "é𝄞", "a\r\n\r\nb", "WARC/1.", "WARC/1.0\r\n", FAKE, FAKE * 3 + "tail", "before " + FAKE, FAKE,
    "x" * 200_000, "\r\n\r\n", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", "WARC/1.1WARC/1.1\r\n\r\nWARC/1.", "\r\n", " ",
]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def want(rows, least):
    out = []
    for i, t in rows:
        b = (t or "").encode()
        same = max(j for j, u in rows if (u or "") == (t or ""))
        ref = same if len(b) >= least and same != i else None
        out.append((i, len(b), digest(t), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    assert all(r.intact for r in rows)
    return sorted(((int(r.id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in rows), key=str)


@pytest.mark.parametrize(("least", "bound"), [(0, 1000), (0, 0), (4, 1000)])
def test_round_trip(spark, least, bound):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, f"http://h/{i} \r\nX: y", t, "z") for i, t in rows], "page_id long, url string, html string, digest string")
    assert got(warc.round_trip(df, least=least, bound=bound)) == want(rows, least)


def test_small_splits_and_files(spark):
    rows = list(enumerate(TEXTS * 3))
    df = spark.createDataFrame([(i, None, t) for i, t in rows], "page_id long, url string, html string").repartition(2)
    path = scratch(spark, "warc-test")
    warc.write(df, path, records_per_file=20)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert got(warc.read(spark, path)) == want(rows, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_payload_of_very_many_magic_strings(spark):
    """In time that grows with the payload, over splits of the file as well."""
    rows = [(1, "a"), (2, "WARC/1." * 300_000), (3, "x" + FAKE * 20_000), (4, "b")]
    df = spark.createDataFrame([(i, None, t) for i, t in rows], "page_id long, url string, html string").coalesce(1)
    path = scratch(spark, "warc-test")
    warc.write(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        start = time.time()
        assert got(warc.read(spark, path)) == want(rows, 0)
        assert time.time() - start < 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_archive_is_a_chain_of_records(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://h/", t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write(df, path, date="2001-02-03T04:05:06Z")
    raw = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("w/part-*")))
    at, n = 0, 0
    while at < len(raw):
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: re") and b"\r\nWARC-Date: 2001-02-03T04:05:06Z\r\n" in head
        size = int(head.rpartition(b"Content-Length: ")[2])
        at += len(head) + 4 + size
        assert raw[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(TEXTS)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0
