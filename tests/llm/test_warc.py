"""Archives: exact round trips, and faults for what is broken."""

import hashlib

import pytest
from pyspark.sql import functions as F

from runloom.llm import warc

SCHEMA = "page_id BIGINT, url STRING, html STRING"


def pages():
    long_ = "<p>é€😀 text</p>\r\n" * 3000
    return [(1, "http://a/1", long_), (2, "http://a/2", long_), (3, "http://a/3", "short"),
            (4, "http://a/4", "short"), (5, None, None), (6, "http://a/6", ""),
            (7, "http://a/7", "WARC/1.1\r\n\r\n0\r\n\r\n" * 20), (8, "http://a/8\nx", "y" * 100),
            (0, "http://a/0", "y" * 100), (9, "u", "z" * 99), (10, "u", "z" * 99)]


@pytest.mark.parametrize("segment", [16 << 10, 64])
def test_round_trip(frame, few, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(warc, "SEGMENT", segment)
    monkeypatch.setattr(warc, "CHUNK", 7 if segment < 100 else 4096)
    rows = pages()
    path = str(tmp_path / "archives")
    warc.write_archives(frame(rows, SCHEMA), path)
    spark = frame(rows, SCHEMA).sparkSession
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, html in sorted(rows):
        data = (html or "").encode()
        if len(data) >= 100:
            first.setdefault(data, i)
    for i, _, html in rows:
        data = (html or "").encode()
        origin = first.get(data, i)
        r = got[i]
        assert r.fault is None
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (
            ("revisit", origin) if origin != i else ("response", None))
    payloads = {int(r.page): r.payload for r in warc.reassemble(
        warc.read_records(spark, path)).collect()}
    assert bytes(payloads[1]) == rows[0][2].encode()
    records = warc.read_records(spark, path)
    assert records.where("type = 'continuation'").count() > 0


def test_segments_of_records():
    payload = "é".encode() * 30_000
    data = warc.page_records("u", 1, payload, "d", None, False, (0, 0))
    records = list(warc.parse_archive(data))
    assert [h.get("warc-segment-number") for _, h, _ in records] == [
        str(i + 1) for i in range(len(records))]
    assert len(records) > 3 and "warc-segment-total-length" in records[-1][1]
    for _, _, block in records:
        block.decode()  # no piece ends inside a character
    assert warc.http_payload(b"".join(b for _, _, b in records)) == payload
    with pytest.raises(ValueError):
        list(warc.parse_archive(data[:-7]))


def test_chunk_framing():
    assert warc.decode_chunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc", b"3\r\nabcX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.decode_chunked(bad)


def test_broken_segments_have_faults(frame, few, tmp_path):
    rows = [(1, "u", "x" * 60_000), (2, "v", "y" * 60_000), (3, "w", "z" * 60_000)]
    path = str(tmp_path / "archives")
    warc.write_archives(frame(rows, SCHEMA), path)
    spark = frame(rows, SCHEMA).sparkSession
    records = warc.read_records(spark, path)
    origin = {r.page: r.record_id for r in records.where("page is not null").collect()}
    broken = records.where(
        ~((F.col("origin") == origin["1"]) & (F.col("segment") == 2))
        & (F.coalesce(F.col("record_id") != origin["2"], F.lit(True))))
    got = {r.record_id: r for r in warc.reassemble(broken).collect()}
    assert got[origin["1"]].fault == "segments are missing"
    assert got[origin["2"]].fault == "segments are missing"
    assert got[origin["3"]].fault is None and len(got[origin["3"]].payload) == 60_000
    short = records.withColumn("total", F.when(F.col("origin") == origin["1"], F.col("total") + 1)
                               .otherwise(F.col("total")))
    got = {r.record_id: r for r in warc.reassemble(short).collect()}
    assert got[origin["1"]].fault == "length is not the declared total"


def test_repeated_rows_and_no_rows(frame, few, tmp_path):
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "u", "x" * 200), (None, "u", "x" * 200)]
    path = str(tmp_path / "archives")
    warc.write_archives(frame(rows, SCHEMA), path)
    spark = frame(rows, SCHEMA).sparkSession
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0)
                 for r in warc.read_archives(spark, path).collect())
    assert got == [(0, "response", 0), (1, "response", 0), (1, "response", 0), (2, "revisit", 1)]
    empty = str(tmp_path / "empty")
    warc.write_archives(frame([], SCHEMA), empty)
    assert warc.read_archives(spark, empty).count() == 0
