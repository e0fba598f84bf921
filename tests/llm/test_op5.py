import base64
import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from gradelake.llm import warc

SF = "/root/testdata/sf0.001"


def expected(rows, min_bytes):
    out, best = [], {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        big = best.get(h or "")
        refers = big if len(raw) >= min_bytes and big is not None and big != i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in df.collect()), key=str)


def test_round_trip(spark, monkeypatch):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "<p>é</p>"), (None, "v", "only null"), (None, "v", "only null"), (9, "big", "x\r\n\r\nWARC/1.1\r\n" * 200_000), (-5, "neg", "n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, name string").repartition(3)
    for least in (0, 5):
        assert rows_of(warc.archive(df, least)) == expected(rows, least)
    monkeypatch.setattr(warc, "SMALL", 0)
    assert rows_of(warc.archive(df)) == expected(rows, 0)
    assert warc.archive(df.limit(0)).count() == 0


def test_table(spark):
    rows = duckdb.connect().execute(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert rows_of(warc.op5_warc_normaliser(spark, SF)) == expected(rows, 0)


def test_streams_of_one_member_or_many():
    raw = [warc.record(i, f"u{i}", b"p" * i * 1000, 3 if i == 2 else None) for i in range(5)]
    one, many = gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))
    for data in (one, many):
        assert list(warc.records(warc.inflate(io.BytesIO(data)))) == raw


def test_streams_that_break_off_or_go_on():
    raw = [warc.record(i, f"u{i}", b"p" * 999, None) for i in range(3)]
    whole = gzip.compress(b"".join(raw))
    cut_at_a_record = zlib.compressobj(1, zlib.DEFLATED, 31)
    part = cut_at_a_record.compress(raw[0]) + cut_at_a_record.flush(zlib.Z_SYNC_FLUSH)
    read = lambda data: list(warc.records(warc.inflate(io.BytesIO(data))))
    assert read(whole + bytes(700)) == raw and read(b"") == []
    assert read(gzip.compress(b"\r\n" + raw[0] + b"\r\n\r\n" + raw[1] + b"\r\n")) == raw[:2]
    for bad in (part, whole[:-20], whole + b"garbage", gzip.compress(raw[0][:-10]), b"plain", gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx")):
        with pytest.raises(ValueError):
            read(bad)
    bomb = warc.record(1, "u", bytes(30 << 20), None)
    assert max(map(len, warc.inflate(io.BytesIO(gzip.compress(bomb))))) <= warc.PIECE and read(gzip.compress(bomb)) == [bomb]


def test_archives_of_others(spark, tmp_path):
    head = lambda kind, block, *more: b"\r\n".join([b"WARC/1.0", b"warc-type: " + kind, b"WARC-RECORD-ID: <urn:uuid:1-2>", b"Warc-Date: 2020-01-01T00:00:00Z", *more, b"CONTENT-LENGTH:  %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"
    page = b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n<p>x</p>"
    sha = hashlib.sha1(b"<p>x</p>")
    raw = [
        head(b"warcinfo", b"software: x\r\n", b"Content-Type: application/warc-fields"),
        head(b"response", page, b"Content-Type: application/http;\r\n msgtype=response", b"WARC-Target-URI: http://a/", b"WARC-Payload-Digest: sha1:" + sha.hexdigest().encode()),
        head(b"response", page, b"content-type: application/http", b"WARC-Payload-Digest: md5:abc"),
        head(b"revisit", b"HTTP/1.1 200 OK\r\n\r\n", b"content-type: application/http"), head(b"metadata", b""),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(b"".join(raw)))
    made = warc.normalise(spark, f"file://{tmp_path}/in", ["a.warc.gz"], f"file://{tmp_path}/out")
    got = warc.read_archives(made, f"file://{tmp_path}/out").collect()
    b32 = base64.b32encode(sha.digest()).decode()
    assert [(x.record_type, x.payload_bytes) for x in got] == [("warcinfo", 13), ("response", 8), ("response", 8), ("revisit", None), ("metadata", 0)]
    assert [x.payload_digest for x in got[1:4]] == [b32, b32, None] and {x.page_id for x in got} == {None}
    assert got[1].target_uri == "http://a/" and got[1].record_id == "urn:uuid:1-2"


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert rows_of(warc.op5_warc_normaliser(spark, SF)) == sorted(con.execute(warc.OP5_SQL).fetchall(), key=str)
