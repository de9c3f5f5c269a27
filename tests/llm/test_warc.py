import base64
import gzip
import hashlib
import zlib

import pytest

from logloom.llm import warc


def test_chunked_round_trip():
    for n in (0, 1, 8191, 8192, 8193, 30000):
        payload = bytes(range(256)) * (n // 256) + b"x" * (n % 256)
        assert warc.unchunked(warc.chunked(payload)) == payload
    for broken in (b"", b"5\r\nab", b"zz\r\n", b"2\r\nabX\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def archive(records):
    return b"".join(r + warc.END for r in records)


def test_parse_members_and_truncation():
    a = archive(warc.records_of(1, 0, "http://x/\r\ninjected: y", b"hello", None))
    b = archive(warc.records_of(2, 1, None, "é".encode() * 40000, None, segment=1000))
    plain = list(warc.parse(a + b))
    assert list(warc.parse(gzip.compress(a) + gzip.compress(b))) == plain
    assert "injected" not in plain[0][0] and len(plain) > 80
    with pytest.raises(ValueError):
        list(warc.parse((a + b)[:-3]))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(a + b)[:-30]))


def test_members_end_in_a_zero_byte():
    for data in (b"", b"x", b"y" * 100_000, b"z" * ((1 << 24) + 1)):
        m = warc.member(data)
        assert m[-1] == 0 and gzip.decompress(m) == data


def test_every_record_is_a_member(spark, tmp_path):
    """Any member decompresses alone, and is one record; plain archives hold the same records."""
    pages = spark.createDataFrame([(k, f"http://x/{k}", "é" * (700 * k)) for k in range(1, 20)], "page_id long, url string, html string").coalesce(1)
    for name, compressed in (("gz", True), ("plain", False)):
        warc.write(pages, str(tmp_path / name), segment=9000, compressed=compressed)
    (gz,) = (tmp_path / "gz").glob("part-*")
    (plain,) = (tmp_path / "plain").glob("part-*")
    rest, n = gz.read_bytes(), 0
    while rest:
        z = zlib.decompressobj(31)
        one = z.decompress(rest)
        assert one.startswith(b"WARC/1.1\r\n") and len(list(warc.parse(one))) == 1
        rest, n = z.unused_data, n + 1
    want = list(warc.parse(plain.read_bytes()))
    assert n == len(want) > 19 and list(warc.parse(gz.read_bytes())) == want


def test_round_trip(spark, tmp_path):
    big = "ü" * 40000 + "\r\n\r\nWARC/1.1\r\n" + "z" * 10
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u5", big), (6, "u6", "one"), (7, "u7", big), (None, "u8", "same"), (None, "u9", "alone"), (2, "u2", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' digest", "1 row", "2 keep")
    warc.write(pages, str(tmp_path / "a"), segment=1000)
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    largest = {}
    for p, _, h in rows:
        if p is not None:
            largest[h or ""] = max(p, largest.get(h or "", p))
    want = []
    for p, u, h in rows:
        b = (h or "").encode()
        keep = largest.get(h or "")
        again = keep if keep is not None and keep != p else None
        want.append((p, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if again is None else "revisit", again, None if again else b))
    have = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"), min_bytes=3)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(spark, str(tmp_path / "a"), with_payload=False).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_missing_segment_is_reported(spark, tmp_path):
    records = list(warc.records_of(1, 0, "u", b"q" * 5000, None, segment=1000))
    (tmp_path / "x.warc").write_bytes(archive(records[:2] + records[3:]))
    (tmp_path / "y.warc").write_bytes(archive(list(warc.records_of(2, 1, "u", b"q" * 5000, None, segment=1000))[::-1]))
    got = {r["page_id"]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert got[1]["problem"] and got[1]["payload"] is None
    assert got[2]["problem"] is None and bytes(got[2]["payload"]) == b"q" * 5000


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


def test_revisits_are_resolved(spark, tmp_path):
    response, other = (list(warc.records_of(k, k, f"u{k}", text, None)) for k, text in ((1, b"one"), (2, b"two")))
    revisits = [next(warc.records_of(k, k, "u", text, to)) for k, text, to in ((3, b"one", (1, 1, "u1")), (4, b"one", (2, 2, None)), (5, b"one", (9, 9, "u9")))]
    (tmp_path / "x.warc").write_bytes(archive([*revisits, *response, *other]))
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["problem"]) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got[3] == ("revisit", 1, 3, None)
    assert got[4][3] == "payload digest differs" and got[5] == ("revisit", 9, None, "response missing")
    assert b"WARC-Refers-To: " + warc.record_id(1, 1).encode() in revisits[0] and b"WARC-Refers-To-Target-URI: u1" in revisits[0]
