import base64
import gzip
import hashlib
import uuid

import pytest

from texspark.llm import warc

PAGES = "page_id long, url string, html string, row long, digest string"
LONG = "é€" * 4000


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 1000)
    monkeypatch.setattr(warc, "CHUNK", 300)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back_whole(spark, tmp_path, monkeypatch, least):
    rows = [(1, "http://a/\r\nx: y", "<p>one</p>"), (2, None, None), (3, "u", ""), (4, "u", LONG), (5, "u", LONG), (6, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (None, "u", "<p>one</p>"), (7, "u", "ab"), (8, "u", "ab"), (9, "u", "z\0z"), (9, "u", "z\0z")]
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(*r, 7, "clash") for r in rows], PAGES).repartition(3)
    warc.SEGMENT, warc.CHUNK, kept = 1000, 300, (warc.SEGMENT, warc.CHUNK)
    try:
        names = {f"urn:page:{r.row}": r.page_id for r in warc.write(pages, path, least).collect()}
        out = warc.read(spark, path).collect()
    finally:
        warc.SEGMENT, warc.CHUNK = kept
    assert len(out) == len(rows) and all(r.whole for r in out)
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    got = sorted((names[r.record_id] if names[r.record_id] is not None else -1, r.payload_bytes, r.digest, r.kind, names.get(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in out)
    want, seen = [], set()
    for p, _, h in rows:
        raw, p = (h or "").encode(), -1 if p is None else p
        first = len(raw) < least or (last[h or ""] == p and (p, h) not in seen)
        seen.add((p, h))
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""], raw if first else None))
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_missing_segment_or_a_broken_frame_is_told(spark, tmp_path, small):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"x" * 2500)
    row = {"row": 3, "url": "u", "digest": "D", "payload_bytes": 2500, "refers_to": None, "html": "x" * 2500}
    parts = list(warc.records(row))
    assert len(parts) == 3 and b"".join(b for p in parts for _, b in warc.parsed(p + b"\r\n\r\n")).startswith(block[:17])
    for name, kept in (("gap", [parts[0], parts[2]]), ("tail", parts[:2]), ("head", parts[1:])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.gz").write_bytes(gzip.compress(b"".join(p + b"\r\n\r\n" for p in kept)))
        (got,) = warc.read(spark, str(folder)).collect()
        assert not got.whole and got.payload is None
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    """A member for each record, other record types, any ids, lenient headers, plain files, revisits of elsewhere, damage."""
    def rec(kind, name, block, *fields, end="\r\n"):
        return end.join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID:<{name}>", *fields, f"content-length:{len(block)}", "", ""]).encode() + block + (end * 2).encode()

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    records = [
        rec("warcinfo", "urn:uuid:0", b"software: x"), rec("request", "urn:uuid:1", b"GET / HTTP/1.1\r\n\r\n"),
        rec("response", "urn:uuid:2", http + b"one\xff\r\n\r\ntwo", "WARC-Target-URI: http://a/", " b"),
        rec("resource", "urn:uuid:3", b"HTTP in name only", end="\n"), rec("metadata", "urn:uuid:4", b"x: y"),
        rec("response", "urn:uuid:5", b"HTTP/1.1 200 OK\r\nTransfer-Encoding:chunked\r\n\r\n3;x=1\r\nabc\r\n0\r\n\r\n"),
        rec("revisit", "urn:uuid:6", b"", "WARC-Refers-To: <urn:uuid:99>", "WARC-Payload-Digest: sha1:ABC"),
        rec("response", "urn:uuid:7", http + b"a" * 50, "WARC-Segment-Number: 1"), rec("continuation", "urn:uuid:8", b"b" * 5, "WARC-Segment-Origin-ID: <urn:uuid:7>", "WARC-Segment-Number: 2", f"WARC-Segment-Total-Length: {len(http) + 55}"),
    ]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "plain.warc").write_bytes(records[2].replace(b"uuid:2", b"uuid:12"))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(records[3].replace(b"uuid:3", b"uuid:13"))[:] + gzip.compress(records[2])[:-20])
    (tmp_path / "junk.gz").write_bytes(gzip.compress(b"no archive"))
    got = {(r.record_id, r.kind): r for r in warc.read(spark, str(tmp_path)).collect()}
    payloads = {k[0][9:]: bytes(r.payload) for k, r in got.items() if r.payload is not None}
    assert payloads == {"2": b"one\xff\r\n\r\ntwo", "12": b"one\xff\r\n\r\ntwo", "3": b"HTTP in name only", "13": b"HTTP in name only", "5": b"abc", "7": b"a" * 50 + b"b" * 5}
    assert got["urn:uuid:2", "response"].url == "http://a/ b"
    revisit = got["urn:uuid:6", "revisit"]
    assert (revisit.refers_to, revisit.digest, revisit.payload_bytes, revisit.whole) == ("urn:uuid:99", "ABC", None, True)
    assert not got[None, "damaged"].whole and len(got) == 8


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/none"
    assert warc.write(spark.createDataFrame([], PAGES), path).collect() == []
    assert warc.read(spark, path).collect() == []


def test_each_archive_is_read_at_most_twice(spark):
    """Once for whole records and once for segments; pages are described without Python."""
    plan = warc.op6_warc(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("binaryFile") <= 2
    described = warc.digested(spark.createDataFrame([], PAGES))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in described


def test_without_payloads_all_else_is_the_same(spark, tmp_path, small):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(i, "u", h, 7, "clash") for i, h in enumerate(["", None, "ab", LONG, LONG, "x" * 5000])], PAGES)
    warc.write(pages, path).collect()
    row = {"row": 99, "url": "u", "digest": "D", "payload_bytes": 2500, "refers_to": None, "html": "x" * 2500}
    with open(f"{path}/cut.gz", "wb") as f:
        f.write(gzip.compress(b"\r\n\r\n".join(list(warc.records(row))[1:])) + b"no archive")
    full, bare = warc.read(spark, path), warc.read(spark, path, payloads=False)
    assert sorted(set(full.columns) - set(bare.columns)) == ["payload"]
    got = [sorted(map(str, df.select(*bare.columns).collect())) for df in (full, bare)]
    assert got[0] == got[1] and len(got[0]) == 8


def test_base32_in_sql(spark):
    digests = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(200)] + ["0" * 40, "f" * 40, "0" * 39 + "1"]
    got = spark.createDataFrame([(d,) for d in digests], "sha1 string").select("sha1", warc.base32("sha1").alias("b")).collect()
    assert {r.sha1: r.b for r in got} == {d: base64.b32encode(bytes.fromhex(d)).decode() for d in digests}


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_members_are_inflated_in_bounded_pieces(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    members = [warc.record("resource", f"urn:{i}", b"z" * 3000) + b"\r\n\r\n" for i in range(3)]
    whole = b"".join(map(gzip.compress, members))
    assert [b for _, b in warc.parsed(whole)] == [b"z" * 3000] * 3
    inflated = warc.Inflated(whole)
    inflated.readinto(bytearray(1))
    assert len(inflated.held) < piece + (piece == 1)
    seen = []
    with pytest.raises(ValueError):
        for _, block in warc.parsed(whole[:-8]):  # the last member lacks its end
            seen.append(len(block))
    assert seen == [3000] * 3
