import base64
import gzip
import hashlib
import io
import struct
import zipfile

import pytest

from paraspark.llm import warc_zip as Z


def brute(rows, least=0):
    groups: dict = {}
    for i, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        ids = [x for x in groups[raw] if x is not None]
        first = min(ids, default=None) if len(raw) >= least else None
        revisit = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "<p>é</p>"), (2, None), (3, ""), (4, "same"), (0, "same"), (9, "same"), (9, "same"), (None, "same"), (7, "x" * 3_000_000), (8, "\r\n\r\nWARC/1.1\r\n"), (None, "only null")]


@pytest.mark.parametrize(("package_bytes", "least"), [(1 << 26, 0), (300, 0), (300, 5)])
def test_round_trip(spark, monkeypatch, package_bytes, least):
    monkeypatch.setattr(Z, "RUN_BYTES", 2000)
    urls = ["http://a/é", None, "with\r\nbreak", "http://a/ b"]
    frame = spark.createDataFrame([(i, urls[k % 4], h) for k, (i, h) in enumerate(ROWS)], "page_id long, url string, html string")
    got = Z.archive_pages(frame, min_bytes=least, package_bytes=package_bytes).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS, least)
    texts = {r.page_id: r.html for r in got if r.record_type == "response" and r.page_id is not None}
    assert all(texts[i] == (h or "") for i, h in ROWS if i in texts)
    assert {r.url for r in got} <= {"http://a/é", None, "with%0D%0Abreak", "http://a/ b"}


def test_hot_payload_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(Z, "BROADCAST_ROWS", 0)
    rows = [(i, "hot" if i % 3 == 0 else f"page {i}") for i in range(90)]
    frame = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(5)
    got = Z.archive_pages(frame).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)


def _records(n):
    return [Z.warc_record(f"urn:page:{k}", "u", b"x" * k, Z.payload_digest(b"x" * k), None) for k in range(n)]


def test_packages_of_other_writers_and_zip64(spark, tmp_path):
    # a package by another writer: no index, a comment that holds an end-record signature, a deflated member beside
    data = b"".join(gzip.compress(r) for r in _records(5))
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:
        z.writestr("archive/x.warc.gz", data)
        z.writestr(zipfile.ZipInfo("note.txt"), "text", compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6" + b"\0" * 30
    package = Z.RangeZip(str(tmp_path / "other.zip"))
    assert set(package.members) == {"archive/x.warc.gz"}
    frame = spark.createDataFrame([(str(tmp_path / "other.zip"),)], "package string")
    assert sorted(r.payload_bytes for r in Z.read_warc(frame).collect()) == [0, 1, 2, 3, 4]

    # ZIP64: sizes, header offset and directory place only in the wide records
    name = b"archive/data.warc.gz"
    out = io.BytesIO()
    out.write(b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
              + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data)
    at = out.tell()
    extra = struct.pack("<HH", 0x5455, 1) + b"\0" + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    out.write(b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
              + name + extra)
    end = out.tell()
    out.write(b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, end - at, at) + b"PK\6\7" + struct.pack("<IQI", 0, end, 1)
              + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    (tmp_path / "wide.zip").write_bytes(out.getvalue())
    wide = Z.RangeZip(str(tmp_path / "wide.zip"))
    offset, size = wide.members[name.decode()]
    assert wide.read(offset, size) == data


def _package(path, members, deflated=()):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data, compress_type=zipfile.ZIP_DEFLATED if name in deflated else zipfile.ZIP_STORED)


def _sizes(spark, path):
    return sorted(r.payload_bytes for r in Z.read_warc(spark.createDataFrame([(str(path),)], "package string")).collect())


@pytest.mark.parametrize("run_bytes", [1 << 20, 150])
def test_every_stored_member_is_read_whole(spark, tmp_path, monkeypatch, run_bytes):
    monkeypatch.setattr(Z, "RUN_BYTES", run_bytes)
    records = _records(9)
    packed = [gzip.compress(r) for r in records]
    starts = [sum(map(len, packed[:k])) for k in range(4)]
    lines = [f'com,a)/ 2020 {{"offset": "{starts[k]}", "length": "1", "filename": "data.warc.gz"}}' for k in (3, 1, 1)]
    plain_at = len(records[6])
    lines.append(f'com,b)/ 2020 {{"offset": {plain_at}, "filename": "archive/plain.warc"}}')
    _package(tmp_path / "all.wacz", {
        "archive/data.warc.gz": b"".join(packed[:4]),               # two of four records listed, one of them twice
        "archive/more.warc.gz": gzip.compress(b"".join(records[4:6])),     # no index, both records in one gzip member
        "archive/plain.warc": b"".join(records[6:9]), Z.INDEX: "!meta\n" + "\n".join(lines), "indexes/x.cdx": "old format 1 2"})
    assert _sizes(spark, tmp_path / "all.wacz") == list(range(9))


def test_indexes_and_members_that_cannot_be_read_are_errors(spark, tmp_path):
    data = b"".join(gzip.compress(r) for r in _records(3))
    name = "archive/data.warc.gz"
    _package(tmp_path / "a", {name: data}, deflated=[name])
    _package(tmp_path / "b", {name: data, Z.INDEX: '{"offset": "0", "filename": "gone.warc.gz"}'})
    _package(tmp_path / "c", {name: data, Z.INDEX: '{"offset": "99999"}'})
    _package(tmp_path / "e", {name: data[:-9]})
    _package(tmp_path / "f", {"x.warc": b"".join(_records(3))[:-6]})
    _package(tmp_path / "g", {"x.warc": b"nothing"})
    for path, words in zip("abcefg", ("is compressed", "does not tell", "outside", "ends inside", "ends inside", "not a WARC"), strict=True):
        with pytest.raises(Exception, match=words):
            _sizes(spark, tmp_path / path)


def test_records_that_are_no_http_messages():
    block = b"software: x\r\n\r\nmore"
    raw = (f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\n"
           f"WARC-Payload-Digest: sha256:00\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    assert Z.parse_record(raw)[4:6] == (block, len(block))
    assert list(Z._members([raw[:7], raw[7:-2], raw[-2:] + raw])) == [raw[:-4]] * 2


def test_packages_are_zip_files_and_damage_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([("urn:a", "u", b"abc", None)], "id string, uri string, payload binary, refers string").coalesce(1)
    manifest = Z.write_warc(frame, str(tmp_path / "w"), "id", "uri", "payload", "refers").collect()
    path = manifest[0].package
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and set(z.namelist()) == {Z.DATA, Z.INDEX}
        assert b"abc" in gzip.decompress(z.read(Z.DATA))
    with pytest.raises(ValueError):
        Z.parse_record(_records(4)[3].replace(b"xxx", b"xyx"))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(ValueError):
        Z.RangeZip(str(tmp_path / "bad.zip"))


def test_empty_table_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, "u", "h", 0, 0)], "page_id long, url string, html string, sha int, first int")
    assert Z.archive_pages(frame).first().payload_bytes == 1
    assert Z.archive_pages(frame.limit(0)).count() == 0
