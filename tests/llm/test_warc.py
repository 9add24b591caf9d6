import gzip
import hashlib
import io

from weftline.llm.common import shared_path
from weftline.llm.warc import _members, _Reader, _row, archive_pages, assemble_transactions, base32_digest, capture_digests, hex_digest, parse_records, read_archives, write_archives

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    best = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if i is not None and len(data) >= 1000:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        keep = best.get(data, i)
        revisit = keep is not None and keep != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(map(str, out))


def rows_of(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    big = "é\r\n\r\nWARC/1.1\r\n" * 100
    return pages + [(1000 + i, f"http://x/{i}", big) for i in range(60)] + [(2000, None, None), (2001, "", ""), (2002, "a b\r\nc: d", "x" * 999), (2003, "u", "x" * 999), (2004, "u", "y" * 3_000_000), (None, "n", "z" * 2000), (None, "n", None)]


def test_round_trip_against_brute_force(spark, sf):
    rows = rows_of(spark, sf)
    got = capture_digests(archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_archives_are_records_and_links_resolve(spark, sf):
    rows = rows_of(spark, sf)
    manifest = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), shared_path(spark, "t"))
    files = manifest.collect()
    assert sum(f.records for f in files) == 3 * len(rows)
    with open(files[0].path.removeprefix("file:"), "rb") as f:
        plain = gzip.decompress(f.read())
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and sum(1 for _ in parse_records(io.BytesIO(plain))) == files[0].records
    records = read_archives(manifest)
    whole = {r.record_id: r for r in assemble_transactions(records).collect()}
    assert len(whole) == len(rows)
    payloads = {(r[0], (r[2] or "").encode()) for r in rows}
    for r in whole.values():
        assert r.request.http_start.startswith("GET ") and r.metadata.concurrent_to == r.record_id == r.request.concurrent_to
        page = dict(r.metadata.fields).get("page_id")
        if r.response.type == "response":
            assert (page and int(page), bytes(r.response.payload)) in payloads
        else:
            target = whole[r.response.refers_to]
            assert target.response.type == "response" and dict(target.metadata.fields)["page_id"] == dict(r.metadata.fields)["refers_to_page"]
            assert target.response.payload_sha1 == r.response.declared_sha1


def test_repeated_rows(spark):
    rows = [(1, "u", "q" * 1500), (1, "u", "q" * 1500), (0, "u", "q" * 1500), (5, "a", "s"), (5, "a", "s")]
    got = capture_digests(archive_pages(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (5, "response", None), (5, "response", None)]


def test_foreign_archives(spark, tmp_path):
    """Plain files, hex digests, responses that point to their request, records without partners, a cut last record."""
    def record(kind, rid, block, content="application/http", **extra):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "WARC_Record_ID": rid, "Content_Type": content, **extra, "Content_Length": len(block)}.items())
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"

    data = record("warcinfo", "<w>", b"software: x", "application/warc-fields") + record("request", "<q>", b"GET / HTTP/1.0\r\n\r\n")
    data += record("response", "<r>", b"HTTP/1.0 200 OK\r\n\r\nbody", WARC_Concurrent_To="<q>", WARC_Payload_Digest="sha1:" + "AB" * 20) + record("resource", "<s>", b"raw", "text/plain")
    data += record("metadata", "<m2>", b"a: 2", "application/warc-fields", WARC_Concurrent_To="<r>") + record("metadata", "<m1>", b"a: 1", "application/warc-fields", WARC_Concurrent_To="<r>")
    (tmp_path / "x.warc").write_bytes(data + record("response", "<cut>", b"z" * 50)[:-30])
    manifest = spark.createDataFrame([(str(tmp_path / "x.warc"),)], "path string")
    got = {r.record_id: r for r in assemble_transactions(read_archives(manifest)).collect()}
    assert set(got) == {"<r>", "<s>"} and got["<r>"].request.record_id == "<q>" and got["<r>"].metadata.fields == {"a": "1"}
    assert bytes(got["<r>"].response.payload) == b"body" and got["<r>"].response.declared_sha1 == "ab" * 20
    assert got["<s>"].request is None and got["<s>"].metadata is None and bytes(got["<s>"].response.payload) == b"raw"


def test_digests_and_members():
    sha1 = hashlib.sha1(b"x").hexdigest()
    assert hex_digest(base32_digest(sha1)) == sha1 and hex_digest(None) is None and hex_digest("md5:00") is None
    data = b"".join(gzip.compress(bytes([k]) * 5000) for k in range(40))
    assert b"".join(_members(io.BytesIO(data), 37)) == b"".join(bytes([k]) * 5000 for k in range(40))
    assert io.BufferedReader(_Reader(iter([b"ab", b"c"]))).read() == b"abc" and _row({}, b"")["payload_bytes"] == 0


def test_empty(spark):
    assert capture_digests(archive_pages(spark.createDataFrame([], SCHEMA))).count() == 0
