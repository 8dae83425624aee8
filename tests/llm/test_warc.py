import gzip
import hashlib
import random
import zlib

import duckdb

from lantern.llm import warc as x
from tests.llm.data import folder, pages

BIG = "".join(chr(97 + i * 7 % 26) if i % 50 else "é\r\n\r\nWARC/1.1\r\n" for i in range(60_000))
ROWS = [
    (5, "http://a/", BIG), (3, "http://b/\r\n", BIG), (9, None, BIG), (1, "u", None), (2, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 100), (8, "u", "y" * 100),
    (None, "n", "z" * 200), (11, "é", "z" * 200), (20, "q", BIG + "2"), (20, "q", BIG + "2"), (21, "q", "0\r\n\r\n" * 50),
]


def test_round_trip_against_sql(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").unionByName(pages(spark).selectExpr("page_id + 1000 AS page_id", "url", "html"))
    path = folder(spark, tmp_path, pages=df.repartition(3))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    want = [(i, n, sha, "revisit" if i is None and n == 200 else kind, 11 if i is None and n == 200 else to) for i, n, sha, kind, to in db.execute(x.oracle()).fetchall()]
    assert sorted(map(tuple, x.query(spark, path).collect()), key=str) == sorted(want, key=str)


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, uri string, payload string")
    x.write(df, f"{tmp_path}/w")
    got = {r["record_id"]: bytes(r["payload"]) for r in x.read(spark, f"{tmp_path}/w").where("type = 'response'").collect()}
    assert got["<urn:lantern:3>"] == BIG.encode() and got["<urn:lantern:21>"] == b"0\r\n\r\n" * 50 and got["<urn:lantern:1>"] == b""


def test_repeated_ids_with_different_payloads(spark, tmp_path):
    a, b = "a" * 150, "b" * 250
    path = folder(spark, tmp_path, pages=spark.createDataFrame([(5, "u", a), (5, "u", b), (9, "u", b), (8, "u", a)], "page_id long, url string, html string"))
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in (a, b)}
    got = sorted(map(tuple, x.query(spark, path).collect()), key=str)
    assert got == sorted([(5, 150, sha[a], "response", None), (5, 250, sha[b], "response", None), (9, 250, sha[b], "revisit", 5), (8, 150, sha[a], "revisit", 5)], key=str)


def test_every_record_is_a_gzip_member(spark, tmp_path):
    x.write(spark.createDataFrame(ROWS, "id long, uri string, payload string").coalesce(1), f"{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    members = []
    while data:
        unpack = zlib.decompressobj(31)
        members.append(unpack.decompress(data) + unpack.flush())
        assert unpack.eof
        data = unpack.unused_data
    assert len(members) > len(ROWS) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    assert zlib.decompress(x.member(b"x" * (1 << 24)) + b"\0", 31) == b"x" * (1 << 24)


def test_broken_framing_and_lengths():
    head = b"HTTP/1.1 200\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert [x.http_payload(head + b) for b in (b"zz\r\nab", b"-5\r\nab\r\n0\r\n\r\n", b"\r\n", b"0\r\n\r\n")] == [None, None, None, b""]
    assert [b for _, b in x.records([b"WARC/1.0\r\nContent-Length: x\r\n\r\n\r\n\r\n"])] == [b""]


def test_segments_out_of_order_or_missing(spark):
    def part(n, block, total=None, origin="o"):
        return ("response" if n == 1 else "continuation", origin if n == 1 else f"{origin}/{n}", None, None, "d", None if n == 1 else origin, str(n), total, block)

    rows = [part(3, b"c", "3"), part(1, b"a"), part(2, b"b"), part(1, b"a", origin="p"), part(3, b"c", "3", "p"), part(1, b"a", origin="q"), part(2, b"b", "9", "q")]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in x.FIELDS) + ", block binary")
    got = {r["record_id"]: (r["complete"], r["block"] and bytes(r["block"])) for r in x.reassembled(df).collect()}
    assert got == {"o": (True, b"abc"), "p": (False, None), "q": (False, None)}


def test_foreign_archives(spark, tmp_path):
    """One gzip member a record, plain HTTP, a record without HTTP, and framing with an extension."""
    record = lambda kind, block: f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    bodies = {"response": b"HTTP/1.1 200\r\nA: b\r\n\r\nhi\r\n\r\n", "warcinfo": b"software: x", "metadata": b"HTTP/1.1 200\r\nTransfer-Encoding: gzip, chunked\r\n\r\n3;x=y\r\nabc\r\n0\r\n\r\n"}
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(k, b)) for k, b in bodies.items()))
    (tmp_path / "b.warc").write_bytes(record("resource", b""))
    got = {r["type"]: bytes(r["payload"]) for r in x.read(spark, str(tmp_path)).collect()}
    assert got == {"response": b"hi\r\n\r\n", "warcinfo": b"software: x", "metadata": b"abc", "resource": b""}


def test_long_archives_in_pieces(spark, tmp_path):
    """Plain, gzip by name and gzip without the name, over many splits, beside a short one; line feeds and bytes of all kinds."""
    rng = random.Random(5)
    blocks = [b"", b"\n", b"\n\n\nWARC/1.0\r\n\r\n", *(rng.randbytes(rng.randint(0, 9_000)) for _ in range(40)), b"x" * 30_000]
    record = lambda i, b: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    whole = [record(i, b) for i, b in enumerate(blocks)]
    (tmp_path / "a.warc").write_bytes(b"".join(whole))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    (tmp_path / "c.arc").write_bytes(b"".join(map(gzip.compress, whole)))
    (tmp_path / "d.warc").write_bytes(record("short", b"\n"))
    (tmp_path / "e.warc").write_bytes(b"".join(whole)[: -1 - 4])
    want = sorted([(str(i), b) for i, b in enumerate(blocks)] * 4 + [("short", b"\n")])
    want.remove((str(len(blocks) - 1), blocks[-1]))
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    spark.conf.set(split, "7000")
    try:
        got = x.parsed(spark, str(tmp_path), whole=2_000).select("record_id", "block").collect()
        cut = x.pieces(spark, str(tmp_path), 2_000, 1_000).orderBy("file", "start", "n").collect()
    finally:
        spark.conf.set(split, before)
    assert sorted((r[0], bytes(r[1])) for r in got if r[1] is not None) == want
    assert [r[0] for r in got if r[1] is None] == [str(len(blocks) - 1)]
    files = {}
    for r in cut:
        files[r["file"][-6:]] = files.get(r["file"][-6:], b"") + bytes(r["piece"])
    assert files == {"a.warc": b"".join(whole)[:-1], "arc.gz": b"".join(whole)[:-1], "/c.arc": (tmp_path / "c.arc").read_bytes(), "e.warc": b"".join(whole)[:-5]}
    assert len({r["start"] for r in cut}) > 5


def test_broken_and_cut_gzip():
    record = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    packed = gzip.compress(record)
    blocks = lambda data: [b for _, b in x.records([data])]
    assert blocks(packed * 2) == [b"abc"] * 2 and blocks(packed + b"no gzip") == [b"abc"] and blocks(packed + packed[:-20]) in ([b"abc"], [b"abc", None])
    assert blocks(record[:-6]) == [None] and blocks(b"") == [] and blocks(b"\n") == []
    assert [b for _, b in x.records(bytes([c]) for c in record)] == [b"abc"]


def test_empty(spark, tmp_path):
    path = folder(spark, tmp_path, pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert x.query(spark, path).collect() == []
