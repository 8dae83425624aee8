"""WARC: writing archives, and reading them with segment reassembly and chunked framing decoded.

Writing is all expressions: a payload becomes an HTTP response in chunked transfer framing, a response
block longer than ``SEGMENT`` bytes becomes a first record and continuation records that name it as their
origin, and payloads of at least ``LEAST`` bytes that occur again become revisit records of the one with
the smallest id. Every record is a gzip member of its own, so an archive can be read from any record on. A
member ends in the size of its content, whose highest byte is 0 below 16 MB: that byte is the separator of
Spark's text sink, which thus writes archives to any store, of ``ARCHIVE`` records at most.

Reading takes each file once through a streaming parser that holds one record at a time (files above ``WHOLE`` bytes
in pieces, so an archive may have any size); the parsed records are a table. Continuation records are grouped by the identifier of their origin (and the payload digest, so that
repeated identifiers do not mix), ordered by segment number, and checked: numbers 1 to n without a gap, lengths
adding up to the total that the last one states. Only records in segments are shuffled. The HTTP block is then
unframed. Framing and reassembly join their pieces once, in time in proportion to the payload.

Defined results: a null payload is an empty one; a null id is written as an empty name and read as null;
repeated rows are records of their own, and among equal payloads with the same smallest id (a tie) all are
responses; rows of one id with different payloads are told apart by their digests; a very long payload becomes
as many segments as it takes; a group of segments that fails its check, and a record within which its archive ends,
has ``complete`` false and a null payload; an empty table gives no records; columns of the input other than ``id``, ``uri`` and ``payload`` play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import remove, small_or_plain, table, workspace, written

#: Bytes of a block in one record, bytes of a chunk, least bytes of a payload that is revisited.
SEGMENT, CHUNK, LEAST = 32_768, 4_096, 100
#: Records in an archive file.
ARCHIVE = 8_192
#: Repeated payloads up to which their table (80 bytes a row) is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 20_000
URN = "urn:lantern:"
EOL = "\r\n"
#: Bytes of record blocks that the reader hands on at once.
BATCH_BYTES = 4_000_000
#: Bytes of a file that is read as one value; longer ones are read in pieces of about ``PIECE`` bytes.
WHOLE, PIECE = 32_000_000, 1_000_000


def repeated(pages: DataFrame) -> DataFrame:
    """``digest`` of each payload that several rows have, with ``first``, its smallest id."""
    found = pages.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return found.where("n > 1").select(F.col("digest").alias("_digest"), "first")


def _name(id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(id.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit(""))


def _cut(data: Column, size: int) -> Column:
    """Binary pieces of ``size`` bytes, the last one shorter; none of empty data."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.substring(data, i, F.lit(size))), lambda x: F.octet_length(x) > 0)


def chunked(data: Column) -> Column:
    """``data`` in chunked transfer framing, closed by an empty chunk."""
    bin = lambda c: c.cast("binary")
    frame = lambda x: F.concat(bin(F.lower(F.hex(F.octet_length(x)))), bin(F.lit(EOL)), x, bin(F.lit(EOL)))
    return F.concat(_joined(F.transform(_cut(data, CHUNK), frame)), bin(F.lit(f"0{EOL}{EOL}")))


def _joined(pieces: Column) -> Column:
    """An array of binary pieces as one, joined byte by byte."""
    return F.array_join(pieces.cast("array<string>"), "").cast("binary")


#: A gzip member without content.
NOTHING = zlib.compressobj(wbits=31).flush()


def member(record: bytes) -> bytes:
    """``record`` as a gzip member, without its last byte, which is 0."""
    pack = zlib.compressobj(wbits=31)
    out = pack.compress(record) + pack.flush()
    return (out if out[-1] == 0 else out + NOTHING)[:-1]


def packed(rows: DataFrame) -> DataFrame:
    """``value``, a record, as ``member``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(start, 256)
                yield pa.RecordBatch.from_arrays([pa.array([member(x.as_py()) for x in part], pa.binary())], names=["value"])

    return rows.mapInArrow(run, "value binary")


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Archive files below ``path`` of ``id``, ``uri`` and ``payload`` (string or binary)."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("id", "uri", payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha2("payload", 256)})
    seen = workspace(spark)
    known = small_or_plain(written(repeated(rows.select("id", "bytes", "digest")), seen, "repeated"), BROADCAST_ROWS)
    rows = rows.join(known, rows["digest"] == known["_digest"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    head = F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Transfer-Encoding: chunked{EOL}{EOL}").cast("binary")
    rows = rows.withColumn("revisit", revisit)
    body = F.when(F.col("revisit"), F.lit(f"0{EOL}{EOL}").cast("binary")).otherwise(chunked(F.col("payload")))
    rows = rows.withColumn("block", F.concat(head, body)).withColumn("total", F.octet_length("block"))
    rows = rows.select("*", F.posexplode(_cut(F.col("block"), SEGMENT)).alias("at", "part"))
    many, later = F.col("total") > SEGMENT, F.col("at") > 0
    last = (F.col("at") + 1) * SEGMENT >= F.col("total")
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _line("WARC-Type", F.when(later, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.when(later, F.concat(F.lit(f"<{URN}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":segment:"), F.col("at") + 1, F.lit(">"))).otherwise(_name(F.col("id")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("uri", "[\\r\\n]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _name(F.col("first")))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Segment-Number", F.when(many, F.col("at") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(many & later, _name(F.col("id")))),
        _line("WARC-Segment-Total-Length", F.when(many & later & last, F.col("total"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("part")),
        F.lit(EOL),
    )
    record = F.concat(header.cast("binary"), F.col("part"), F.lit(EOL * 2).cast("binary"))
    members = packed(rows.select(record.alias("value"))).select(F.col("value").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE).text(path)
    remove(spark, seen)


class Stream:
    """Bytes of an archive, plain or gzip (in one member or many), taken from its pieces and unpacked as they are asked for."""

    def __init__(self, pieces: Iterable[bytes], step: int = 1 << 14):
        self.steps = (memoryview(x)[i : i + step] for x in pieces for i in range(0, len(x), step))
        self.held, self.unpack, self.begun = bytearray(), None, False

    def more(self) -> bool:
        """Hold one step more, if there is one; bytes that are no gzip where gzip is due end the archive."""
        if (piece := next(self.steps, None)) is None:
            return False
        if not self.begun:
            self.begun, self.unpack = True, zlib.decompressobj(31) if piece[:2] == b"\x1f\x8b" else None
        try:
            while self.unpack and len(piece):
                self.held += self.unpack.decompress(piece)
                piece = self.unpack.unused_data
                if self.unpack.eof:
                    self.unpack = zlib.decompressobj(31)
        except zlib.error:
            self.steps = iter(())
        self.held += b"" if self.unpack else piece
        return True

    def until(self, end: bytes) -> bytes | None:
        looked = 0
        while (i := self.held.find(end, looked)) < 0:
            looked = max(0, len(self.held) - len(end) + 1)
            if not self.more():
                return None
        return self.take(i + len(end))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields by lower-case name, and the block, of every record; the block is null if the archive ends within it."""
    stream = Stream(pieces)
    while (head := stream.until((EOL * 2).encode())) is not None:
        lines = head.decode("utf-8", "replace").strip().split(EOL)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        size = int(size) if size.isdecimal() else 0
        block = stream.take(size)
        stream.take(4)
        yield fields, block if len(block) == size else None


FIELDS = {"type": "warc-type", "record_id": "warc-record-id", "uri": "warc-target-uri", "refers_to": "warc-refers-to", "digest": "warc-payload-digest", "origin": "warc-segment-origin-id", "segment": "warc-segment-number", "total": "warc-segment-total-length"}


def pieces(spark: SparkSession, path: str, least: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """``file``, ``start``, ``n``, ``piece``: the files below ``path`` of more than ``least`` bytes, to be joined in that order.

    The text source reads a file of any store in splits, cut at line feeds whatever the bytes between them are, and
    unpacks it if its name ends in ``.gz``. A line feed that ends the file is left out.
    """
    here = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).where(here["file_size"] > least)
    lines = lines.select(here["file_path"].alias("file"), here["file_block_start"].alias("start"), F.col("value").cast("binary").alias("line"))
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("piece", pa.binary())])

    def joined(file: str, start: int, n: int, held: list[bytes]) -> pa.RecordBatch:
        data = (b"\n" if start or n else b"") + b"\n".join(held)
        return pa.RecordBatch.from_pylist([{"file": file, "start": start, "n": n, "piece": data}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (file, start), split in groupby(rows, key=itemgetter(0, 1)):
            held, size, n = [], 0, 0
            for _, _, line in split:
                held.append(line)
                size += len(line) + 1
                if size >= piece:
                    yield joined(file, start, n, held)
                    held, size, n = [], 0, n + 1
            if held:
                yield joined(file, start, n, held)

    return lines.mapInArrow(run, "file string, start long, n long, piece binary")


def parsed(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """The fields and the block of every record of the archives below ``path``.

    A file of up to ``whole`` bytes is one value; the pieces of a longer one are sorted into one task, which reads them
    one after the other, so that no more than a piece and a record are in memory, however long the archive is.
    """
    schema = ", ".join(f"{k} string" for k in FIELDS) + ", block binary"
    names = [*FIELDS, "block"]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "block" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    def tables(archives: Iterable[Iterable[bytes]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for archive in archives:
            for fields, block in records(archive):
                rows.append([*(fields.get(k) for k in FIELDS.values()), block])
                size += len(block or b"") + 500
                if size > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tables([x.as_py()] for b in batches for x in b.column(0))

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((file.as_py(), piece.as_py()) for b in batches for file, piece in zip(b.column(0), b.column(1), strict=True))
        yield from tables((piece for _, piece in file) for _, file in groupby(rows, key=itemgetter(0)))

    short = spark.read.format("binaryFile").load(path).where(F.col("length") <= whole).select("content").mapInArrow(at_once, schema)
    order = pieces(spark, path, whole).repartition("file").sortWithinPartitions("file", "start", "n")
    return short.unionAll(order.select("file", "piece").mapInArrow(one_by_one, schema))


def reassembled(parts: DataFrame) -> DataFrame:
    """One record per origin from its segments, in order, with ``complete``."""
    parts = parts.withColumn("origin", F.coalesce("origin", "record_id"))
    first = F.col("segment") == "1"
    whole = parts.groupBy("origin", "digest").agg(
        *(F.first(F.when(first, F.col(c)), ignorenulls=True).alias(c) for c in ("type", "uri", "refers_to")),
        F.sort_array(F.collect_set(F.struct(F.col("segment").cast("int").alias("n"), "block"))).alias("blocks"),
        F.max(F.col("total").cast("long")).alias("total"),
        F.sum(first.cast("int")).alias("copies"),
    )
    length = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    ordered = F.transform("blocks", lambda x: x["n"]) == F.sequence(F.lit(1), F.size("blocks"))
    whole = whole.withColumn("complete", F.coalesce((length == F.col("total")) & ordered, F.lit(False)))
    whole = whole.withColumn("block", F.when(F.col("complete"), _joined(F.transform("blocks", lambda x: x["block"])))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    return whole.select("type", F.col("origin").alias("record_id"), "uri", "refers_to", "digest", "complete", "block")


def http_payload(block: bytes | None) -> bytes | None:
    """The body of an HTTP message, out of its chunked framing if its header says so; null if that is broken."""
    if block is None:
        return None
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        return body if found else block
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        size = int(size, 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return None


def read(spark: SparkSession, path: str, folder: str = "", whole: int = WHOLE) -> DataFrame:
    """Records of the archives below ``path``: type, record_id, uri, refers_to, digest, complete, payload.

    The parsed records are written to ``folder``, or else to a fresh one below the shared folder.
    """
    names = ["type", "record_id", "uri", "refers_to", "digest", "complete", "block"]
    every = written(parsed(spark, path, whole), folder or workspace(spark), "parsed")
    single = every.where("segment IS NULL").withColumn("complete", F.col("block").isNotNull())
    found = single.select(*names).unionByName(reassembled(every.where("segment IS NOT NULL")))
    schema = "type string, record_id string, uri string, refers_to string, digest string, complete boolean, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                bodies = pa.array([http_payload(x.as_py()) for x in part.column(6)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:6], bodies], names=[*names[:6], "payload"])

    return found.mapInArrow(run, schema)


def id_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, f"<{URN}(.*)>", 1), F.lit(""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to archives and read back."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = workspace(spark)
    write(pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload")), f"{folder}/archive")
    back = read(spark, f"{folder}/archive", folder)
    names = [id_of(F.col(c)).cast("long").alias(n) for c, n in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    small = back.select(*names, F.col("type").alias("record_type"), F.substring_index("digest", ":", -1).alias("stated"), F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha"))
    rows = written(small, folder, "records")
    for done in ("archive", "parsed"):
        remove(spark, f"{folder}/{done}")
    responses, revisits = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    # what a revisit refers to: an id may have several payloads, so the digest counts as well
    asked = revisits.select(F.col("refers_to").alias("_id"), F.col("stated").alias("_stated")).distinct()
    told = responses.join(asked, (F.col("page_id") == F.col("_id")) & (F.col("stated") == F.col("_stated")), "left_semi")
    told = told.groupBy(F.col("page_id").alias("_id"), F.col("stated").alias("_stated")).agg(F.first("bytes").alias("_bytes"), F.first("sha").alias("_sha"))
    told = small_or_plain(written(told, folder, "told"), BROADCAST_ROWS)
    revisits = revisits.join(told, (F.col("refers_to") == F.col("_id")) & (F.col("stated") == F.col("_stated")), "left")
    out = lambda df, n, sha: df.select("page_id", F.col(n).alias("payload_bytes"), F.col(sha).alias("payload_digest"), "record_type", "refers_to")
    return out(responses, "bytes", "sha").unionAll(out(revisits, "_bytes", "_sha"))


def oracle() -> str:
    return """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS sha FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM d)
    SELECT page_id, n AS payload_bytes, sha AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""
