"""Uploads in multipart bodies: a table of bodies to their parts, fields and photo, sound or not.

The framing is read in one pass over each body: delimiters are looked for from where the last one ended. A body is read within its
row; tables are read in batches of bounded bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.sources.schema import PHOTO_BYTES, PHOTO_TYPES, photo_type

#: The field of the photo; bytes of a text field, of a part's head, and parts of a body, at most.
PHOTO_FIELD, FIELD_BYTES, HEAD_BYTES, PARTS = "photo", 1024 * 1024, 16 * 1024, 1000
_PARAMETER = re.compile(r';[ \t]*([!#$%&\'*+\-.^_`|~0-9A-Za-z]+)=(?:"((?:[^"\\]|\\.)*)"|([^;"\s]*))')
PARTS_TYPE = "array<struct<name:string,filename:string,type:string,content:binary>>"


class Broken(ValueError):
    """What is wrong with a body."""


def parameters(value: str) -> dict[str, str]:
    """The parameters of a header's value, by their names in lower case."""
    out = {}
    for name, quoted, plain in _PARAMETER.findall(value):
        out.setdefault(name.lower(), re.sub(r"\\(.)", r"\1", quoted) if quoted else plain)
    return out


def boundary(content_type: str | None) -> bytes:
    kind = (content_type or "").split(";")[0].strip().lower()
    found = parameters(content_type or "").get("boundary", "")
    if kind != "multipart/form-data" or not 0 < len(found) <= 70:
        raise Broken("boundary")
    return found.encode()


def _head(raw: bytes) -> tuple[str, str | None, str]:
    """Name, base name of the file (None: a field) and type, from a part's header lines."""
    lines = re.sub(r"\r\n[ \t]+", " ", raw.decode("utf-8", "replace")).split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    disposition = headers.get("content-disposition", "")
    given = parameters(disposition)
    if disposition.split(";")[0].strip().lower() != "form-data" or "name" not in given:
        raise Broken("header")
    file = given.get("filename")
    if (coded := given.get("filename*", "").split("'", 2))[0].lower() == "utf-8" and len(coded) == 3:
        file = unquote_to_bytes(coded[2]).decode("utf-8", "replace")
    if file is not None:
        file = re.split(r"[/\\]", file)[-1]
    return given["name"], file, headers.get("content-type", "text/plain").split(";")[0].strip().lower()


def parts_of(body: bytes, delimiter: bytes) -> Iterator[tuple[str, str | None, str, bytes]]:
    """The parts of a body in order; what stands before the first delimiter and after the last is no part."""
    mark = b"\r\n--" + delimiter
    # a delimiter at the very start has no line end before it
    at, skipped = (0, len(mark) - 2) if body.startswith(mark[2:]) else (body.find(mark), len(mark))
    start, found = None, 0
    while at >= 0:
        end = at + skipped
        tail = end
        while body[tail : tail + 1] in (b" ", b"\t"):
            tail += 1
        closes, opens = body[end : end + 2] == b"--", body[tail : tail + 2] == b"\r\n"
        if closes or opens:
            if start is not None:
                found += 1
                if found > PARTS:
                    raise Broken("parts")
                stop = body.find(b"\r\n\r\n", start, min(at + 2, start + HEAD_BYTES) + 2)
                if stop < 0:
                    raise Broken("header")
                yield *_head(body[start:stop]), body[stop + 4 : max(stop + 4, at)]
            if closes:
                return
            start = tail + 2
        # else the delimiter is only the beginning of other text. The line end after one may begin the next
        at, skipped = body.find(mark, tail if opens else end), len(mark)
    raise Broken("boundary" if start is None else "truncated")


def read(body: bytes | None, content_type: str | None) -> tuple[list[dict] | None, str | None]:
    try:
        found = parts_of(body or b"", boundary(content_type))
        return [dict(zip(("name", "filename", "type", "content"), p, strict=True)) for p in found], None
    except Broken as e:
        return None, str(e)


def parsed(bodies: DataFrame, body: str = "body", content_type: str = "contentType") -> DataFrame:
    """``bodies`` with ``parts`` instead of ``body``, and ``broken``: null, or ``boundary``, ``header``, ``parts`` or ``truncated``.

    A broken body has no parts: nothing of it is taken. Null bodies are broken.
    """
    kept = [c for c in bodies.columns if c not in (body, "parts", "broken")]
    rows = bodies.select(F.struct(*kept).alias("row"), F.col(body).alias("body"), F.col(content_type).alias("kind"))
    kind = pa.list_(pa.struct([("name", pa.string()), ("filename", pa.string()), ("type", pa.string()), ("content", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts, broken = read(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([parts], kind), pa.array([broken], pa.string())], names=["row", "parts", "broken"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, parts {PARTS_TYPE}, broken string"
    return rows.mapInArrow(run, schema).select("row.*", "parts", "broken")


def uploads(bodies: DataFrame, body: str = "body", content_type: str = "contentType") -> DataFrame:
    """``bodies`` with ``fields`` (a map of texts, the last of a name counts), ``photo`` (``name, type, content``; null if none was sent) and ``error``.

    Errors, the first of: what ``parsed`` calls broken; ``unexpected``, a file in another field, or a second one; ``type``, neither declared
    nor, by its first bytes, one of the image types; ``size``, a photo or field beyond its limit. With an error there is no photo. A file without a name was not chosen, and does not count.
    """
    rows = parsed(bodies, body, content_type)
    files = F.filter("parts", lambda p: p["filename"].isNotNull() & (p["filename"] != ""))
    texts = F.filter("parts", lambda p: p["filename"].isNull())
    rows = rows.withColumns({"_files": files, "_texts": texts})
    photo = F.get("_files", F.lit(0))
    found = photo_type(photo["content"])
    declared = photo["type"].isin(*PHOTO_TYPES)
    error = (
        F.when(F.col("broken").isNotNull(), F.col("broken"))
        .when((F.size("_files") > 1) | (photo["name"] != PHOTO_FIELD), "unexpected")
        .when(photo.isNotNull() & ~(declared & found.isNotNull()), "type")
        .when((F.octet_length(photo["content"]) > PHOTO_BYTES) | F.exists("_texts", lambda p: F.octet_length(p["content"]) > FIELD_BYTES), "size")
    )
    # the last of a name: kept if no later one has it
    last = F.filter("_texts", lambda p, i: ~F.exists(F.slice("_texts", i + 2, F.size("_texts")), lambda q: q["name"] == p["name"]))
    fields = F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], F.decode(p["content"], "UTF-8"))))
    rows = rows.withColumn("error", error)
    row = F.struct(photo["filename"].alias("name"), found.alias("type"), photo["content"].alias("content"))
    kept = [c for c in rows.columns if c not in ("parts", "broken", "_files", "_texts", "error", "fields", "photo")]
    sound = F.col("error").isNull()
    return rows.select(*kept, F.when(sound, fields).alias("fields"), F.when(sound & photo.isNotNull(), row).alias("photo"), "error")
