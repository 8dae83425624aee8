import random

import pytest
from pyspark.sql import functions as F

from lantern.sources import multipart

PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 20
GIF, AVIF = b"GIF89a" + b"\0" * 9, b"\0\0\0\x1cftypavif" + b"\0" * 9
KIND = "multipart/form-data; boundary=XyZ"


def body(parts, mark=b"XyZ", start=b"", end=b"--\r\n"):
    out = start
    for name, file, kind, content in parts:
        head = f'Content-Disposition: form-data; name="{name}"' + (f'; filename="{file}"' if file is not None else "") + (f"\r\nContent-Type: {kind}" if kind else "")
        out += b"--" + mark + b"\r\n" + head.encode() + b"\r\n\r\n" + content + b"\r\n"
    return out + b"--" + mark + end


def values(found):
    return [(p["name"], p["filename"], p["type"], p["content"]) for p in found]


def test_framing():
    parts = [("title", None, "", "Été".encode()), ("photo", "a.png", "image/png", PNG), ("empty", None, "", b""), ("near", None, "", b"\r\n--XyZZ\r\n--Xy\r\n\r\n--XyZ-\r\n-")]
    want = [(n, f, k or "text/plain", c) for n, f, k, c in parts]
    for given in (body(parts), body(parts, start=b"preamble\r\n"), body(parts, end=b"--"), body(parts, end=b"-- \r\nepilogue\r\n--XyZ\r\n")):
        found, broken = multipart.read(given, KIND)
        assert broken is None and values(found) == want
    assert multipart.read(body([]), KIND) == ([], None)
    quoted = multipart.read(body(parts, b"a b'(c)"), "Multipart/Form-Data; charset=x; Boundary=\"a b'(c)\"")
    assert values(quoted[0]) == want
    padded = body(parts).replace(b"--XyZ\r\n", b"--XyZ \t\r\n")
    assert values(multipart.read(padded, KIND)[0]) == want


@pytest.mark.parametrize("given, kind, error", [
    (None, KIND, "boundary"), (b"", KIND, "boundary"), (body([]), None, "boundary"), (body([]), "text/plain; boundary=XyZ", "boundary"), (body([]), "multipart/form-data", "boundary"), (body([]), "multipart/form-data; boundary=" + "x" * 71, "boundary"),
    (b"--XyZ\r\n", KIND, "truncated"), (b'--XyZ\r\nContent-Disposition: form-data; name="a"\r\n\r\nrest', KIND, "truncated"), (b"--XyZ\r\nno end of head\r\n--XyZ--", KIND, "header"), (b"--XyZ\r\n\r\n\r\nx\r\n--XyZ--", KIND, "header"),
    (b"--XyZ\r\nContent-Disposition: attachment; name=a\r\n\r\nx\r\n--XyZ--", KIND, "header"), (b"--XyZ\r\nX: " + b"h" * 20_000 + b"\r\n\r\nx\r\n--XyZ--", KIND, "header"), (body([("a", None, "", b"")] * 1001), KIND, "parts"),
])
def test_broken(given, kind, error):
    assert multipart.read(given, kind) == (None, error)


def test_names():
    head = lambda line: multipart._head(line.encode())
    assert head('Content-Disposition: form-data; name="a\\"b"; filename="C:\\\\dir\\\\x.png"') == ('a"b', "x.png", "text/plain")
    assert head("content-disposition:form-data;name=a;filename*=UTF-8''%C3%A9/t.gif\r\nCONTENT-TYPE: Image/GIF; q=1") == ("a", "t.gif", "image/gif")
    assert head('Content-Disposition: form-data;\r\n name="folded"; filename=""') == ("folded", "", "text/plain")


def test_fuzz():
    """Round trips of any bytes; a body cut anywhere or changed is read or told broken, in time that grows with its length."""
    rng = random.Random(1)
    for _ in range(300):
        parts = [(f"f{i}", rng.choice([None, "x.bin"]), "", bytes(rng.choices(b"\r\n-XyZ \0a", k=rng.randint(0, 40)))) for i in range(rng.randint(0, 5))]
        if any(b"\r\n--XyZ" in b"\r\n" + c + b"\r\n" for _, _, _, c in parts):
            continue
        whole = body(parts)
        assert [(n, f, c) for n, f, _, c in values(multipart.read(whole, KIND)[0])] == [(n, f, c) for n, f, _, c in parts]
        cut = whole[: rng.randrange(len(whole) - 4)]
        assert multipart.read(cut, KIND)[0] is None
        noise = bytearray(whole)
        for _ in range(3):
            noise[rng.randrange(len(noise))] = rng.choice(b"\r\n-XyZ:;=\"")
        multipart.read(bytes(noise), KIND)
    for piece in (b"\r\n--XyZZ", b"\r\n--XyZ \t ", b"\r\n", b"--XyZ"):
        assert multipart.read(body([("a", None, "", b"")], start=piece * 200_000 + b"\r\n"), KIND)[1] in (None, "header", "truncated")


def test_uploads(spark, monkeypatch):
    monkeypatch.setattr(multipart, "PHOTO_BYTES", 200)
    title = ("title", None, "", "Été".encode())
    cases = [
        (body([title, ("photo", "a/b.png", "image/png", PNG)]), "b.png", "image/png", None), (body([title, ("photo", "x", "image/gif", GIF)]), "x", "image/gif", None), (body([title, ("photo", "x", "image/avif", AVIF)]), "x", "image/avif", None),
        (body([title]), None, None, None), (body([title, ("photo", "", "application/octet-stream", b"")]), None, None, None), (body([title, ("photo", "x", "image/svg+xml", PNG)]), None, None, "type"), (body([title, ("photo", "x", "image/png", b"<svg/>")]), None, None, "type"),
        (body([title, ("file", "x", "image/png", PNG)]), None, None, "unexpected"), (body([("photo", "x", "image/png", PNG)] * 2), None, None, "unexpected"), (body([title, ("photo", "x", "image/png", PNG + b"y" * 200)]), None, None, "size"), (body([title])[:-6], None, None, "truncated"),
        (None, None, None, "boundary"), (body([title, ("title", None, "", b"last")]), None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0], KIND, "clash") for i, c in enumerate(cases)], "id int, body binary, contentType string, photo string")
    rows = multipart.uploads(df).orderBy("id").collect()
    for r, (_, name, kind, error) in zip(rows, cases, strict=True):
        photo = r["photo"]
        assert (r["error"], photo and photo["name"], photo and photo["type"]) == (error, name, kind), r["id"]
        assert (r["fields"] is None) == (error is not None)
    assert rows[0]["fields"] == {"title": "Été"} and rows[0]["photo"]["content"] == PNG and rows[12]["fields"] == {"title": "last"}
    assert multipart.uploads(df.limit(0)).where(F.lit(True)).count() == 0
