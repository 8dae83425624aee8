"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if, of its inner s-mers, the first or the last has the smallest hash.
That depends on the k-mer alone, so a passage has the same anchors wherever it stands, and any change
moves only the anchors that overlap it; of 2 * K - S - 1 characters in a row at least one k-mer is an anchor. The fingerprint
of a text is all of its anchors in text order, each with its position and its 64-bit hash: it grows with the text, so that
a shared passage is found in texts of any length. A text that has no anchor, being too short or unlucky, is one anchor
itself, at position 0. Spelled, an anchor is the distance to the one before (7 bits a byte, the highest bit
telling that more follow) and 8 bytes of hash, all in base64.

Matching is positional. Equal hashes of two fingerprints are paired, a repeated one by its turns; a pair counts if
another pair has the same distance between its positions, or if a text has no other anchor. ``likeness`` is the share
of anchors of both texts that are in such pairs.

``with_next`` gives each row the following row in an order over the whole table, without sorting it into
one task: quantiles of the ids cut the table into buckets, an id (or the null) of more rows than a bucket is to have is cut
further by hashes of its texts, each bucket's first row is dealt to the bucket before as well, and each
bucket is sorted by itself. The driver sees only ids and hashes, a few for each bucket.

Defined results: a null text is an empty one; an empty text has an empty fingerprint, like only to another
empty one (likeness 1, else 0); a very long text is fingerprinted whole, by itself; rows of equal id (ties) follow
each other by a hash of the text, then by text; repeated rows follow each other, and copies of one row are not cut further;
rows of null id come last in the order; a single row is followed by itself; an empty table gives an empty
result; other columns of the input play no part, whatever their names, and ``fingerprint`` replaces one of its output's name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import table, workspace, written

#: Code points of a k-mer and of its inner s-mers (powers of two).
K, S = 32, 16
#: Buckets for each shuffle partition of the session.
BUCKETS_EACH = 2
#: Rows and characters that are fingerprinted at once.
GROUP_ROWS, GROUP_CHARS = 64, 400_000

_ODD, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _runs(points: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each run of ``size`` (a power of two) code points, by doubling."""
    h, step, power = _mixed(points.astype(np.uint64) + np.uint64(1)), 1, _ODD
    while step < size and len(h) > step:
        h = h[:-step] + np.uint64(power) * h[step:]
        step, power = step * 2, power * power & _ALL
    return _mixed(h) if step == size else h[:0]


def anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and 64-bit hashes of all of each text's anchors, in text order."""
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts]
    every = np.concatenate(points) if points else np.zeros(0, np.uint32)
    ends = np.cumsum([len(p) for p in points])
    starts = ends - [len(p) for p in points]
    inner, outer = _runs(every, S), _runs(every, K)
    least, width = inner, 1
    while width * 2 <= K - S + 1:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < K - S + 1:
        more = K - S + 1 - width
        least = np.minimum(least[:-more], least[more:])
    n = len(outer)
    at = np.flatnonzero((inner[:n] == least[:n]) | (inner[K - S : K - S + n] == least[:n]))
    doc = np.searchsorted(ends, at, side="right")
    inside = at + K <= ends[doc] if len(at) else np.zeros(0, bool)
    at, doc = at[inside], doc[inside]
    hashes = outer[at]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    found = []
    for i, text in enumerate(texts):
        p, h = at[cuts[i] : cuts[i + 1]] - starts[i], hashes[cuts[i] : cuts[i + 1]]
        if not len(p) and text:
            p, h = np.zeros(1, np.int64), np.frombuffer(hashlib.sha256(text.encode()).digest()[:8], np.uint64)
        found.append((p, h))
    return found


def spelled(anchor: tuple[np.ndarray, np.ndarray]) -> str:
    places, hashes = anchor
    steps = np.diff(places, prepend=0)
    if (steps < 128).all():
        out = np.empty((len(steps), 9), np.uint8)
        out[:, 0] = steps
        out[:, 1:] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        return base64.b64encode(out.tobytes()).decode()
    parts = []
    for step, own in zip(steps.tolist(), hashes.astype(">u8").tobytes().hex(" ", 8).split(" "), strict=True):
        while step >= 128:
            parts.append(bytes([step & 127 | 128]))
            step >>= 7
        parts.append(bytes([step]) + bytes.fromhex(own))
    return base64.b64encode(b"".join(parts)).decode()


def unspelled(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data, at, place = base64.b64decode(fingerprint), 0, 0
    places, hashes = [], []
    while at < len(data):
        shift = 0
        while data[at] & 128:
            place += (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
        place += data[at] << shift
        places.append(place)
        hashes.append(data[at + 1 : at + 9])
        at += 9
    return np.array(places, np.int64), np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)


def paired(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors that two texts have in common at consistent distances, each in one pair."""

    def turns(anchor: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(anchor[1], kind="stable")
        h = anchor[1][order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        n = np.arange(len(h))
        return anchor[0][order], h, n - np.maximum.accumulate(np.where(first, n, 0))

    (p, g, i), (q, h, j) = turns(a), turns(b)
    if not len(g) or not len(h):
        return p[:0], q[:0]
    # how often a text has each hash of the other tells which turns have a partner, and where
    low = np.searchsorted(h, g)
    met = i < np.searchsorted(h, g, side="right") - low
    x, y = p[met], q[(low + i)[met]]
    _, kind, n = np.unique(y - x, return_inverse=True, return_counts=True)
    good = (n[kind] > 1) | (min(len(p), len(q)) == 1)
    order = np.argsort(x[good])
    return x[good][order], y[good][order]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the anchors of both texts that are paired."""
    n = len(a[0]) + len(b[0])
    return 2 * len(paired(a, b)[0]) / n if n else 1.0


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """The positions of ``paired`` of two spelled fingerprints."""
    x, y = paired(unspelled(a), unspelled(b))
    return list(zip(x.tolist(), y.tolist(), strict=True))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text."""

    @F.pandas_udf("string")
    def run(column):
        values = ["" if x is None else x for x in column]
        return column.__class__([spelled(a) for part in grouped(values) for a in anchors(part)])

    return df.withColumn(out, run(F.col(text)))


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts to be fingerprinted at once."""
    part, size = [], 0
    for x in texts:
        if part and (len(part) >= GROUP_ROWS or size + len(x) > GROUP_CHARS):
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def _above(values: list[int], id: Column) -> Column:
    """How many of the falling ``values`` are at or above ``id``."""
    wide = max(1, int(len(values) ** 0.5))
    parts = [values[i : i + wide] for i in range(0, len(values), wide)]
    above = lambda numbers: F.size(F.filter(numbers, lambda b: b >= id))
    if not parts:
        return F.lit(0)
    numbers = lambda x: F.array(*(F.lit(b).cast("long") for b in x))
    passed = above(numbers([p[-1] for p in parts]))
    fine = F.get(F.array(*map(numbers, parts)), passed)
    return F.when(passed < len(parts), passed * wide + above(fine)).otherwise(len(values))


def _bucket(rows: DataFrame, count: int) -> tuple[Column, int]:
    """The bucket of a row of ``id, hash`` in falling order of ids, then of rising hashes; and how many there are."""
    cuts = rows.approxQuantile("id", [i / count for i in range(1, count)], 1 / (4 * count)) if count > 1 else []
    # at most ``count`` ids have more rows than a bucket is to have
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    share = rows.count() / count
    hot = {x["id"]: -(-x["n"] // max(1, int(share))) for x in ids.where(F.col("n") > 2 * share).collect()}
    known = [i for i in hot if i is not None]
    # a hot id has a bucket of its own: one bound parts it from those above, one from those below
    bounds = sorted({int(x) for x in cuts} | {x for i in known for x in (i, i - 1) if x >= -(1 << 63)}, reverse=True)
    parts = [1] * (len(bounds) + 2)
    for i in known:
        parts[sum(b >= i for b in bounds)] = hot[i]
    parts[-1] = hot.get(None, 1)
    first = list(itertools.accumulate(parts, initial=0))
    own = F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(_above(bounds, F.col("id"))).cast("int")
    table = lambda x: F.array(*map(F.lit, x))
    n = F.get(table(parts), own)
    # the hash's place among all 64-bit numbers
    turn = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * n)
    return (F.get(table(first[:-1]), own) + F.least(n - 1, F.greatest(F.lit(0), turn))).cast("int"), first[-1]


def dealt(df: DataFrame, id: str, text: str) -> DataFrame:
    """Partitions of ``id, text, ahead`` in falling order of ids; a row ``ahead`` follows the last one."""
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    count = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = written(rows.select("id", "hash"), workspace(spark), "keys")
    bucket, total = _bucket(keys, count)
    place = F.struct("id", (-F.col("hash").cast("decimal(20,0)")).alias("hash"))
    heads = {x["bucket"]: x["head"] for x in keys.groupBy(bucket.alias("bucket")).agg(F.max(place).alias("head")).collect()}
    order = sorted(heads)
    turns = [(b, heads[b]["id"], -int(heads[b]["hash"]), order[i - 1]) for i, b in enumerate(order)]
    known = F.broadcast(spark.createDataFrame(turns, "bucket int, first long, least long, before int"))  # one row a bucket
    rows = rows.withColumn("bucket", bucket).join(known, "bucket", "left")
    own, ahead = (F.struct(F.col(b).alias("to"), F.lit(a).alias("ahead")) for b, a in (("bucket", False), ("before", True)))
    head = F.col("id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("least"))
    rows = rows.select("id", "hash", "text", F.explode(F.when(head, F.array(own, ahead)).otherwise(F.array(own))).alias("place")).select("id", "hash", "text", "place.*")
    rows = rows.repartitionById(total, F.col("to"))
    return rows.sortWithinPartitions("ahead", F.col("id").desc_nulls_last(), "hash", "text").select("id", "text", "ahead")


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """Each own row of a partition of ``dealt``, with the text of the row after it."""
    rows = ((i.as_py(), t.as_py() or "", a.as_py()) for b in batches for i, t, a in zip(*b.columns, strict=True))
    for (id, text, ahead), (_, after, _) in itertools.pairwise(rows):
        if not ahead:
            yield id, text, after


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def compared(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprints of its text and of its edited text, and their likeness; likeness to the next text."""
    schema = f"{id} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
            texts, changed = [t for _, t, _ in rows], [edited(t, a) for _, t, a in rows]
            whole = anchors([*texts, rows[-1][2], *changed])
            own, new = whole[: len(rows) + 1], whole[len(rows) + 1 :]
            columns = [
                [i for i, _, _ in rows],
                [len(t) for t in texts],
                [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                [spelled(a) for a in own[:-1]],
                [spelled(a) for a in new],
                [likeness(a, b) for a, b in zip(own, new, strict=False)],
                [likeness(a, b) for a, b in itertools.pairwise(own)],
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        rows, size = [], 0
        for row in with_next(batches):
            if rows and (len(rows) >= GROUP_ROWS or size + len(row[1]) > GROUP_CHARS):
                yield part(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[1])
        if rows:
            yield part(rows)

    return dealt(df, id, text).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return compared(table(spark, sf_dir, "documents", "doc_id", "text"))
