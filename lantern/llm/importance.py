"""Resampling a corpus towards a target by hashed n-gram importance weights.

Features are runs of one to three words, hashed into buckets. One pass counts the buckets of the corpus and of the target, one
row a bucket leaving each task; the logarithms of the two smoothed shares make an array of gains, by which a second pass scores
each text. Gumbel noise from the id's hash turns "the highest scores" into a draw without replacement by weight.

The draw is a merge of sorted runs. Each partition sorts its rows that can be drawn and leaves the run as blocks of packed rows. The
scores are cut into ranges of like size by approximate quantiles, which decide only the balance: rows of each range
are counted exactly, and the count tells at which rank a range begins and in which one the draw ends. The blocks of a range come to
a task in the order of their first rows, through Spark's external sort; a tournament tree holds one open block a run, takes in the
next one before a row of it could win, and emits ranks until the exact count is reached. So no task sees more than a range, and
ranges after the last are not read.

Defined results: a null or empty text, or one without words, has no features and weight 0; very long texts are read whole, in pieces;
rows without an id have no score and are neither drawn nor counted among those that can be; ties of a score go to the smaller id, then to
fewer features, then to the smaller weight; repeated rows are drawn one by one; empty tables give an empty result, and an empty target counts as no features; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import table, workspace, written

BUCKETS, ORDERS, LEAST_WORDS, SEED = 10_000, 3, 20, 42
#: The draw: so many of a hundred documents that are long enough.
SHARE = 5
#: Rows of a range, the most ranges (beyond, they grow), rows of a block.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, BLOCK_ROWS = 50_000, 8, 500, 4096
#: Bytes of text whose words are in memory at once.
PIECE = 1 << 20
#: Byte -> byte of a word in lower case, else a space: ASCII letters and digits and all that is not ASCII.
_WORDS = bytes(c if c >= 128 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
_COLUMNS = ["doc_id", "n_features", "weight", "score"]


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``PIECE`` bytes."""
    text = text.translate(_WORDS)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def buckets(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text, its number of words and the bucket of each feature that ends in it."""
    last: list[bytes] = []
    for words in pieces(text or b""):
        k, whole = len(last), last + words
        spaced = [b" " + w for w in whole]
        hashes = list(map(crc32, whole))
        found = hashes[k:]
        for order in range(1, ORDERS):
            # the hash of a run goes on from that of the run without its last word
            hashes = list(map(crc32, spaced[order:], hashes))
            found += hashes[max(0, k - order) :]
        yield len(words), np.array(found, dtype=np.int64) % BUCKETS
        last = whole[-(ORDERS - 1) :]


def counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, found in buckets(value.as_py()):
                    n += np.bincount(found, minlength=BUCKETS)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["bucket", "n"])

    found = texts.select(F.col(text).cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in found.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target to that in the corpus."""
    a, b = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (a + BUCKETS) / ((int(s) + 1) * (b + BUCKETS)))) for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def scored(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``eligible`` of every row of ``docs``."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col(id).cast("string")), 256), 1, 8), 16, 10).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, weights, scores, eligible = [], [], [], []
            for value, h in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                n_words = n = weight = 0
                for words, found in buckets(value.as_py()):
                    n_words, n, weight = n_words + words, n + len(found), weight + int(gain[found].sum())
                features.append(n)
                weights.append(weight)
                scores.append(None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
                eligible.append(h is not None and n_words >= LEAST_WORDS)
            arrays = [batch.column(0), pa.array(features, pa.int64()), pa.array(weights, pa.int64()), pa.array(scores, pa.int64()), pa.array(eligible, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*_COLUMNS, "eligible"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), noise.alias("h"))
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long, score long, eligible boolean")


class Tournament:
    """A tree of matches between open blocks; the least row of all is at its top.

    A row is ``(-score, doc_id, n_features, weight)``; a leaf holds the next row of its block.
    """

    def __init__(self) -> None:
        self.leaves = 1
        self.tree: list[tuple] = [(math.inf,)] * 2
        self.open: list[tuple[list[tuple], int] | None] = [None]
        self.free = [0]

    def _set(self, leaf: int, row: tuple) -> None:
        tree, i = self.tree, leaf + self.leaves
        tree[i] = row
        while i > 1:
            i >>= 1
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right

    def add(self, rows: list[tuple]) -> None:
        """Let a sorted block take part."""
        if not self.free:
            old, self.leaves = self.leaves, 2 * self.leaves
            heads = self.tree[old:]
            self.tree = [(math.inf,)] * (2 * self.leaves)
            self.open += [None] * old
            self.free = list(range(self.leaves - 1, old - 1, -1))
            for leaf, row in enumerate(heads):
                self._set(leaf, row)
        leaf = self.free.pop()
        self.open[leaf] = (rows, 0)
        self._set(leaf, (*rows[0], leaf))

    def least(self) -> tuple:
        return self.tree[1]

    def pop(self) -> tuple:
        """The least row, after which the next of its block takes its place."""
        *row, leaf = self.tree[1]
        rows, at = self.open[leaf]
        if at + 1 < len(rows):
            self.open[leaf] = (rows, at + 1)
            self._set(leaf, (*rows[at + 1], leaf))
        else:
            self.open[leaf] = None
            self.free.append(leaf)
            self._set(leaf, (math.inf,))
        return tuple(row)


def _range_of(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0 for scores from the highest of the ascending ``cuts`` on, 1 from the next, and so on."""
    return len(cuts) - np.searchsorted(cuts, score, side="right")


def runs(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Each partition of ``rows`` sorted and packed into blocks, none of which crosses a cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in _COLUMNS], axis=1).astype(np.int64)
            of = _range_of(data[:, 3], cuts)
            edges = np.flatnonzero(np.diff(of)) + 1
            parts = [p[i : i + BLOCK_ROWS] for p in np.split(data, edges) for i in range(0, len(p), BLOCK_ROWS)]
            first = np.array([p[0] for p in parts])
            arrays = [pa.array(_range_of(first[:, 3], cuts).astype(np.int64)), *(pa.array(first[:, i]) for i in (3, 0, 1, 2)), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["range", "score", "doc_id", "n_features", "weight", "block"])

    ordered = rows.select(*_COLUMNS).sortWithinPartitions(F.desc("score"), "doc_id", "n_features", "weight")
    return ordered.mapInArrow(run, "range long, score long, doc_id long, n_features long, weight long, block binary")


def merged(blocks: DataFrame, begins: list[int], drawn: int) -> DataFrame:
    """The rows of sorted ``blocks`` with their ranks up to ``drawn``; range r begins after rank ``begins[r]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        tree, at, rank = Tournament(), None, 0

        def take(before: tuple) -> None:
            nonlocal rank
            while rank < drawn and tree.least() < before:
                score, doc_id, n, weight = tree.pop()
                rank += 1
                out.append((doc_id, n, weight, -score, rank))

        def left() -> None:
            """What a range holds beyond the exact count, in no order."""
            for part in tree.open:
                if part:
                    out.extend((doc_id, n, weight, -score, None) for score, doc_id, n, weight in part[0][part[1] :])

        def packed() -> Iterator[pa.RecordBatch]:
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*_COLUMNS, "rank"])
            out.clear()

        end = (math.inf,)
        for batch in batches:
            for of, block in zip(batch.column(0).to_pylist(), batch.column(5), strict=True):
                if of != at:
                    take(end)
                    left()
                    tree, at, rank = Tournament(), of, begins[of]
                data = np.frombuffer(block.as_py(), dtype=np.int64).reshape(-1, 4)
                rows = list(zip((-data[:, 3]).tolist(), *(data[:, i].tolist() for i in (0, 1, 2)), strict=True))
                take(rows[0])
                if rank < drawn:
                    tree.add(rows)
                else:
                    out.extend((doc_id, n, weight, -score, None) for score, doc_id, n, weight in rows)
                if len(out) >= BLOCK_ROWS:
                    yield from packed()
        take(end)
        left()
        yield from packed()

    parts = blocks.repartition("range").sortWithinPartitions("range", F.desc("score"), "doc_id", "n_features", "weight")
    return parts.mapInArrow(run, "doc_id long, n_features long, weight long, score long, rank long")


def draw(rows: DataFrame, folder: str, share: int = SHARE) -> DataFrame:
    """``rows`` of ``scored`` with ``rank`` among the ``share`` of a hundred eligible ones drawn, else null."""
    rows = written(rows, folder, "scored")
    able = rows.where("eligible")
    drawn = able.count() * share // 100
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return rows.select(*_COLUMNS, none)
    n = min(MOST_RANGES, max(LEAST_RANGES, drawn // RANGE_ROWS))
    # ranges up to the draw's end by share, and some beyond, should the quantiles be a little off
    fractions = [1 - share / 100 * (i + 1) / n for i in range(n)] + [max(0.0, 1 - share / 100 * x) for x in (1.1, 1.5, 2, 4)]
    found = able.agg(F.percentile_approx("score", fractions, 5_000 * n // share).alias("cuts")).first()["cuts"]
    cuts = np.array(sorted(set(found)), dtype=np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(cuts) + 1, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(_range_of(np.asarray(batch.column(0)), cuts), minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["range", "n"])

    sizes = {r["range"]: r["n"] for r in able.select("score").mapInArrow(tally, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect()}
    begins = [0]
    while begins[-1] < drawn:
        begins.append(begins[-1] + sizes.get(len(begins) - 1, 0))
    last = len(begins) - 2  # the range in which the draw ends
    lowest = int(cuts[len(cuts) - 1 - last]) if last < len(cuts) else None
    inside = F.col("eligible") & (F.lit(True) if lowest is None else F.col("score") >= lowest)
    blocks = written(runs(rows.where(inside), cuts), folder, "runs")
    return merged(blocks, begins, drawn).unionByName(rows.where(~inside).select(*_COLUMNS, none))


def resample(docs: DataFrame, target: DataFrame, folder: str, id: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """Weights, scores and ranks of ``docs``, drawn towards ``target``; both have a column ``text``."""
    return draw(scored(docs, gains(counts(docs, text), counts(target, text)), id, text), folder, share)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, of which a twentieth is drawn towards ``benchmark``."""
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"), workspace(spark))
