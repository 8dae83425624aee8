"""Quality rules: base counts, and hashed n-gram log-likelihood ratios between a trusted target and the raw corpus.

Every text's runs of ``GRAM`` bytes are hashed into ``BUCKETS`` buckets. One pass counts the buckets over all
documents (the raw multinomial) and over trusted ones (the target); tasks send one row per bucket, and the
table of log ratios, of fixed size, goes to the tasks of a second pass, where a document's verdict is the
mean log ratio of its runs against a threshold. The ratio of a bucket is (target count + M) / (count expected
from the raw share + M), so buckets with little evidence are near 1. The threshold parts kept-out trusted
documents from marked junk, a lost good document costing ``CARE`` times a kept bad one by share; there is no
draw: equal texts get equal verdicts.

The raw counts are over all documents, those of the target over all documents of quality 1 but for a third that is kept
out, both over whole texts. The threshold comes from all kept-out documents and all of quality 0: their scores are counted by
value, in bins of which each is summed by itself. Ids of labelled rows are broadcast up to ``BROADCAST_ROWS`` of them.

Defined results: a null or empty text has no words and fails the base rules; a text without a run has score
0; a very long text is counted whole, by itself; without labels of both kinds nothing is dropped beyond the base
rules; of labels of one document that differ the lower counts; of thresholds that tie the lowest is taken; repeated rows give repeated
results and count as often, but once for the threshold; a document without an id has no label; an empty table gives an
empty result; columns of the input with the names of the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.common import remove, ship, small_or_plain, table, workspace, written

GRAM, BUCKETS, M, CARE = 4, 1 << 16, 4.0, 20.0
#: Scores, which have six decimals, are counted in bins of a thousandth; there are fewer bins than 100,000, as the logarithms of counts are small.
BIN = 1_000
#: Labelled ids up to which their table (some 20 bytes a row) is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000
#: The base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SLICE_ROWS, SLICE_BYTES = 512, 4_000_000
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of bounded size, each with the bytes of its texts and their offsets."""
    texts = pc.fill_null(batch.column(column), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1))
        yield batch.slice(start, stop - start), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the run of ``GRAM`` bytes at each place of ``data`` that has one."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    runs = np.zeros(n, np.uint32)
    for i in range(GRAM):
        runs |= data[i : i + n].astype(np.uint32) << np.uint32(8 * i)
    return ((runs * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places begin a run that lies within one text."""
    ok = np.ones(n, bool)
    for i in range(1, GRAM):
        at = offsets[1:-1] - i
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def base_counts(text: str) -> list[int]:
    raw = text.encode()
    words = raw.split()
    white = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return [len(words), len(text) - white, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that the text has more than once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)).view(np.uint64)
    both = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        both = both * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
        both ^= both >> np.uint64(29)
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    if not same.any():
        return 0
    alike = np.zeros(n, bool)
    alike[order[1:][same]] = True
    alike[order[:-1][same]] = True
    # equal hashes are only a hint: the words themselves decide
    at = np.flatnonzero(alike)
    _, kind, times = np.unique(np.stack([own[at + i] for i in range(WINDOW)], axis=1), axis=0, return_inverse=True, return_counts=True)
    at = at[times[kind.ravel()] > 1]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


@dataclass(frozen=True)
class Ratios:
    """Log ratios by bucket, as bytes of 32-bit floats, and the least mean that is kept."""

    table: bytes
    least: float = float("-inf")

    def means(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        places = buckets(data)
        values = np.where(inside(offsets, len(places)), np.frombuffer(self.table, np.float32)[places], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        runs = np.maximum(0, np.diff(offsets) - GRAM + 1)
        ends = np.minimum(offsets[:-1] + runs, len(places))
        # rounded, as equal texts at other places of a batch differ in the last bits of a running sum
        return np.round((sums[ends] - sums[np.minimum(offsets[:-1], len(places))]) / np.maximum(1, runs), 6)


def marked(labels: DataFrame, id: str) -> DataFrame:
    """Ids of all labelled rows, and which are of the target (``_trusted``); the others set the threshold."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(F.min("quality").alias("_quality"))
    return known.withColumn("_trusted", (F.col("_quality") == 1) & (F.pmod(F.xxhash64(F.lit(4), F.col("_id")), F.lit(3)) != 0))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> Ratios:
    """Count all ``docs`` and those that ``labels`` (``id``, ``quality``) trusts; set the threshold on the other labelled ones."""
    spark = docs.sparkSession
    ship(spark)
    folder = workspace(spark)
    known = written(marked(labels, id), folder, "marked")
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    trusted = F.col("_trusted")
    all_rows, rows = rows, rows.join(small_or_plain(known, BROADCAST_ROWS), "_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part, data, offsets in slices(batch, 0):
                places = buckets(data)
                ok = inside(offsets, len(places))
                raw += np.bincount(places[ok], minlength=BUCKETS)
                marked = np.array(part.column(1).to_pylist(), bool)
                if marked.any():
                    ok &= np.repeat(marked, np.diff(offsets))[: len(places)]
                    target += np.bincount(places[ok], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    counted = rows.select("_text", F.coalesce(trusted, F.lit(False)).alias("_trusted")).mapInArrow(count, "bucket int, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in sums:
        raw[b], target[b] = r, t
    ratios = Ratios(np.log((target + M) / (raw * (target.sum() / max(1.0, raw.sum())) + M)).astype(np.float32).tobytes())
    others = small_or_plain(known.where("NOT _trusted").select("_id", "_quality"), BROADCAST_ROWS)
    tried = score(all_rows.join(others, "_id").select("_id", "_quality", F.col("_text").alias("text")), ratios).where(~base_failed())
    found = tried.groupBy("_id").agg(F.first("_quality").alias("quality"), F.min("score").alias("score"))
    least = threshold(written(found.groupBy("score").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")), folder, "scores"))
    remove(spark, folder)
    return Ratios(ratios.table, least)


def threshold(scores: DataFrame) -> float:
    """The value between scores (``score, good, bad``: how many have each) that costs least; at equal costs the lowest."""
    binned = scores.withColumn("bin", F.floor(F.col("score") * BIN))
    bins = binned.groupBy("bin").agg(F.sum("good").alias("bin_good"), F.sum("bad").alias("bin_bad"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    before = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0))
    bins = bins.select("bin", before("bin_good", below).alias("good_before"), before("bin_bad", below).alias("bad_before"))
    all_good, all_bad = scores.agg(F.sum("good"), F.sum("bad")).first()
    if not all_good or not all_bad:
        return float("-inf")
    within = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lost = (F.col("good_before") + before("good", within)) / F.lit(float(all_good))
    kept = 1 - (F.col("bad_before") + before("bad", within)) / F.lit(float(all_bad))
    best = binned.join(bins, "bin").select("score", (CARE * lost + kept).alias("cost")).agg(F.min(F.struct("cost", "score"))).first()[0]["score"]
    lower = scores.where(F.col("score") < best).agg(F.max("score")).first()[0]
    return best - 1 if lower is None else (best + lower) / 2


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def score(df: DataFrame, ratios: Ratios, text: str = "text", with_text: bool = False) -> DataFrame:
    """``df`` with the base counts and ``score``, the mean log ratio of each whole text; the text only if asked for."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in (*BASE, "score", text)]
    kept = [*keep, text] if with_text else keep
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, len(keep)):
                counts = [base_counts(x or "") for x in part.column(len(keep)).to_pylist()]
                columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns, pa.array(ratios.means(data, offsets))], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def judge(df: DataFrame, ratios: Ratios, text: str = "text", with_text: bool = False) -> DataFrame:
    """``score`` with ``base_failed`` and ``kept``."""
    scored = score(df.drop("base_failed", "kept"), ratios, text, with_text).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(ratios.least)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all ``documents``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ratios = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judge(docs, ratios).select("doc_id", *BASE, "base_failed", "kept", "score")
