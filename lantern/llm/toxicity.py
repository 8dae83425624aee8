"""Toxicity by compression distance to two zstandard dictionaries.

Fitting, from a bounded sample of labelled rows: zstandard's trainer makes a dictionary of segments of ordinary texts,
and one of segments of each half of the toxic texts. A word of both halves that either half's dictionary, beside the ordinary
one, compresses to fewer bytes than the ordinary one alone is a toxic word, if it is not as frequent in ordinary texts: what a
dictionary merely has by heart from its own half does not help with the other. The toxic dictionary is the ordinary one with the toxic words after it, so that the two compress
all but toxic text alike; in further rounds both get those ordinary words that the toxic one still compresses better.

Calibration: a third of the sample is kept out of the dictionaries. These texts, of any length, are compressed whole, in
tasks. The ordinary ones tell the gain that a window has by chance and its spread, and the threshold is what parts both labels best.

Scoring: windows are single words (longer ones in overlapping pieces) between two fixed runs of bytes that
both dictionaries hold, without which the format would store so short an input, or its last bytes, as it
is. The gain of a window is the difference d of its two compressed lengths, if it is ``SAVED`` or more, taken as d * d / length.
The distance of a text is the sum of the gains of all its windows, less what so many windows of ordinary text have, in
units of their spread; its score is a logistic function of that. Each distinct window is compressed once a task, in a table of
bounded size.

Defined results: a null or empty text has no windows and distance 0; a very long text is judged whole; a sample
without both labels, or without any toxic word, gives every text a low score; labels of one document that
differ count as toxic, null labels do not count; a document without an id is not held out and has no label; of
rows of one id the first text by code point counts for fitting, that of the largest gain for calibration; of thresholds that tie
the middle one is taken; repeated rows give repeated results; an empty table gives an empty result; columns of the input
with the names of the outputs are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.common import remove, table, workspace, written

#: The bound of the sample: documents of each label, and bytes of a document that the dictionaries are fitted on.
TOXIC_DOCS, ORDINARY_DOCS, DOC_BYTES = 1_500, 3_000, 16_000
SEGMENT, ROUNDS, DICTIONARY_BYTES, TOXIC_WORDS, HARD_WORDS = 6, 2, 110_000, 800, 6_000
#: Bytes that a toxic word must save with the dictionary of either half, toxic texts that must have it, and times by which
#: it must be more frequent in them than in ordinary ones.
SAVED, TEXTS, RATIO = 2, 4, 20
#: Bytes of a window beyond which a word is cut, and how far its pieces lie apart.
PIECE, STEP = 32, 16
#: The predicted label is 1 from this score on.
THRESHOLD, STEEPNESS = 0.7, 1.0
#: Misses that a false alarm counts as: what is reported is deleted.
CARE = 3
#: The threshold's distance where nothing can be calibrated; windows that steady the spread of short texts; the least spread.
LOW, STEADY, LEAST_SPREAD = 4.0, 50, 0.001
TABLE_WINDOWS = 250_000
SLICE_ROWS = 512
#: Runs of control bytes, which no window has, before and after each window.
BEFORE = bytes([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 127, 1, 5, 9, 11, 12])
AFTER = bytes([14, 2, 26, 5, 127, 3, 11, 17, 4, 25])
#: ASCII punctuation and control bytes separate windows, as white space does.
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def windows(text: str) -> list[bytes]:
    words = text.lower().encode().translate(_SPACES).split()
    if all(len(w) <= PIECE for w in words):
        return words
    return [p for w in words for p in ([w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE + STEP, STEP)])]


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries, the distance at which the score is ``THRESHOLD``, gain and variance of a window of ordinary text."""

    ordinary: bytes
    toxic: bytes
    cut: float = LOW
    rate: float = 0.0
    spread: float = LEAST_SPREAD

    def distance(self, gain: float, n: int) -> float:
        """Of a text of ``n`` windows with that ``gain`` in all."""
        return (gain - self.rate * n) / math.sqrt(self.spread * (n + STEADY))

    def score(self, gain: float, n: int) -> float:
        x = STEEPNESS * (self.distance(gain, n) - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


class Gains:
    """Window -> gain, for the windows seen by a task."""

    def __init__(self, model: Model):
        import zstandard

        self.seen: dict[bytes, float] = {}
        self.both = []
        for content in (model.ordinary, model.toxic):
            held = zstandard.ZstdCompressionDict(content + BEFORE + AFTER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(
                min_match=3, strategy=zstandard.STRATEGY_BTOPT, hash_log=17, chain_log=17, window_log=19, search_log=6, target_length=64,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            held.precompute_compress(compression_params=how)
            self.both.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress)
        self.alike = model.ordinary == model.toxic

    def saved(self, window: bytes) -> int:
        framed = BEFORE + b" " + window + b" " + AFTER
        return len(self.both[0](framed)) - len(self.both[1](framed))

    def of(self, window: bytes) -> float:
        gain = self.seen.get(window)
        if gain is None:
            saved = self.saved(window)
            gain = saved * saved / (len(window) + 2) if saved >= SAVED else 0.0
            # a full table keeps what came first: frequent windows are among it
            if len(self.seen) < TABLE_WINDOWS:
                self.seen[window] = gain
        return gain

    def whole(self, text: str | None) -> tuple[float, int]:
        """The gain of all windows of a text, and how many there are."""
        found = windows(text or "")
        # summed in one order, so that equal texts are exactly equal
        return (0.0 if self.alike else math.fsum(n * self.of(w) for w, n in Counter(found).items())), len(found)


def trained(texts: list[str]) -> bytes:
    """A dictionary that zstandard's trainer makes of segments of ``SEGMENT`` words; of too few, the segments themselves."""
    import zstandard

    samples = []
    for t in texts:
        w = windows(t)
        samples += [b" " + b" ".join(w[i : i + SEGMENT]) + b" " for i in range(0, len(w), SEGMENT)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _single(texts: list[str]) -> list[str]:
    """One text of those with the same two least hashed words: copies must not make a word look common."""
    return list({tuple(sorted({zlib.crc32(w) for w in windows(t)})[:2]): t for t in reversed(texts)}.values())[::-1]


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """A model, not yet calibrated, from texts of each label, in an order that does not depend on them."""
    low = Model(b"", b"")
    a, b = _single(toxic), _single(ordinary)
    if not a or not b:
        return low
    in_toxic, in_ordinary = (Counter(w for t in part for w in set(windows(t))) for part in (a, b))
    base = trained(b)
    halves = [[t for i, t in enumerate(a) if i % 2 == k] for k in (0, 1)]
    shared = set.intersection(*(set(w for t in half for w in windows(t)) for half in halves))
    beside = [Gains(Model(base, base + trained(half))) for half in halves]
    often = lambda w: in_toxic[w] >= TEXTS and in_toxic[w] * len(b) >= RATIO * in_ordinary[w] * len(a)
    named = [w for w in shared if often(w) and all(g.saved(w) >= SAVED for g in beside)]
    if not named:
        return low
    named = sorted(named, key=lambda w: (in_toxic[w], w))[-TOXIC_WORDS:]
    spaced = lambda words: b" " + b" ".join(words) + b" "
    hard: list[bytes] = []
    model = Model(base, base + spaced(named))
    for _ in range(ROUNDS):
        found = Gains(model)
        saved = {w: found.saved(w) for w in in_ordinary}
        more = sorted((w for w in saved if saved[w] >= SAVED), key=lambda w: (-saved[w], w))[:HARD_WORDS]
        hard += more
        model = Model(base + spaced(hard), base + spaced(hard) + spaced(named))
    return model


def calibrated(model: Model, toxic: list[tuple[float, int]], ordinary: list[tuple[float, int]]) -> Model:
    """``model`` with what gains and numbers of windows of kept-out texts tell; a false alarm counts as ``CARE`` misses, by share."""
    rate = sum(g for g, _ in ordinary) / max(1, sum(n for _, n in ordinary))
    spread = sum((g - rate * n) ** 2 / (n + 1) for g, n in ordinary) / max(1, len(ordinary))
    model = replace(model, rate=rate, spread=max(LEAST_SPREAD, spread))
    high, low = (sorted(model.distance(*x) for x in part) for part in (toxic, ordinary))
    values = sorted({0.0, *high, *low})
    middles = [(x + y) / 2 for x, y in zip(values, values[1:], strict=False) if x >= 0] or [LOW]
    wrong = lambda c: sum(x < c for x in high) / max(1, len(high)) + CARE * sum(x >= c for x in low) / max(1, len(low))
    least = min(wrong(c) for c in middles)
    good = [c for c in middles if wrong(c) == least]
    return replace(model, cut=good[len(good) // 2])


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> Model:
    """Fit on those ``docs`` that ``labels`` (``id``, ``toxic``) marks: the first of each label in a hashed order.

    Two thirds of them, one text an id and of at most ``DOC_BYTES``, reach the driver for the dictionaries; of the
    others only their gains do.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(5), F.col("_id")), F.col("_id")]
    some = lambda t, n: known.where(F.col("toxic") == t).orderBy(*order).limit(n)
    out = (F.pmod(F.xxhash64(F.lit(6), F.col("_id")), F.lit(3)) == 0).alias("_out")
    folder = workspace(spark)
    chosen = written(some(1, TOXIC_DOCS).unionAll(some(0, ORDINARY_DOCS)).select("_id", "toxic", out), folder, "chosen")
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    of = lambda part: rows.join(F.broadcast(chosen.where(part)), "_id")  # noqa: E731  bounded by the two limits
    fits = of("NOT _out").where(F.octet_length("_text") <= DOC_BYTES).groupBy("_id").agg(F.first("toxic").alias("toxic"), F.min("_text").alias("_text"))
    found = sorted((str(r["_id"]), r["toxic"], r["_text"]) for r in fits.collect())
    model = fit([t for _, y, t in found if y == 1], [t for _, y, t in found if y == 0])
    tried = gains(of("_out"), model, "_text").groupBy("_id").agg(F.first("toxic").alias("toxic"), F.max(F.struct("gain", "windows")).alias("x")).collect()
    remove(spark, folder)
    return calibrated(model, *([tuple(r["x"]) for r in tried if r["toxic"] == t] for t in (1, 0)))


def gains(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``gain``, of all windows of each whole text, and ``windows``, their number."""
    keep = [c for c in df.columns if c not in ("gain", "windows")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("gain", T.DoubleType()), T.StructField("windows", T.LongType())])
    where = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Gains(model).whole
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = [whole(x.as_py()) for x in part.column(where)]
                columns = [pa.array([g for g, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text."""
    keep = [c for c in df.columns if c != out]
    # the caller's columns stay together, so that no name of theirs meets one of these
    found = gains(df.select(F.struct(*keep).alias("row"), F.col(text).alias("text")), model).select("row.*", F.struct("gain", "windows").alias(out))
    gain, n = F.col(f"{out}.gain"), F.col(f"{out}.windows")
    distance = (gain - F.lit(model.rate) * n) / F.sqrt(F.lit(model.spread) * (n + F.lit(STEADY)))
    x = STEEPNESS * (distance - F.lit(model.cut)) + F.lit(math.log(THRESHOLD / (1 - THRESHOLD)))
    return found.withColumn(out, 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x)))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from labels of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(F.col("doc_id"))))
    scored = score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
