"""Nearest neighbours by inner product, with randomly rotated one-bit codes.

Every vector is rotated by a seeded random rotation (three rounds of sign flips and a Walsh-Hadamard transform over the next power of
two) and kept as the signs of its rotated components, packed in bits, with two scalars: its length, and how well the signs
point along it. From these the inner product with any query is estimated without bias, with a bound that
the error keeps with a known probability. A block of vectors is searched for a block of queries in one product of signs and rotated
queries. The vectors with the best lower bounds are scored exactly and give the threshold; all whose upper bound reaches it are scored
as well, on the original vectors in double precision, and none else is.

The queries are a stated set, searched against all rows in blocks: vectors are dealt into stripes, queries into bands, and a
task gets one band and several stripes, one after the other, whose best neighbours so far prune the later ones. Copies of a vector
are one vector with its smallest ids, of which no query needs more than its neighbours and one for itself; copies of a query are one query. So a group of copies of any
size costs one row. Nothing is broadcast but the rotation's seed.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take no part, nor do rows without an id;
a vector meets only vectors of as many components; copies have equal scores, ties go to the smaller id; repeated rows count once, and of
different vectors of one id the least; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm.common import table, workspace, written

#: Every so-manieth id is a query; neighbours of each.
EVERY, K = 20, 20
#: Standard deviations of an estimate that its bound covers.
BOUND = 2.5
SEED, ROUNDS = 7, 3
#: Bytes of original vectors in a stripe, and stripes that a task searches one after the other.
STRIPE_BYTES, STRIPES = 2_000_000, 8
#: Bytes of queries in a band: a share of them, within these bounds.
LEAST_BAND, BAND_BYTES, BANDS = 200_000, 8_000_000, 8
#: Queries whose estimates are in memory at once.
SLICE = 128


def rotated(x: np.ndarray) -> np.ndarray:
    """The rows of ``x``, padded to a power of two, under the random rotation for their number of components."""
    n, d = x.shape
    size = max(8, 1 << (d - 1).bit_length())
    signs = np.random.Generator(np.random.PCG64([SEED, d])).integers(0, 2, (ROUNDS, size)) * 2.0 - 1
    out = np.zeros((n, size))
    out[:, :d] = x
    for s in signs:
        out *= s
        h = 1
        while h < size:
            parts = out.reshape(n, size // (2 * h), 2, h)
            out = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(n, size)
            h *= 2
        out /= np.sqrt(size)
    return out


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated rows of ``x``, and of each row the scale and the bound of its estimates.

    With the length r of a row and the cosine c between its rotated form and its signs, the inner product with a query is
    estimated as r / c times that of the signs' unit vector; the error is about r * sqrt(1 / c**2 - 1) / sqrt(size - 1) times the query's length.
    """
    z = rotated(x)
    size = z.shape[1]
    length = np.sqrt((z * z).sum(axis=1))
    cosine = np.abs(z).sum(axis=1) / (np.sqrt(size) * length)
    scalars = np.stack([length / cosine / np.sqrt(size), length * np.sqrt(np.maximum(0, 1 / cosine**2 - 1) / (size - 1))], axis=1)
    return np.packbits(z > 0, axis=1), scalars


def estimated(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Estimates of the inner products of ``queries`` (already rotated) with the vectors behind ``codes``, a row a query."""
    signs = np.unpackbits(codes, axis=1, count=queries.shape[1]).astype(np.float32) * 2 - 1
    return (queries.astype(np.float32) @ signs.T) * scalars[:, 0].astype(np.float32)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for a vector wherever it stands."""
    return (vectors * query).sum(axis=1)


def candidates(codes: np.ndarray, scalars: np.ndarray, vectors: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and the indexes and exact scores of vectors that can be among the ``k`` best and reach ``least``."""
    turned = rotated(queries)
    lengths = np.sqrt((queries * queries).sum(axis=1))
    for start in range(0, len(queries), SLICE):
        values = estimated(codes, scalars, turned[start : start + SLICE])
        error = BOUND * np.outer(lengths[start : start + SLICE], scalars[:, 1])
        floors = least[start : start + SLICE].copy()
        fresh = np.flatnonzero(np.isneginf(floors)) if len(vectors) > k else []
        for i in fresh:
            # no threshold yet: the k vectors that are surest to be near give one
            best = np.argpartition(error[i] - values[i], k - 1)[:k]
            floors[i] = exact(vectors[best], queries[start + i]).min()
        hopeful = values + error >= floors[:, None]
        for i in range(len(values)):
            index = np.flatnonzero(hopeful[i])
            scores = exact(vectors[index], queries[start + i])
            if len(index) > k:
                # all that tie with the k-th stay, as their ids decide
                floors[i] = max(floors[i], np.partition(scores, len(scores) - k)[len(scores) - k])
            keep = scores >= floors[i]
            yield start + i, index[keep], scores[keep]


def takes_part(vector: Column) -> Column:
    numbers = vector.cast("array<double>")
    bad = F.exists(numbers, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(numbers, lambda v: v != 0), F.lit(False))


def distinct(vectors: DataFrame, ids: int) -> DataFrame:
    """``vector`` and ``ids``, its ``ids`` smallest ones; each task passes on no more of a vector than these."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    some = vectors.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= ids)
    return some.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def packed(rows: DataFrame, limit: int, folder: str, name: str) -> DataFrame:
    """``rows`` (``vector``, ``ids``) in blocks of at most ``limit`` bytes of vectors of one number of components, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            columns = [[dim], [np.array([v for v, _ in part]).tobytes()], [[i for _, i in part]]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))), strict=True)], names=["dim", "data", "ids"])

        for batch in batches:
            for vector, ids in zip(batch.column(0), batch.column(1), strict=True):
                v = np.asarray(vector.values, dtype=np.float64)
                part = held.setdefault(len(v), [])
                part.append((v, ids.as_py()))
                if len(part) * v.nbytes >= limit:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    rows = written(rows.select("vector", "ids"), folder, f"{name}_rows")
    size = rows.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    # few tasks, so that blocks are full however many partitions there were
    blocks = rows.coalesce(max(1, size // (4 * limit))).mapInArrow(run, "dim long, data binary, ids array<array<long>>")
    blocks = written(blocks.withColumn("_at", F.monotonically_increasing_id()), folder, name)
    # the number within a partition, and how many blocks the partitions before have: one row a partition
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes, begins, n = sorted(blocks.groupBy(part.alias("p")).count().collect()), [], 0
    for p, size in sizes:
        begins.append((p, n))
        n += size
    begins = F.broadcast(blocks.sparkSession.createDataFrame(begins, "_p long, _begin long"))
    return blocks.join(begins, part == F.col("_p")).select((F.col("_begin") + within).alias("number"), "dim", "data", "ids")


def _search(k: int):
    """Rows of a band and a stripe each -> ``lead``, ``vec_id``, ``score``: the ``k`` best that a run of stripes has for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        best: list[tuple[np.ndarray, np.ndarray]] = []  # scores and ids of each query, sorted
        queries, leads = np.zeros((0, 0)), np.zeros(0, dtype=np.int64)

        def found() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(best), 1024):
                part = best[i : i + 1024]
                arrays = [np.repeat(leads[i : i + 1024], [len(ids) for _, ids in part]), np.concatenate([ids for _, ids in part]), np.concatenate([s for s, _ in part])]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["lead", "vec_id", "score"])

        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for j in range(batch.num_rows):
                key, dim = (column["band"][j].as_py(), column["run"][j].as_py()), column["dim"][j].as_py()
                if key != at:
                    yield from found()
                    at, leads = key, np.asarray(column["leads"][j].values.flatten())
                    queries = np.frombuffer(column["queries"][j].as_py(), dtype=np.float64).reshape(-1, dim)
                    best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(leads)
                vectors = np.frombuffer(column["data"][j].as_py(), dtype=np.float64).reshape(-1, dim)
                lists = column["ids"][j].values
                offsets, flat = np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten())
                codes, scalars = encoded(vectors)
                least = np.array([s[-1] if len(s) == k else -np.inf for s, _ in best])
                for i, index, scores in candidates(codes, scalars, vectors, queries, least, k):
                    if len(index):
                        sizes = offsets[index + 1] - offsets[index]
                        ids = np.concatenate([best[i][1], *(flat[offsets[x] : offsets[x + 1]] for x in index)])
                        scores = np.concatenate([best[i][0], np.repeat(scores, sizes)])
                        order = np.lexsort((ids, -scores))[:k]
                        best[i] = scores[order], ids[order]
        yield from found()

    return run


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def nearest(vectors: DataFrame, folder: str, every: int = EVERY, k: int = K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of each row whose id is divisible by ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & takes_part(F.col("vector")))
    rows = written(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), folder, "vectors")
    # a query is not its own neighbour, so one more is searched
    stripes = packed(distinct(rows, k + 1), STRIPE_BYTES, folder, "stripes")
    asked = rows.where(F.col("vec_id") % every == 0)
    leads = written(asked.groupBy("vector").agg(F.min("vec_id").alias("lead")), folder, "leads")
    per_band = leads.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    bands = packed(leads.select("vector", F.array("lead").alias("ids")), max(LEAST_BAND, min(BAND_BYTES, per_band // BANDS)), folder, "bands")
    n_stripes, n_bands = stripes.count(), bands.count()
    if not n_bands:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    run = F.floor(F.col("number") / STRIPES)
    left = stripes.select(F.explode(_upto(n_bands)).alias("band"), run.alias("run"), "dim", "data", "ids")
    right = bands.select(F.col("number").alias("band"), F.explode(_upto(-(-n_stripes // STRIPES))).alias("run"), "dim", F.col("data").alias("queries"), F.col("ids").alias("leads"))
    pairs = left.join(right.hint("merge"), ["band", "run", "dim"])
    found = written(pairs.mapInArrow(_search(k + 1), "lead long, vec_id long, score double"), folder, "found")
    order = Window.partitionBy("lead").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = found.groupBy("lead").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    queries = asked.join(leads, "vector").select(F.col("vec_id").alias("query_id"), "lead")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(lists, "lead").select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth row of ``embeddings``, against all rows."""
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), workspace(spark))
