import os

import numpy as np
import pytest

from lantern.llm import nearest as x
from tests.llm.data import FOLDER, folder

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every=x.EVERY, k=x.K):
    """Exact neighbours by the whole matrix of inner products."""
    held = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(v):
            held[i] = min(held.get(i, v), v)
    out = {}
    for q in held:
        if q % every == 0:
            a = np.array(held[q], dtype=np.float32).astype(float)
            scores = [(-float((np.array(v, dtype=np.float32).astype(float) * a).sum()), i) for i, v in held.items() if i != q and len(v) == len(a)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert set(got) == {q for q in want if want[q]} and all(len(got[q]) == len(want[q]) for q in got)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got) / max(1, sum(map(len, want.values())))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got, want = found(x.query(spark, FOLDER)), brute(rows)
    assert recall(got, want) >= 0.98
    held = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))
        assert [s for _, s in near] == pytest.approx([float(np.dot(np.array(held[q]), np.array(held[i]))) for i, _ in near], abs=1e-12)


def test_many_blocks(spark, tmp_path, monkeypatch):
    """Vectors of unlike length over many small stripes and bands."""
    for name, value in {"STRIPE_BYTES": 20_000, "LEAST_BAND": 5_000, "BAND_BYTES": 10_000, "STRIPES": 3, "SLICE": 7}.items():
        monkeypatch.setattr(x, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 48))
    rows = [(i, ((centres[i % 9] + rng.normal(size=48)) * rng.uniform(0.1, 3)).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert recall(found(x.nearest(df, f"file://{tmp_path}/a", every=10, k=7)), brute(rows, 10, 7)) >= 0.97


def test_copies_and_edges(spark, tmp_path):
    rng = np.random.default_rng(6)
    one, other = (rng.normal(size=6).astype(np.float32).tolist() for _ in range(2))
    one = [3 * v for v in one]
    rows = [(i, one) for i in range(300)] + [(300 + i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)] + [(1000 + i, other) for i in range(30)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 6), (2060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2080, [float("nan")] * 6), (2100, [float("inf")] + [0.0] * 5), (None, one)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3020, [1.0]), (rows[305][0], rows[305][1]), (320, other), (-20, one), (3040, [-0.0, 1.0]), (3041, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA + ", vector string, rank int")
    path = folder(spark, tmp_path, embeddings=df)
    got, want = found(x.query(spark, path)), brute(rows)
    assert recall(got, want) >= 0.97
    # a copy's neighbours are the copies of the smallest ids, itself left out
    assert [i for i, _ in got[0]] == [-20, *range(1, 20)] and [i for i, _ in got[280]] == [-20, *range(19)]
    assert got[3000] == want[3000] and 3020 not in got and got[3040] == want[3040]
    assert found(x.nearest(df.limit(0), f"file://{tmp_path}/e")) == {}
    doubles = df.select("vec_id", df.embedding.cast("array<double>").alias("embedding"))
    assert recall(found(x.nearest(doubles, f"file://{tmp_path}/d")), want) >= 0.97


def test_estimates():
    """The estimate has no bias, and its bound holds as often as it should."""
    rng = np.random.default_rng(8)
    for d in (24, 64, 200):
        v, q = rng.normal(size=(4000, d)) * rng.uniform(0.2, 4, size=(4000, 1)), rng.normal(size=(16, d))
        assert np.allclose((x.rotated(v[:9]) @ x.rotated(q).T), v[:9] @ q.T)
        codes, scalars = x.encoded(v)
        assert codes.dtype == np.uint8 and codes.shape[1] * 8 == x.rotated(q).shape[1]
        error = (x.estimated(codes, scalars, x.rotated(q)) - q @ v.T) / np.outer(np.sqrt((q * q).sum(axis=1)), scalars[:, 1])
        assert abs(error.mean()) < 0.05 and (np.abs(error) <= x.BOUND).mean() > 0.97
