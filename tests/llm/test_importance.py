import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lantern.llm import importance as x
from tests.llm.data import FOLDER, documents, folder

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    """One row after the other, and one sort over all of them."""
    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)}
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found)
        h = None if doc_id is None else int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[0] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = got(x.query(spark, FOLDER))
    assert found == brute(docs, target) and sum(r[4] is not None for r in found) > 0


def test_edges_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "The", "É", "été", "x1", "ß", "日本", "a_b", "no break"])
    docs = [(i, rng.choice([" ", ", ", "\n", "-"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(600)]
    docs += [(600, None), (601, ""), (602, "... ,,"), (None, "a " * 40), (-7, "b " * 40), docs[5], docs[5], (5, docs[6][1]), (604, "word " * 30_000), (605, "x" * 200_000)]
    docs += [(700 + i % 3, "same text here " * 10) for i in range(400)]  # rows of one id and one score
    target = ["the été of x1 " * 9, None, "", "日本 ß"]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, score string, rank int")
    path = folder(spark, tmp_path, documents=df.repartition(5), benchmark=spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert got(x.query(spark, path)) == brute(docs, target)
    empty = folder(spark, tmp_path / "e", documents=df.limit(0), benchmark=spark.read.parquet(f"{path}/benchmark.parquet").limit(0))
    assert got(x.query(spark, empty)) == []
    few = folder(spark, tmp_path / "f", documents=df.where("doc_id < 12"), benchmark=spark.read.parquet(f"{path}/benchmark.parquet").limit(0))
    assert got(x.query(spark, few)) == brute([d for d in docs if d[0] is not None and d[0] < 12], [])


def test_pieces_end_nowhere_else(monkeypatch):
    """Features that cross the pieces of a long text are counted once each."""
    text = " ".join(f"w{i % 37}é{i % 11}" for i in range(3_000)) + " ..  end"
    want = sorted(features(text)[1])
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(x, "PIECE", size)
        found = list(x.buckets(text.encode()))
        assert sorted(b for _, part in found for b in part) == want and sum(n for n, _ in found) == len(features(text)[0])


@pytest.mark.parametrize("blocks", [1, 3, 17, 64])
def test_tournament(blocks):
    rng = random.Random(blocks)
    parts = [sorted((rng.randint(-9, 9), rng.randint(0, 3), 1, 1) for _ in range(rng.randint(1, 30))) for _ in range(blocks)]
    tree, out = x.Tournament(), []
    for rows in sorted(parts):
        while tree.least() < rows[0]:
            out.append(tree.pop())
        tree.add(rows)
    while tree.least() < (math.inf,):
        out.append(tree.pop())
    assert out == sorted(r for p in parts for r in p) and tree.leaves <= 2 * blocks


def test_draw_ends_exactly(spark, tmp_path, monkeypatch):
    """Small blocks and ranges, many runs, and scores that tie at the very end of the draw."""
    monkeypatch.setattr(x, "BLOCK_ROWS", 16)
    monkeypatch.setattr(x, "RANGE_ROWS", 40)
    rng = np.random.default_rng(1)
    for k, score in enumerate((rng.integers(-10**9, 10**9, 6000), rng.integers(0, 7, 6000), np.zeros(6000, dtype=int), np.where(rng.random(6000) < 0.5, 10**12, rng.integers(0, 50, 6000)))):
        rows = [(i, 3 * i % 50, 5, int(s), i % 10 > 0) for i, s in enumerate(score)] + [(10_000, 0, 0, None, False)]
        df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, eligible boolean").repartition(9)
        for share in (5, 100):
            found = [tuple(r) for r in x.draw(df, f"file://{tmp_path}/{k}-{share}", share).collect()]
            able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
            rank = {r[0]: i for i, r in enumerate(able[: len(able) * share // 100], 1)}
            assert sorted(found, key=str) == sorted(((*r[:4], rank.get(r[0])) for r in rows), key=str)
