import random
import zlib

import pytest

from lantern.llm import toxicity as x
from tests.llm.data import folder

BAD = ["scumbag", "moronic", "idiotic", "worthless", "disgusting"]


def texts(n, toxic, seed):
    rng = random.Random(seed)
    parts = "the and er tion ing re at on sh ed ou ble ha ea".split()
    out = []
    for _ in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append(" ".join(words))
    return out


def test_held_out_accuracy():
    model = x.fit(texts(100, True, 1), texts(200, False, 2))
    whole = x.Gains(model).whole
    model = x.calibrated(model, [whole(t) for t in texts(50, True, 8)], [whole(t) for t in texts(100, False, 9)])
    hits = [model.score(*whole(t)) >= x.THRESHOLD for t in texts(100, True, 3)]
    alarms = [model.score(*whole(t)) >= x.THRESHOLD for t in texts(200, False, 4)]
    assert sum(hits) >= 95 and sum(alarms) <= 4
    # very long texts of either kind, and words in capitals with punctuation
    assert model.score(*whole(" ".join(texts(300, False, 5)))) < x.THRESHOLD <= model.score(*whole(" ".join(texts(300, True, 5))))
    assert model.score(*whole(texts(1, False, 5)[0] + " SCUMBAG! You are ‘WORTHLESS’.")) >= x.THRESHOLD


def test_windows():
    assert x.windows("One, TWO!\nÉté 'x'") == [b"one", b"two", "été".encode(), b"x"] and x.windows("") == []
    pieces = x.windows("a" * 100)
    assert all(len(p) <= x.PIECE for p in pieces) and len(pieces) == 6


def test_gains_against_brute_force(spark):
    """Lengths of a window under each dictionary by a compressor made for it alone; every window of the text."""
    import zstandard

    model = x.fit(texts(60, True, 1), texts(120, False, 2))

    def length(content, window):
        held = zstandard.ZstdCompressionDict(content + x.BEFORE + x.AFTER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(min_match=3, strategy=zstandard.STRATEGY_BTOPT, hash_log=17, chain_log=17, window_log=19, search_log=6, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0)
        held.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(x.BEFORE + b" " + window + b" " + x.AFTER))

    given = texts(3, True, 12) + texts(3, False, 13) + ["", "x" * 90]
    saved = lambda w: length(model.ordinary, w) - length(model.toxic, w)
    want = [(sum(s * s / (len(w) + 2) for w in x.windows(t) if (s := saved(w)) >= x.SAVED), len(x.windows(t))) for t in given]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], "doc_id long, text string, gain string")
    got = x.gains(df, model).orderBy("doc_id").collect()
    assert [r["windows"] for r in got] == [n for _, n in want] and [r["gain"] for r in got] == pytest.approx([g for g, _ in want]) and max(want)[0] > 0
    model = x.calibrated(model, want[:3], want[3:6])
    scored = x.score(df, model).orderBy("doc_id").collect()
    assert [r["score"] for r in scored] == pytest.approx([model.score(*w) for w in want]) and scored[0]["gain"] == "clash"


def test_query_and_edges(spark, tmp_path):
    bad, good = texts(80, True, 6), texts(160, False, 7)
    rows = [(i, t) for i, t in enumerate(bad + good)] + [(1000, None), (1001, ""), (1002, "é" * 50_000), (None, "the and"), (1003, bad[0]), (1003, bad[0])]
    marks = [(i, int(i < len(bad))) for i in range(len(bad) + len(good))] + [(1003, None), (5, 0), (7, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = x.query(spark, folder(spark, tmp_path, documents=docs, labels=labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert sum(r["predicted"] == (r["doc_id"] < 80) for r in held) >= 0.9 * len(held)
    none = x.query(spark, folder(spark, tmp_path / "n", documents=docs, labels=labels.limit(0))).collect()
    assert {r["predicted"] for r in none} == {0}
    assert x.query(spark, folder(spark, tmp_path / "e", documents=docs.limit(0), labels=labels)).collect() == []
