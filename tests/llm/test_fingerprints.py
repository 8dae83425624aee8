import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lantern.llm import fingerprints as x
from tests.llm.data import documents


def brute_positions(text):
    """Closed syncmers one by one, by the hashes that the library gives single runs."""
    s = lambda t: int(x._runs(np.frombuffer(t.encode("utf-32-le"), np.uint32), x.S)[0])
    found = []
    for i in range(len(text) - x.K + 1):
        inner = [s(text[i + j : i + j + x.S]) for j in range(x.K - x.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


def test_anchors_against_brute_force():
    rng = random.Random(4)
    texts = ["short", "", "exactly thirty-two characters !!", "a" * 50, "Ein längerer Text mit Ümläuten, der mehrere Anker hat 🎈🎈 und mehr als einen Satz.", "the quick brown fox jumps over the lazy dog " * 2]
    texts += ["".join(rng.choices("abcdef ghé", k=rng.randint(20, 600))) for _ in range(20)]
    for text, (positions, hashes) in zip(texts, x.anchors(texts), strict=True):
        assert positions.tolist() == (brute_positions(text) or [0] * bool(text)) and hashes.dtype == np.uint64
    assert len(x.anchors([texts[-1] * 90])[0][0]) > 90 * len(brute_positions(texts[-1])) * 0.9


def brute_pairs(a, b):
    """Equal hashes by turns, each with all others, in plain Python."""
    pairs = []
    for h in set(a[1].tolist()):
        here, there = ([p for p, g in zip(*map(list, t), strict=True) if g == h] for t in (a, b))
        pairs += zip(here, there)
    if min(len(a[0]), len(b[0])) > 1:
        pairs = [(p, q) for p, q in pairs if sum(q - p == j - i for i, j in pairs) > 1]
    return sorted((int(p), int(q)) for p, q in pairs)


def test_pairs_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choices("ab", k=rng.randint(0, 120))) + "x" * rng.randint(0, 60)
        cut = rng.randint(0, len(text))
        a, b = x.anchors([text, text[:cut] + "".join(rng.choices("ab", k=rng.randint(0, 40))) + text[cut:]])
        want = brute_pairs(a, b)
        assert x.matches(x.spelled(a), x.spelled(b)) == want
        assert x.likeness(a, b) == (2 * len(want) / (len(a[0]) + len(b[0])) if len(a[0]) + len(b[0]) else 1.0)
        assert x.likeness(a, a) == 1.0


def test_spelling_comes_back():
    for places in ([0], [5, 132, 133, 70_000, 3_000_000], [127, 255], []):
        anchor = np.array(places, np.int64), np.arange(len(places), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert [u.tolist() for u in x.unspelled(x.spelled(anchor))] == [u.tolist() for u in anchor]


def test_context_free():
    passage = "a passage that stands in two quite different documents, word for word, from here to there"
    a, b = x.anchors([f"before it {passage} after", f"{passage} and then something else entirely"])
    pairs = x.matches(x.spelled(a), x.spelled(b))
    assert len(pairs) >= 5 and all(i - j == 10 for i, j in pairs)


def test_a_passage_is_found_in_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    passage = " ".join(rng.choices(words, k=60))
    a, b = (" ".join(rng.choices(words, k=20_000)) for _ in range(2))
    one, two = f"{a[:70_001]} {passage} {a[70_001:]}", f"{b[:9_000]} {passage} {b[9_000:]}"
    got = {r["doc_id"]: r["fingerprint"] for r in x.compared(spark.createDataFrame([(2, one), (1, two)], "doc_id long, text string")).collect()}
    pairs = x.matches(got[2], got[1])
    assert sum(i - j == 70_001 - 9_000 for i, j in pairs) >= 25
    assert x.unspelled(got[2])[0][: len(found := brute_positions(one[:3000]))].tolist() == found


def test_a_hot_id_is_cut_into_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(x, "BUCKETS_EACH", 3)
    for hot in (7, None):
        rows = [(hot, f"text number {i} of the hot id") for i in range(300)] + [(i, f"other {i}") for i in range(-20, 40) if i != 7]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        parts = x.dealt(df, "doc_id", "text").where("NOT ahead").select("id", F.spark_partition_id().alias("p")).where(F.col("id").eqNullSafe(F.lit(hot))).groupBy("p").count().collect()
        assert len(parts) > 3 and max(r["count"] for r in parts) < 100
        got = sorted(((r["doc_id"], r["edited_sha256"]) for r in x.compared(df).collect()), key=str)
        hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]], r[1]))
        want = [(i, hashlib.sha256(x.edited(t, after).encode()).hexdigest()) for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)]
        assert got == sorted(want, key=str)


def test_table_order_and_edits(spark):
    df = documents(spark).select("doc_id", "text").repartition(5)
    order = sorted(df.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in x.compared(df.selectExpr("*", "1 AS ahead", "'x' AS place")).collect()}
    single = lambda t: x.spelled(x.anchors([t])[0])
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        n = len(r["text"]) // 3
        changed = r["text"][: len(r["text"]) - n] + after["text"][:n]
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"], g["fingerprint"], g["edited_fingerprint"]) == (len(r["text"]), hashlib.sha256(changed.encode()).hexdigest(), single(r["text"]), single(changed))
        own, new, other = (x.unspelled(f) for f in (g["fingerprint"], g["edited_fingerprint"], got[after["doc_id"]]["fingerprint"]))
        assert g["near_edited"] == x.likeness(own, new) and g["near_next"] == x.likeness(own, other)
    assert sum(g["near_edited"] > g["near_next"] for g in got.values()) > 0.95 * len(got)


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert x.compared(make([])).collect() == []
    one = x.compared(make([(1, None)])).first()
    assert (one["n_chars"], one["fingerprint"], one["near_edited"], one["near_next"]) == (0, "", 1.0, 1.0)
    rows = [(None, "abc"), (None, "abd"), (4, None), (4, "xyzxyz"), (4, "xyzxyz"), (7, "q" * 200_000)]
    got = sorted(((r["doc_id"], r["n_chars"], r["near_next"]) for r in x.compared(make(rows)).collect()), key=str)
    assert got == sorted([(7, 200_000, 0.0), (4, 0, 0.0), (4, 6, 1.0), (4, 6, 0.0), (None, 3, 0.0), (None, 3, 0.0)], key=str)
    assert [r["fingerprint"] for r in x.fingerprint(make([(1, None), (2, "abc"), (3, "abc")])).orderBy("doc_id").collect()] == ["", x.spelled(x.anchors(["abc"])[0])] + [x.spelled(x.anchors(["abc"])[0])]
