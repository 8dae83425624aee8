import collections
import re

from pyspark.sql import functions as F

from lantern.llm import quality_rules as x
from tests.llm.data import documents, labels


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_counts_and_verdicts(spark):
    docs, marks = documents(spark), labels(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = x.judge(docs, x.fit(docs, marks)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [r[c] for c in x.BASE] == brute(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_ratio_against_brute_force(spark):
    docs, marks = documents(spark), labels(spark)
    ratios = x.fit(docs, marks)
    import numpy as np

    table = np.frombuffer(ratios.table, np.float32)
    for r in x.judge(docs, ratios, with_text=True).limit(40).collect():
        data = r["text"].encode()
        runs = [int.from_bytes(data[i : i + 4], "little") * 0x9E3779B1 % 2**32 >> 16 for i in range(len(data) - 3)]
        assert abs(r["score"] - (sum(float(table[k]) for k in runs) / max(1, len(runs)))) < 1e-5
    raw = collections.Counter(int.from_bytes(d[i : i + 4], "little") * 0x9E3779B1 % 2**32 >> 16 for d in (r["text"].encode() for r in docs.collect()) for i in range(len(d) - 3))
    assert (table[[k for k in range(x.BUCKETS) if k not in raw]] == 0).all()


def test_good_labels_are_kept_and_bad_ones_dropped(spark):
    docs, marks = documents(spark), labels(spark)
    judged = x.judge(docs, x.fit(docs, marks)).where("NOT base_failed").join(marks, "doc_id")
    share = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share.get(0, 0) < 0.3


def test_edges(spark):
    good = "the quick brown fox jumps over a lazy dog again and again today"
    rows = [(1, None, 5), (2, "", 5), (3, "a b c", 5), (4, good, 5), (4, good, 5), (None, good, 5), (5, "line one\nline one\n\n \nx", 5), (6, "w " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = x.judge(docs, x.fit(docs, none)).collect()
    assert [(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in got] == [
        (1, 0, True, False), (2, 0, True, False), (3, 3, True, False), (4, 13, False, True), (4, 13, False, True), (None, 13, False, True), (5, 5, True, False), (6, 50_000, True, False),
    ]
    assert got[6]["n_dup_lines"] == 1 and x.judge(docs.limit(0), x.fit(docs.limit(0), none)).collect() == []


def test_threshold_is_that_of_all_scores(spark):
    """More scores of either kind than the 4,000 that were drawn before, against every cut."""
    import numpy as np

    rng = np.random.default_rng(1)
    good, bad = np.round(rng.normal(0.2, 0.3, 9000), 6), np.round(rng.normal(-0.3, 0.3, 7000), 6)
    good[:50] = bad[:50]
    rows = spark.createDataFrame([(float(v), 1) for v in good] + [(float(v), 0) for v in bad], "score double, quality int")
    counted = rows.groupBy("score").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    values = np.unique([*good, *bad])
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    cost = x.CARE * np.searchsorted(np.sort(good), cuts) / len(good) + 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    got = x.threshold(counted)
    assert got in cuts and abs(cost[list(cuts).index(got)] - cost.min()) < 1e-12
    assert x.threshold(counted.where("bad = 0")) == float("-inf") and x.threshold(counted.limit(0)) == float("-inf")


def test_every_labelled_row_is_used(spark):
    marks = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = x.marked(marks, "doc_id")
    assert rows.count() == 40_000 and rows.where("NOT _trusted AND _quality = 0").count() == 20_000
