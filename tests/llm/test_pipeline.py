import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as x
from lantern.llm import mixing, quality_rules, sentencepiece_codec, toxicity
from tests.llm import test_mixing, test_near_dedup, test_quality_rules
from tests.llm.data import documents, folder, labels


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    docs = documents(spark).select(x.COLUMNS)
    # a repeated row, a document without an id, an empty one
    first = docs.orderBy("doc_id").limit(1)
    more = first.unionAll(first.withColumn("doc_id", F.lit(None).cast("long"))).unionAll(first.withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("")}))
    more = more.unionAll(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    return folder(spark, tmp_path_factory.mktemp("pipeline"), documents=docs.unionAll(more), labels=labels(spark))


def hashed(spark, ids, seed):
    """The engine's hash of each id; everything else here is plain Python."""
    return {r["id"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.xxhash64(F.lit(seed), F.col("id")).alias("h")).collect()}


def clean(rows, model):
    """Every window of every text under both dictionaries."""
    found = toxicity.Gains(model)

    def distance(text):
        all_windows = toxicity.windows(text)
        gain = sum(s * s / (len(w) + 2) for w in all_windows if (s := found.saved(w)) >= toxicity.SAVED)
        return (gain - model.rate * len(all_windows)) / math.sqrt(model.spread * (len(all_windows) + toxicity.STEADY))

    return [r for r in rows if distance(r["text"] or "") < model.cut]


def good(spark, rows, quality):
    """Bucket by bucket and document by document."""
    bucket = lambda d, i: int.from_bytes(d[i : i + 4], "little") * 0x9E3779B1 % 2**32 >> 16
    runs = lambda t: [bucket(d, i) for d in [(t or "").encode()] for i in range(len(d) - 3)]
    ids = sorted(i for i, q in quality.items() if q in (0, 1))
    out = {i: h % 3 == 0 for i, h in hashed(spark, ids, 4).items()}
    trusted = {i for i in ids if quality[i] == 1 and not out[i]}
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(runs(r["text"]))
        if r["doc_id"] in trusted:
            target.update(runs(r["text"]))
    share = sum(target.values()) / max(1, sum(raw.values()))
    ratio = {b: math.log((target[b] + quality_rules.M) / (n * share + quality_rules.M)) for b, n in raw.items()}
    mean = lambda t: sum(ratio[b] for b in runs(t)) / max(1, len(runs(t)))

    def base(t):
        n, _, _, _, again = test_quality_rules.brute(t)
        return n >= 10 and 100 * again <= 20 * n

    tried = {}
    for r in rows:
        if r["doc_id"] in out and r["doc_id"] not in trusted and base(r["text"]):
            tried[r["doc_id"]] = min(tried.get(r["doc_id"], math.inf), round(mean(r["text"]), 6))
    high, low = (sorted(s for i, s in tried.items() if quality[i] == q) for q in (1, 0))
    values = sorted({*high, *low})
    cuts = [values[0] - 1] + [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)] if high and low else [-math.inf]
    cost = lambda c: quality_rules.CARE * sum(s < c for s in high) / max(1, len(high)) + sum(s >= c for s in low) / max(1, len(low))
    least = min(cuts, key=lambda c: (round(cost(c), 9), c))
    return [r for r in rows if base(r["text"]) and round(mean(r["text"]), 6) >= least]


def single(rows):
    classes = test_near_dedup.brute([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], x.SHINGLE)
    kept, seen = [], set()
    for r in rows:
        if r["doc_id"] is None or (classes[r["doc_id"]][1] == r["doc_id"] and r["doc_id"] not in seen):
            kept.append(r)
            seen.add(r["doc_id"])
    return kept


def mixed(spark, rows):
    """One word after another, one block after another, one seat after another; a source is one shard here."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    targets = test_mixing.brute_targets(dict(sizes))
    quotas = test_mixing.brute_seats({s: targets[s] for s in sorted(targets)}, round(sum(targets.values()) / mixing.BLOCK))
    schema = "doc_id long, source string, size long, text string"
    df = spark.createDataFrame([(r["doc_id"], r["source"], len(words(r["text"])), r["text"]) for r in rows], schema).withColumn("mark", F.xxhash64("text"))
    lot = lambda k, *c: F.xxhash64(F.lit(mixing.SEED + k), *c)
    order = df.orderBy("source", lot(1, "doc_id", "size", "mark"), "doc_id", "size", "mark").select("*", lot(2, "source", F.lit(0).cast("long")).alias("shift"), lot(3, "source", F.lit(0).cast("long")).alias("prime")).collect()
    out = []
    for s in sorted(sizes):
        own = [r for r in order if r["source"] == s]
        n = -(-sizes[s] // mixing.BLOCK)
        if not n:
            continue
        q, shift, step = min(quotas[s], 2 * n), own[0]["shift"] % n, mixing.PRIMES[own[0]["prime"] % len(mixing.PRIMES)] % n
        at = 0
        for r in own:
            spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"] or "")]
            times = [q // n + (((at + k) // mixing.BLOCK * step + shift) % n < q % n) for k in range(len(spans))]
            at += len(spans)
            for copy in (1, 2):
                taken = [t >= copy for t in times]
                if all(taken) and taken:
                    out.append((r["doc_id"], r["source"], r["text"]))
                elif any(taken):
                    parts, k = [], 0
                    while k < len(spans):
                        end = k
                        while end < len(spans) and taken[end]:
                            end += 1
                        if end > k:
                            parts.append(r["text"][spans[k][0] : spans[end - 1][1]])
                        k = max(end, k + 1)
                    out.append((r["doc_id"], r["source"], "\n".join(parts)))
    return out


def test_run_against_brute_force(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    marks = spark.read.parquet(f"{path}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    quality = {}
    for r in marks.where("quality IS NOT NULL").collect():
        quality[r["doc_id"]] = min(quality.get(r["doc_id"], 1), r["quality"])
    rows = clean(rows, toxicity.train(docs, marks.select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))))
    rows = single(good(spark, rows, quality))
    assert 0 < len(rows) < docs.count()
    p = sentencepiece_codec.processor(sentencepiece_codec.model_path())
    want = []
    for i, source, text in mixed(spark, rows):
        ids = p.encode(text)
        want.append((i, source, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in x.run(spark, path).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_return_the_columns_of_documents(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in x.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == x.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert len(x.STAGES) == 5 and docs.count() > 0


def test_an_empty_table_passes(spark, tmp_path):
    none = folder(spark, tmp_path, documents=documents(spark).select(x.COLUMNS).limit(0), labels=labels(spark).limit(0))
    assert x.run(spark, none).collect() == []
