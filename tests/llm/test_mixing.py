import re

import pytest

from lantern.llm import mixing as x
from tests.llm.data import documents, folder


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    share, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = share / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else unit * weight[s]
            share -= target[s] if full else 0
        open_ = open_ - full if full else set()
    return target


def brute_seats(claims, seats):
    given = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = max(claims, key=lambda k: (claims[k] / (2 * given[k] + 1), [-ord(c) for c in k]))
        given[best] += 1
    return given


def test_targets_and_taken(spark, tmp_path):
    more = spark.createDataFrame([(-1, None, "a b c"), (-2, None, None), (-3, "zero", ""), (-4, "src1", "w " * 30_000), (-5, "Ünï", "x y z")], "doc_id long, source string, text string")
    df = documents(spark).select("doc_id", "source", "text").unionByName(more)
    path = folder(spark, tmp_path, documents=df)
    rows = x.query(spark, path).collect()
    given = {r["doc_id"]: r for r in df.collect()}
    sizes, taken = {}, {}
    for r in rows:
        s = given[r["doc_id"]]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", given[r["doc_id"]]["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        s = given[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * x.BLOCK, 0.01 * want[s]), s
    assert sorted(map(tuple, rows)) == sorted(map(tuple, x.query(spark, path).collect()))


@pytest.mark.parametrize(("claims", "seats"), [({"a": 53.0, "b": 24.0, "c": 23.0}, 7), ({"a": 1e6, "b": 1.0, "c": 1.0, "d": 0.0}, 10), ({"a": 1.0, "b": 1.0, "c": 1.0}, 4), ({f"s{i}": 1.0 + i * i for i in range(30)}, 101), ({"a": 5.0}, 0)])
def test_seats_against_one_by_one(spark, claims, seats):
    rows = spark.createDataFrame([(k, v, seats) for k, v in claims.items()], "name string, claim double, seats long")
    assert {r["name"]: r["got"] for r in x.apportion(rows, "claim", "seats", ["name"], [], "got").collect()} == brute_seats(claims, seats)


def test_shards_and_cut(spark):
    docs = spark.createDataFrame([(i, "one", " ".join(f"d{i}w{k}" for k in range(40)), "clash") for i in range(50)], "doc_id long, source string, text string, quota string")
    rows = docs.withColumns({"size": x.size_of(x.F.col("text")), "mark": x.mark_of(x.F.col("text")), "shard": x.F.lit("theirs"), "_quota": x.F.lit("theirs")})
    mixed = x.mix(rows, rows.select("doc_id", "source", "size", "mark"), block=16, shard=300, weights=(1,), share=0.5)
    assert {(r["shard"], r["_quota"], r["quota"]) for r in mixed.collect()} == {("theirs", "theirs", "clash")}
    cut = {r["doc_id"]: r for r in x.cut(mixed).collect()}
    assert abs(sum(r["taken"] for r in cut.values()) - 1000) <= 16 * 10
    for i, r in cut.items():
        assert len(r["text"].split()) == r["taken"] and [w for s in r["spans"] for w in range(s["start"], s["end"])] == [int(w.split("w")[1]) for w in r["text"].split()], i


def brute_blocks(sizes, n, q, prime, shift, block):
    """Times that each block is taken, then words of each document, one word at a time."""
    times = [q // n + ((b * (prime % n) + shift) % n < q % n) for b in range(n)]
    taken, at = [], 0
    for size in sizes:
        taken.append(sum(times[k // block] for k in range(at, at + size)))
        at += size
    return taken


def test_blocks_of_a_shard_against_brute_force(spark):
    rows = spark.createDataFrame([(i, "s", 1 + i * 7 % 50, i) for i in range(40)], "doc_id long, source string, size long, mark long")
    got = {r["doc_id"]: r["taken"] for r in x.mix(rows, rows, block=8, weights=(1,), share=0.6).collect()}
    drawn = lambda k, *c: x.F.xxhash64(x.F.lit(x.SEED + k), *c)
    order = rows.orderBy(drawn(1, "doc_id", "size", "mark"), "doc_id").collect()
    lot = spark.range(1).select(drawn(2, x.F.lit("s"), x.F.lit(0).cast("long")).alias("shift"), drawn(3, x.F.lit("s"), x.F.lit(0).cast("long")).alias("prime")).first()
    total = sum(r["size"] for r in order)
    n, q = -(-total // 8), round(0.6 * total / 8)
    want = brute_blocks([r["size"] for r in order], n, q, x.PRIMES[lot["prime"] % len(x.PRIMES)], lot["shift"] % n, 8)
    assert [got[r["doc_id"]] for r in order] == want


def test_a_hot_null_id_is_dealt_over_shards_and_seeds_differ(spark):
    rows = spark.createDataFrame([(None, "s", 20, i) for i in range(400)], "doc_id long, source string, size long, mark long")
    one, two = (sorted((r["mark"], r["taken"]) for r in x.mix(rows, rows, block=10, shard=500, weights=(1,), share=0.5, seed=seed).collect()) for seed in (1, 2))
    assert sum(t for _, t in one) == sum(t for _, t in two) == 4000 and one != two
    assert all(all(p % d for d in range(2, int(p**0.5) + 1)) for p in x.PRIMES)


def test_empty_tables(spark, tmp_path):
    none = documents(spark).limit(0)
    assert x.query(spark, folder(spark, tmp_path / "a", documents=none)).collect() == []
    blank = spark.createDataFrame([(1, "s", None), (2, None, "")], "doc_id long, source string, text string")
    assert sorted(map(tuple, x.query(spark, folder(spark, tmp_path / "b", documents=blank)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
