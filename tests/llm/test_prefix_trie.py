import hashlib
import random
import zlib

import duckdb
import pytest

from lantern.llm import prefix_trie as x
from tests.llm.data import folder

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node with its members, one conversation after the other."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    below = {n: [0, 0, 0] for n in nodes}  # children, leaves, saved
    leaves = {n for n in nodes if all(len(paths[c]) == len(n) for c in nodes[n])}
    for n, members in nodes.items():
        if n:
            below[n[:-1]][0] += 1
        for d in range(len(n) + 1):
            below[n[:d]][1] += n in leaves
            below[n[:d]][2] += (len(members) - 1) * (len(n[-1][1]) if n else 0)
    out = []
    for n, members in nodes.items():
        ids = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), *below[n], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, convs, words="abc"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), convs) + [0, 100, 200]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "user", "assistant", None]), rng.choice([*words, *words, "", None, "é𝄞"])))
    return rows + [(None, 1, "user", "a"), (None, None, None, None)] + rows[:3]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, tmp_path, seed):
    rows = random_rows(seed, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(x.query(spark, folder(spark, tmp_path, conversations=df))) == brute(rows)


def test_a_conversation_over_many_partitions(spark, tmp_path, monkeypatch):
    """One conversation holds most rows, so its running sums cross partitions; ends are hashed in many blocks."""
    monkeypatch.setattr(x, "BLOCK", 8)
    rows = random_rows(7, 60, "a") + [(307, t % 270, "user", f"t{t % 11}") for t in range(600)] + [(300 + i, 0, "user", "same") for i in range(1, 90) if i != 7]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = x.digests(df).repartitionByRange(4, "conv_id", "turn")
    assert turns.where("conv_id = 307").select(x.F.spark_partition_id().alias("p")).distinct().count() > 1
    assert got(x.trie(df.repartition(7), f"file://{tmp_path}/work")) == brute(rows)


def test_edges(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert got(x.trie(spark.createDataFrame([], SCHEMA), f"{base}/a")) == []
    # only turnless conversations: the root is the only node, and its own leaf
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    rows = [(turnless, 0, "user", "a")]
    assert got(x.trie(spark.createDataFrame(rows, SCHEMA), f"{base}/b")) == brute(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    # very long texts, copies of whole conversations, clashing names
    rows = [(c, t, "user", "é" * 100_000 if t == 6 else "x") for c in (1, 2, 3, 100, 101) for t in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.selectExpr("*", "conv_id AS depth", "turn AS k1", "role AS _part", "role AS position", "text AS owner", "text AS digest", "turn AS length")
    assert got(x.trie(clash, f"{base}/c")) == brute(rows)


def test_sql(spark, tmp_path):
    rows = random_rows(11, 80)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "c"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    found = c.execute(x.oracle())
    names = [d[0] for d in found.description]
    assert names == COLUMNS and sorted(map(tuple, found.fetchall()), key=str) == brute(rows)
