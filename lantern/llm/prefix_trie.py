"""The trie of conversation prefixes, by smallest-member ownership.

A node is a distinct sequence of first turns, its owner the smallest conversation that starts with it. As members only
leave on the way down, the nodes that a conversation owns are a suffix of its path, so few numbers a conversation tell all
of it: its length, how many of its nodes others own, the tokens of these, and whether its end is a leaf of its own. One
group-by over prefixes then gives every node: members are counted, children are members that own the next node, leaves are
members whose end is an owned leaf, and saved tokens are the tokens of occurrences below less those of owned nodes, which
is, for each member, the tokens of what others own of its path from here on.

A prefix is named by its depth and 128 bits, the exclusive or of two hashes a turn of its position and the SHA-256 of its role
and text; texts themselves are never shuffled. Positions and prefixes are running sums over turns sorted by range, so
that a conversation may span many partitions; each partition's windows begin with the sums of the parts before, of which there
are at most two a partition. Everything else is an aggregate with partial sums, so no node, be it the root, gathers its members.
The ids that end at a node are hashed in order: blocks of neighbouring ids become strings first, and of nodes with
several blocks one task streams the blocks through the hash, as SHA-256 has to be fed in sequence.

Defined results: rows without ``conv_id`` belong to no conversation; null roles and texts are empty; turns come by number, null
first, then by role and by the SHA-256 of role and text, so that ties have an order; repeated rows are turns of their own; a
conversation whose rebuilt form has no turn is a member of the root alone; a negative id belongs to the base towards zero; very
long texts are hashed whole; an empty table has no node, not even a root; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm.common import table, workspace, written

#: A conversation shares first turns with the one at the foot of its hundred, up to five.
FAMILY, SHARED = 100, 6
#: Neighbouring ids in a block of a node's ends.
BLOCK = 8192
KEY = ["depth", "k1", "k2"]


def digests(conversations: DataFrame) -> DataFrame:
    """``conv_id``, what orders its turns, the SHA-256 of role and text, and the text's code points."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    # the role's length goes first, so that no two pairs of role and text look alike
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.sha2(whole, 256).alias("digest"), F.length(text).cast("long").alias("tokens"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, tuple[Column, str]]) -> DataFrame:
    """``rows`` with running sums over each conversation in ``order``; ``_part`` numbers the ranges that the rows are sorted into.

    A sum is a value and how values add up: ``sum`` or ``xor``.
    """
    total = {"sum": F.sum, "xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    local = Window.partitionBy("conv_id", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("conv_id", "_part").agg(*(total[how](value).alias(name) for name, (value, how) in sums.items()))
    # a conversation of several parts; there are at most two such parts a partition, whatever the table's size
    several = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_part", *sums))).alias("parts")).where(F.size("parts") > 1)
    before = lambda name, how: F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("long"), lambda a, p: join[how](a, p[name]))
    offsets = several.select("conv_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("i")).select(
        "conv_id", F.col("parts")[F.col("i")]["_part"].alias("_part"), *(before(name, how).alias(f"_{name}") for name, (_, how) in sums.items())
    )
    out = rows.withColumns({name: total[how](value).over(local) for name, (value, how) in sums.items()})
    out = out.join(F.broadcast(offsets), ["conv_id", "_part"], "left")
    found = {name: join[how](F.col(name), F.coalesce(f"_{name}", F.lit(0).cast("long"))) for name, (_, how) in sums.items()}
    return out.withColumns(found).drop(*(f"_{name}" for name in sums))


def _hash(seed: int, position: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(seed), position.cast("long"), digest)


def _mixed(seed: int):
    return lambda total, turn: total.bitwiseXOR(_hash(seed, turn["position"], turn["digest"]))


def rebuilt(turns: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(conversations, occurrences)`` after each conversation took the first turns of its family's base.

    Conversations have ``conv_id`` and ``length``, occurrences ``conv_id``, ``depth``, ``k1``, ``k2``, ``tokens`` and
    ``before``, the tokens of the turns above.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = turns.repartitionByRange(F.col("conv_id"), *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, folder, "turns")
    placed = running(ranged, order, {"position": (F.lit(1).cast("long"), "sum")}).select("conv_id", "_part", "position", "digest", "tokens")
    placed = written(placed, folder, "placed")
    base, head = F.col("conv_id") - F.col("conv_id") % FAMILY, F.col("position") < SHARED
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    heads = placed.where((F.col("conv_id") == base) & head).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("position", "digest", "tokens"))).alias("head"))
    # every conversation has a first turn; the copy of the base's head that it takes is cut to its own number
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("shared").cast("int")), F.array().cast("array<struct<position:long,digest:string,tokens:long>>"))
    own = placed.withColumns({"base": base, "shared": shared}).join(heads, "base", "left").withColumn("head", taken)
    first = own.where("position = 1").select("conv_id", F.explode("head").alias("t")).select("conv_id", F.lit(-1).alias("_part"), F.col("t.position").alias("depth"), "t.digest", "t.tokens")
    lanes = {"k1": 11, "k2": 12}
    fold = lambda f: F.aggregate("head", F.lit(0).cast("long"), f)
    rest = own.where("position > shared").select(
        "conv_id", "_part", (F.col("position") - F.col("shared") + F.size("head")).alias("depth"), "digest", "tokens",
        *(fold(_mixed(s)).alias(f"h_{k}") for k, s in lanes.items()), fold(lambda a, t: a + t["tokens"]).alias("h_through"),
    )
    sums = {k: (_hash(s, F.col("depth"), F.col("digest")), "xor") for k, s in lanes.items()} | {"through": (F.col("tokens"), "sum")}
    rest = running(rest, [F.col("depth")], sums).withColumns({k: F.col(k).bitwiseXOR(F.col(f"h_{k}")) for k in lanes} | {"through": F.col("through") + F.col("h_through")})
    # a head has five turns at most, so its sums need no parts
    by_depth = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumns({k: F.bit_xor(_hash(s, F.col("depth"), F.col("digest"))).over(by_depth) for k, s in lanes.items()} | {"through": F.sum("tokens").over(by_depth)})
    columns = ["conv_id", *KEY, "tokens", (F.col("through") - F.col("tokens")).alias("before")]
    occurrences = written(first.select(*columns).unionByName(rest.select(*columns)), folder, "occurrences")
    lengths = occurrences.groupBy("conv_id").agg(F.max("depth").alias("length"))
    conversations = placed.where("position = 1").select("conv_id").join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"))
    return written(conversations, folder, "conversations"), occurrences


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's blocks, which come sorted; one hash is open at a time."""
    node, state = None, None
    names = [*KEY, "ends_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*KEY, "ids"]), strict=True):
            if key != node:
                if node:
                    done.append([*node, state.hexdigest()])
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 4, kinds, strict=True)], names=names)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip([*node, state.hexdigest()], kinds, strict=True)], names=names)


def ends(finished: DataFrame, folder: str) -> DataFrame:
    """For each node (``depth``, ``k1``, ``k2``) at which conversations end, the hash of their ids in order."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = finished.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids"))
    blocks = written(blocks, folder, "blocks")
    counted = blocks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    one = counted.where("n = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    many = blocks.join(counted.where("n > 1").select(*KEY), KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return one.unionByName(many.mapInArrow(_chain, "depth long, k1 long, k2 long, ends_sha256 string"))


def trie(conversations: DataFrame, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt ``conversations``; intermediate tables go below ``folder``."""
    convs, occurrences = rebuilt(digests(conversations), folder)
    lengths = convs.where("length > 0")
    known = written(occurrences.join(lengths, "conv_id"), folder, "known")
    nodes = known.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("length").alias("deepest"))
    seen = written(known.join(nodes, KEY), folder, "seen")
    # what each conversation does not own is the upper part of its path; the last of it is the parent of its first own node
    other = F.col("owner") != F.col("conv_id")
    of_conv = seen.groupBy("conv_id").agg(
        F.count_if(other).alias("others"),
        F.coalesce(F.sum(F.when(other, F.col("tokens"))), F.lit(0)).alias("other_tokens"),
        F.max(F.when(other, F.col("owner"))).alias("above"),
        F.max((~other & (F.col("depth") == F.col("length")) & (F.col("deepest") == F.col("length"))).cast("long")).alias("leaf"),
    )
    of_conv = written(of_conv, folder, "owners")
    root = convs.join(of_conv, "conv_id", "left").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if((F.col("length") > 0) & (F.col("others") == 0)).alias("n_children"),
        F.sum("leaf").alias("leaves"), F.coalesce(F.sum("other_tokens"), F.lit(0)).alias("saved_tokens"),
    ).where("n_convs > 0")
    nil = F.lit(0).cast("long")
    root = root.select(
        "conv_id", nil.alias("depth"), nil.alias("k1"), nil.alias("k2"), F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", F.greatest(F.coalesce("leaves", nil), F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens",
    )
    # the root's owner is the smallest conversation of all, a single number
    lowest = convs.agg(F.min("conv_id").alias("lowest"))
    joined = seen.join(of_conv, "conv_id")
    owned_next = (F.col("length") > F.col("depth")) & (F.col("others") <= F.col("depth"))
    mine = ~other & (F.col("others") == F.col("depth") - 1)
    found = joined.groupBy(*KEY).agg(
        F.first("owner").alias("conv_id"),
        F.max(F.when(mine, F.col("above"))).alias("above"),
        F.count_if(mine).alias("begins"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(owned_next).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(other, F.col("other_tokens") - F.col("before")).otherwise(0)).alias("saved_tokens"),
    )
    # the first own node hangs on another's, or at depth 1 on the root; any later one on an own node
    parent = F.when(F.col("depth") == 1, F.col("lowest")).when(F.col("begins") > 0, F.col("above")).otherwise(F.col("conv_id"))
    found = found.crossJoin(F.broadcast(lowest)).select("conv_id", *KEY, parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    finished = seen.where("depth = length").select(*KEY, "conv_id").unionByName(convs.where("length = 0").select(nil.alias("depth"), nil.alias("k1"), nil.alias("k2"), "conv_id"))
    every = root.unionByName(found).join(ends(finished, folder), KEY, "left")
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of ``conversations``."""
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), workspace(spark))


def oracle() -> str:
    """CRC-32 by its table of 256 values, prefixes as lists of turns."""
    return """
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crcs
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS position
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])
  ), 4294967295) % 6 AS shared
  FROM (SELECT DISTINCT conv_id FROM turns) CROSS JOIN crcs
), taken AS (
  SELECT c.conv_id, 0 AS part, t.position, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.position <= c.shared
  UNION ALL
  SELECT c.conv_id, 1, t.position, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.position > c.shared
), path AS (
  SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS node, length(text) AS tokens FROM taken WINDOW w AS (PARTITION BY conv_id ORDER BY part, position)
  UNION ALL
  SELECT conv_id, 0, [], 0 FROM convs
), sized AS (
  SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM path
), nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(length) AS deepest, (count(*) - 1) * any_value(tokens) AS saved,
    string_agg(CASE WHEN length = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ids
  FROM sized GROUP BY depth, node
), above AS (
  SELECT c.depth, c.node, p.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.node[:-2]
), climbed AS (
  SELECT conv_id, depth, node, deepest = depth AS leaf, saved, depth AS level FROM nodes
  UNION ALL
  SELECT conv_id, depth, node[:-2], leaf, saved, level - 1 FROM climbed WHERE level > 0
), summed AS (
  SELECT level AS depth, node, count_if(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM climbed GROUP BY ALL
), children AS (
  SELECT depth - 1 AS depth, node[:-2] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
)
SELECT n.conv_id, n.depth, a.parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM nodes n JOIN above a USING (depth, node) JOIN summed s USING (depth, node) LEFT JOIN children c USING (depth, node)
"""
