"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: the sources, in code point order with null last, weigh ``WEIGHTS`` in turn and share ``share``
times the words of all documents; a target stops at ``repeats`` times its source's words, and the excess
is shared again by weight among the others until none is above (so all others are one multiple of their
weights). Quotas: the total is cut into blocks of ``block`` words, handed to the sources by the highest
quotients target / (2 seats + 1). A source's documents are dealt by a seeded hash of id, size and text over shards of
about ``shard`` words, and its blocks are handed to its shards in the same way by their sizes. Selection: the
documents of a shard, in seeded order, are one sequence of words; of its n blocks a quota of q takes each
q // n times and q % n of them once more, chosen by an affine permutation of the block numbers, of which the seed and
the shard choose both the shift and the step.

Only counts by source and by shard are gathered. Apportionment runs as a window over one row per source
or shard plus the few quotients that can be at issue, and documents are ordered within shards of bounded
size, so a source with a third of all rows spreads over as many shards as its size asks for.

Defined results: a null or empty text has size 0 and nothing is taken; with no words at all every target
is 0; a very long text spans as many blocks as it has; documents without an id, or of one id, are told apart by size and
text; repeated rows are documents of their own, which follow each other in one shard; of quotients that tie the source
or shard that comes first wins; an empty table gives an empty result; columns of the input with the names of the
outputs are replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm.common import WORD, small_or_plain, table, workspace, written

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
BLOCK, SHARD, SEED = 32, 1_000_000, 17
#: Sources or shards up to which their table is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 20_000
#: Primes above any number of blocks in a shard, so that multiplying by one permutes them.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579, 2_147_483_563, 2_147_483_549, 2_147_483_543, 2_147_483_497)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size`` with ``weight`` and ``target``. One row per source; the windows hold no others."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    # fullest first: all before a source are at their limits if it is, so its share is what they leave
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rest, everything = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = repeats * F.col("source_size")
    before = F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, 0)) - limit
    level = (share * F.sum("source_size").over(everything) - before) / F.sum("weight").over(rest)
    rows = rows.withColumn("_level", level).withColumn("_full", limit < F.col("_level") * F.col("weight"))
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    target = F.when(F.col("_full"), limit).otherwise(common * F.col("weight"))
    return rows.withColumn("target", target.cast("double")).drop("_level", "_full")


def apportion(rows: DataFrame, claim: str, seats: str, keys: list[str], within: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: their seats by highest quotients claim / (2 given + 1); ties by ``keys``.

    ``seats`` is the number to give among the rows alike in ``within``. Rounding each fair share gives all
    but at most half a seat per row of the total, of which a row gets at most its share of the claims, so
    only quotients that near to the fair share are ranked: a few per row in all.
    """
    names = [c for c in rows.columns if c != out]
    group = Window.partitionBy(*within)
    total = F.sum(claim).over(group)
    fair = F.when(total > 0, F.col(claim) / total * F.col(seats)).otherwise(0.0)
    reach = (F.ceil(F.when(total > 0, F.col(claim) / total * F.count(F.lit(1)).over(group)).otherwise(0.0)) + 2).cast("long")
    rows = rows.withColumns({"_fair": fair, "_reach": reach})
    rows = rows.withColumn("_sure", F.greatest(F.lit(0), F.floor("_fair") - F.col("_reach")).cast("long"))
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    tried = rows.where(F.col(claim) > 0).withColumn("_given", F.explode(F.sequence("_sure", F.floor("_fair").cast("long") + F.col("_reach"))))
    rank = F.row_number().over(group.orderBy((F.col(claim) / (2 * F.col("_given") + 1)).desc(), *(F.col(k).asc_nulls_last() for k in keys)))
    won = tried.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_open"))
    won = won.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("_won"))
    same = [rows[k].eqNullSafe(won[f"_{k}"]) for k in keys]
    seats_won = (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out)
    return rows.join(won, same, "left").select(*names, seats_won)


def mark_of(text: Column) -> Column:
    """What tells documents of equal id and size apart."""
    return F.xxhash64(text)


def mix(df: DataFrame, sizes: DataFrame, id: str = "doc_id", block: int = BLOCK, shard: int = SHARD, seed: int = SEED, **how) -> DataFrame:
    """``df`` (``id``, ``source``, ``size``, ``mark``, any more) with ``source_size``, ``target``, ``taken`` and ``spans``.

    ``sizes`` has ``id``, ``source``, ``size`` and ``mark`` of the same rows, cheap to read again. ``spans`` are the
    runs of words taken, as structs of ``start``, ``end`` (word numbers in the document) and ``times``.
    """
    spark = df.sparkSession
    lot = lambda k: F.xxhash64(F.lit(seed + k), F.col("id"), F.col("size"), F.col("mark"))
    deal = lambda rows: rows.withColumn("shard", F.pmod(lot(0), F.col("shards")))
    known = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    known = known.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    known = apportion(known, "target", "seats", ["source"], [], "quota")
    known = known.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long"))
    known = known.select(F.col("source").alias("in_source"), "source_size", "target", "quota", "shards")
    by_source = small_or_plain(written(known, workspace(spark), "sources"), BROADCAST_ROWS)
    in_source = F.col("source").eqNullSafe(F.col("in_source"))

    placed = deal(sizes.select(F.col(id).alias("id"), "source", "size", "mark").join(by_source, in_source))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shards = apportion(shards, "shard_size", "quota", ["source", "shard"], ["source"], "blocks")
    blocks = F.ceil(F.col("shard_size") / block).cast("long")
    shards = shards.select(F.col("source").alias("of_source"), F.col("shard").alias("of_shard"), blocks.alias("n"), F.least("blocks", F.lit(how.get("repeats", REPEATS)) * blocks).alias("q"))
    shards = small_or_plain(written(shards, workspace(spark), "shards"), BROADCAST_ROWS)

    # the caller's columns stay together, so that no name of theirs meets one of these
    keep = [c for c in df.columns if c not in ("source_size", "target", "taken", "spans")]
    rows = df.select(F.struct(*keep).alias("row"), F.col(id).alias("id"), "source", "size", "mark")
    rows = deal(rows.join(by_source, in_source))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard")))
    sequence = Window.partitionBy("source", "shard").orderBy(lot(1), "id", "size", "mark")
    rows = rows.withColumn("stop", F.sum("size").over(sequence.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("stop") - F.col("size"))
    drawn = lambda k: F.xxhash64(F.lit(seed + k), F.col("source"), F.col("shard"))
    shift = F.pmod(drawn(2), F.col("n"))
    step = F.get(F.array(*map(F.lit, PRIMES)), F.pmod(drawn(3), F.lit(len(PRIMES))).cast("int")) % F.col("n")

    def span(b: Column) -> Column:
        more = F.pmod(b * step + shift, F.col("n")) < F.col("q") % F.col("n")
        times = F.floor(F.col("q") / F.col("n")).cast("long") + more.cast("long")
        start, end = F.greatest(b * block, F.col("begin")), F.least((b + 1) * block, F.col("stop"))
        return F.struct((start - F.col("begin")).alias("start"), (end - F.col("begin")).alias("end"), times.alias("times"))

    covered = F.sequence(F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("stop") - 1) / block).cast("long"))
    rows = rows.withColumn("spans", F.when(F.col("size") > 0, F.filter(F.transform(covered, span), lambda x: x["times"] > 0)).otherwise(F.array()))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]) * x["times"])
    return rows.select("row.*", "source_size", "target", taken.alias("taken"), "spans")


def sized(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of ``id``, ``source``, ``size`` and ``mark``: the texts are read once for it."""
    sizes = df.select(id, "source", size_of(F.col(text)).alias("size"), mark_of(F.col(text)).alias("mark"))
    return written(sizes, workspace(df.sparkSession), "sizes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all ``documents`` takes of each."""
    sizes = sized(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mix(sizes, sizes).select("doc_id", "size", "source_size", "target", "taken")


def cut(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with only the words of ``spans`` in ``text``: runs of neighbours as they stand, joined by line ends.

    A text of which every word is taken stays as it is.
    """

    @F.pandas_udf("string")
    def run(texts, parts):
        out = []
        for x, p in zip(texts, parts, strict=True):
            words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", x or "")]
            runs: list[list[int]] = []
            for s in p if words else ():
                if runs and runs[-1][1] == s["start"]:
                    runs[-1][1] = s["end"]
                else:
                    runs.append([s["start"], s["end"]])
            out.append("\n".join(x[words[a][0] : words[b - 1][1]] for a, b in runs))
        return texts.__class__(out, dtype=object)

    words = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    part = words < F.col("size")
    # a text that stays does not go through Python
    return df.withColumn(text, F.when(part, run(F.when(part, F.col(text)), F.when(part, F.col(spans)).otherwise(F.array().cast(df.schema[spans].dataType)))).otherwise(F.col(text)))
