"""A training corpus from ``documents`` in five stages, each of which works on what its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame.
All but the last return the columns of ``documents``. ``run`` writes every stage's rows below the shared
folder of ``spark.checkpoint.dir`` and reads them again for the next one.

Defined results, beside those of the operators: a document without an id is judged like any other, but is
never a near duplicate of one; null and empty texts fail the base rules; very long texts pass every stage whole; of near
duplicates the smallest id stays (ties cannot arise), and of rows with that id the least by its columns; other columns of
``documents`` are dropped, whatever their names; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import mixing, near_dedup, quality_rules, sentencepiece_codec, toxicity
from lantern.llm.common import remove, ship, small_or_plain, table, workspace, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5
#: Dropped ids up to which their table (8 bytes a row) is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learnt from the labels that are not held out."""
    ship(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs.select(COLUMNS), toxicity.train(docs, labels))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    ratios = quality_rules.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.judge(docs.select(COLUMNS), ratios, with_text=True).where("kept").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the smallest id; of repeated rows of it, one."""
    folder = workspace(spark)
    classes = near_dedup.near_duplicates(docs.select("doc_id", "text"), width=SHINGLE, folder=f"{folder}/classes")
    gone = written(classes.where("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), folder, "gone")
    remove(spark, f"{folder}/classes")
    rows = docs.select(COLUMNS).join(small_or_plain(gone, BROADCAST_ROWS), F.col("doc_id") == F.col("_id"), "left_anti")
    # ids that several rows have; texts are compared only within these
    twice = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id")
    twice = written(twice, folder, "twice")
    if twice.isEmpty():
        return rows
    twice = small_or_plain(twice, BROADCAST_ROWS)
    once = rows.join(twice, F.col("doc_id") == F.col("_id"), "left_anti")
    again = rows.join(twice, F.col("doc_id") == F.col("_id"), "left_semi")
    whole = F.struct(*COLUMNS)
    again = again.groupBy("doc_id").agg(F.min(whole).alias("row")).select("row.*")
    return once.unionByName(again)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: each document's blocks, once per time they are taken; ``n_chars`` is counted anew.

    A document taken whole keeps its text as it is. One taken in part keeps the words of its blocks, with the
    white space between them, and a line end where blocks between are left out.
    """
    sizes = mixing.sized(docs)
    rows = docs.select(COLUMNS).withColumns({"size": mixing.size_of(F.col("text")), "mark": mixing.mark_of(F.col("text"))})
    mixed = mixing.mix(rows, sizes).where("taken > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(mixing.REPEATS))))
    spans = F.filter("spans", lambda x: x["times"] >= F.col("copy"))
    taken = copies.withColumn("spans", spans).where(F.size("spans") > 0)
    return mixing.cut(taken).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of them and of the decoded text."""
    ship(spark)
    coded = sentencepiece_codec.encode_decode(docs.select("doc_id", "lang", "source", "text"), sentencepiece_codec.model_path())
    return sentencepiece_codec.digests(coded, "doc_id", "lang", "source", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express compression, learnt tables, minima of hashes or piece merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    folder = workspace(spark)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), folder, name)
        if k:
            remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
