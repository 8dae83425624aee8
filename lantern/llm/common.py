"""What the operators share: the shared work folder, written tables, and small Column helpers.

Inside, the operators name their own columns with a leading underscore; such names are theirs alone.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word everywhere in these operators: a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of a batch that goes to a Python worker or comes from it, where the session has no other setting: some copies
#: of it exist at once on both sides.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they need no path of their own."""
    context = spark.sparkContext
    if spark.conf.get(BATCH[0], None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(*BATCH)
    if getattr(context, "_lantern_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lantern-"), "lantern.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._lantern_shipped = True


def workspace(spark: SparkSession) -> str:
    """A fresh folder below the shared folder of ``spark.checkpoint.dir``.

    Only in local mode, where driver and tasks are one process, a temporary folder can take its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lantern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lantern-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table and read it again: cuts the lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of strings and binary values in a table that is broadcast.
BROADCAST_BYTES = 32_000_000


def small_or_plain(df: DataFrame, limit: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``limit`` rows and ``BROADCAST_BYTES`` of text, else ``df`` as it is, for a shuffled join."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    found = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(sum(texts, F.lit(0))).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= limit and (found["bytes"] or 0) <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would change other scripts as well)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
