"""Schema versions as functions from tables to tables, in order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
#: The category that older events get, and hours where none are known.
DEFAULT_CATEGORY, OPENS, CLOSES = "Autre", "09:00", "18:00"


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Fails on the first row in which one of ``columns`` is null."""
    checked = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)) for c in columns}
    return df.withColumns(checked)


def with_constant(df: DataFrame, one: DataFrame, value: str, out: str) -> DataFrame:
    """``out`` from the single row of ``one``; null if it has none."""
    return df.crossJoin(one.agg(F.first(value).alias(out)))


def with_hours(parents: DataFrame, children: DataFrame, key: str, low: tuple[str, str, Column], high: tuple[str, str, Column], id: str = "id") -> DataFrame:
    """Smallest and largest value over the children, as ``(column, out, default)``."""
    ranges = children.groupBy(F.col(key).alias("_parent")).agg(F.min(low[0]).alias("_low"), F.max(high[0]).alias("_high"))
    rows = parents.join(ranges, F.col(id) == F.col("_parent"), "left")
    return rows.withColumns({low[1]: F.coalesce("_low", low[2]), high[1]: F.coalesce("_high", high[2])}).drop("_parent", "_low", "_high")


def create_base(tables: Tables) -> Tables:
    """The first version's tables, empty where none are given; those that are given must have its columns."""
    from lantern.sources.schema import FIRST, shaped

    spark = SparkSession.active()
    return {n: shaped(tables[n], s) if n in tables else spark.createDataFrame([], s) for n, s in FIRST.items()}


def add_categories(tables: Tables) -> Tables:
    spark = tables["events"].sparkSession
    first = [(1, DEFAULT_CATEGORY, dt.datetime(2000, 1, 1))]
    categories = spark.createDataFrame(first, "id INT, name STRING, createdAt TIMESTAMP")
    events = with_constant(tables["events"], categories.where(F.col("name") == DEFAULT_CATEGORY), "id", "categoryId")
    return tables | {"categories": categories, "events": required(events, "categoryId")}


def simplify_hours(tables: Tables) -> Tables:
    """One pair of hours for each event; which weekday they belonged to is lost."""
    events = with_hours(tables["events"], tables["opening_hours"], "eventId", ("openTime", "openTime", F.lit(OPENS)), ("closeTime", "closeTime", F.lit(CLOSES)))
    return {k: v for k, v in tables.items() if k != "opening_hours"} | {"events": required(events, "openTime", "closeTime")}


def add_keys(tables: Tables) -> Tables:
    from lantern.sources.schema import API_KEYS

    return tables | {"api_keys": tables["events"].sparkSession.createDataFrame([], API_KEYS)}


def optional_fields(tables: Tables) -> Tables:
    """Events get the columns of the last version, in its order; seven that had to be set no longer have to."""
    from lantern.sources.schema import EVENTS, shaped

    events = tables["events"].withColumns({"sourceUrl": F.lit(None).cast("string"), "isPermanent": F.lit(False)})
    return tables | {"events": shaped(events, EVENTS)}


STEPS: list[tuple[int, Callable[[Tables], Tables]]] = [(1, create_base), (2, add_categories), (3, simplify_hours), (4, add_keys), (5, optional_fields)]


def migrate(tables: Tables, version: int, to: int = STEPS[-1][0]) -> Tables:
    """From one version (0: nothing) to a later one."""
    for number, step in STEPS:
        if version < number <= to:
            tables = step(tables)
    return tables
