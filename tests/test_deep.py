import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lantern.operators import deep
from lantern.plans.search import paged


@pytest.mark.parametrize("dates", ["spread", "one", "none", "heavy"])
def test_equal_to_offset_and_limit(spark, monkeypatch, dates):
    monkeypatch.setattr(deep, "FEW", 50)
    monkeypatch.setattr(deep, "RANGES", 8)
    rng = random.Random(1)
    day = {"spread": lambda: rng.choice([None, dt.date(2030, 1, 1) + dt.timedelta(days=rng.randint(0, 900))]), "one": lambda: dt.date(2030, 1, 1), "none": lambda: None, "heavy": lambda: dt.date(2030, 1, rng.choice([1, 2, 2, 2, 2, 2, 2, 3, 28]))}[dates]
    ids = rng.sample(range(10**6), 1500)
    df = spark.createDataFrame([(i, day(), f"t{i}") for i in ids], "id int, dateStart date, title string").repartition(5).cache()
    for number, size in ((1, 12), (2, 12), (63, 12), (125, 12), (126, 12), (1, 1500), (3, 700), (10, 500)):
        want = paged(df, [F.col("dateStart").asc_nulls_first(), F.col("id")], number, size).collect()
        assert deep.by_date(df, number, size).collect() == want, (number, size)
    df.unpersist()


def test_only_a_few_rows_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(deep, "FEW", 1000)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("int").alias("id"), F.lit(None).cast("date").alias("dateStart"))
    found = deep.by_date(df, 3000, 10)
    assert [r["id"] for r in found.collect()] == list(range(29_990, 30_000))
    # the sort's input is the narrowed range
    low, high, left, held = deep._narrowed(df.withColumn("k", F.col("id").cast("long")), "k", 29_990, 10, 50_000)
    assert held < 2000 and low <= 29_990 < high and left == 29_990 - low
    assert deep.by_date(df.limit(0), 1, 5).count() == 0
