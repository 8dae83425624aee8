import random

from pyspark.sql import functions as F

from lantern.functions import text
from lantern.operators import rank, validate


def test_places_of_a_global_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["é", "E", "f", None, "a b"]), rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, name string, place int").repartition(6)
    found = rank.placed(df.drop("place"), [F.col("name").desc_nulls_last(), F.col("id")]).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""] + [1], r[0]))
    assert [r["id"] for r in sorted(found, key=lambda r: r["place"])] == [r[0] for r in want] and {r["place"] for r in found} == set(range(1, 501))
    alike = rank.placed(df.where("name IN ('é', 'E')").select("id", "name"), [text.by_name("name"), F.col("id")]).collect()
    assert [r["id"] for r in sorted(alike, key=lambda r: r["place"])] == sorted(r["id"] for r in alike)
    assert rank.placed(df.limit(0).drop("place"), [F.col("id")]).count() == 0


def test_forms_are_of_the_whole_text(spark):
    df = spark.createDataFrame([("09:00\n", "a@b.co\n", "https://x.y\n"), ("09:00", "a@b.co", "https://x.y")], "time string, mail string, url string")
    got = df.select(F.col("time").rlike(validate.TIME), F.col("mail").rlike(validate.EMAIL), F.col("url").rlike(validate.URL)).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, True, True)]
