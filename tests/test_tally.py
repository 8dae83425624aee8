import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.plans import many, requests, tally
from lantern.sources.schema import inline
from lantern.sources.shared import written
from tests.conftest import YEAR, event

TODAY = dt.date(YEAR, 3, 1)


def test_first_bits():
    rng = np.random.default_rng(1)
    for n in (1, 64, 1000):
        flags = rng.random(n) < 0.2
        packed = np.packbits(flags)
        bits = np.zeros(-(-len(packed) // 8), np.uint64)
        bits.view(np.uint8)[: len(packed)] = packed
        for k in (0, 1, 6, n):
            assert tally.first_bits(bits, k).tolist() == np.flatnonzero(flags)[:k].tolist()


@pytest.mark.parametrize("segment", [1 << 18, 9])
def test_totals_and_pages_are_those_of_all_pairs(spark, tables, tmp_path, monkeypatch, segment):
    """Missing and reversed bounds, texts, places; in one segment or many."""
    monkeypatch.setattr(tally, "SEGMENT", segment)
    monkeypatch.setattr(tally, "PART", 11 if segment == 9 else 1 << 14)
    rng = random.Random(4)
    day = lambda: rng.choice([None, dt.date(YEAR, 1, 1) + dt.timedelta(days=rng.randint(0, 500))])
    rows = [
        event(i, title=rng.choice(["Été au parc", "Musée", "ete", "Sport 100%"]), description=rng.choice(["au soleil", "Étang"]), isFree=rng.random() < 0.3, price=rng.choice([None, Decimal("5"), Decimal("12.5")]), ageMin=rng.choice([None, 0, 3, 17, 20]),
              ageMax=rng.choice([None, 2, 7, 18, -1]), isPermanent=rng.random() < 0.2, dateStart=day(), dateEnd=day(), setting=rng.choice([None, "INDOOR", "OUTDOOR", "BOTH"]), status=rng.choice(["APPROVED", "APPROVED", "PENDING"]), venueId=rng.randint(1, 4), categoryId=rng.randint(1, 5))
        for i in range(1, 160)
    ]
    t = tables | {"events": inline(spark, "events", rows)}
    pick = lambda *x: rng.choice(["", "", *x])
    strings = ["", "page=2&pageSize=50", "age=99", f"from={YEAR}-06-01&to={YEAR}-02-01", "q=nowhere", "free=true&priceMax=0"]
    for _ in range(150):
        first = dt.date(YEAR, 1, 1) + dt.timedelta(days=rng.randint(0, 400))
        strings.append("&".join(filter(None, [pick("q=ete", "q=%C3%89t", "q=100%25"), pick("free=true", "free=false"), pick("priceMax=0", "priceMax=12.5"), pick("age=0", "age=18", "age=5"), pick(f"from={first}"), pick(f"to={first + dt.timedelta(days=rng.choice([0, 1, 40]))}"), pick("setting=INDOOR", "setting=BOTH"), pick("categoryId=2", "categoryId=77"), pick("lat=48.85&lng=2.35&radiusKm=20", "lat=48.85&lng=2.35&radiusKm=300", "lat=48&lng=2"), pick("page=2", "page=3"), pick("pageSize=3", "pageSize=7")])))
    folder = f"file://{tmp_path}"
    asked = written(requests.parsed(spark.createDataFrame(list(enumerate(strings)), "request long, query string")), folder, "requests")
    pairs, found = written(many.matches(t, asked, TODAY), folder, "pairs"), written(tally.tallied(t, asked, TODAY, folder), folder, "found")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(tally.totals(asked, found)) == rows_of(many.totals(asked, pairs))
    page = lambda found: rows_of(many.pages(asked, found).select("request", "place", "id", F.coalesce("km", F.lit(-1.0))))
    assert page(found) == page(pairs) and len(page(found)) > 200
    # far fewer rows than pairs leave where pages are short
    sizes = {r["request"]: r["n"] for r in asked.where("params IS NOT NULL").selectExpr("request", "params.page * params.page_size AS n").collect()}
    if segment > 1000:
        assert all(r["count"] <= 4 * sizes[r["request"]] for r in found.groupBy("request").count().collect())


def test_equal_searches_are_answered_once(spark, tables, tmp_path):
    """Many requests of a few searches, on different pages: one search each, read once, with every request's own page; a null query string too."""
    rows = [event(i, isFree=i % 3 == 0, price=Decimal(i % 20), venueId=i % 4 + 1, categoryId=i % 5 + 1, dateStart=dt.date(YEAR, 1, 1 + i % 9)) for i in range(1, 120)]
    t, folder = tables | {"events": inline(spark, "events", rows)}, f"file://{tmp_path}"
    strings = [None, "page=3&pageSize=7", "categoryId=2&pageSize=4", "categoryId=2&page=2&pageSize=4", "lat=48.85&lng=2.35&radiusKm=20&free=true&pageSize=5", "page=0"]
    sent = spark.createDataFrame([(i, strings[i % 6]) for i in range(600)], "request long, query string")
    asked = written(requests.parsed_once(sent), folder, "requests")
    as_text = lambda df: sorted(map(repr, df.select("request", "query", "params", "bad").collect()))
    assert as_text(asked) == as_text(requests.parsed(sent))
    pairs, found = written(many.matches(t, asked, TODAY), folder, "pairs"), written(tally.tallied(t, asked, TODAY, folder), folder, "found")
    near = pairs.where("request = 4").join(t["events"].select("id", "venueId"), "id").select("venueId").distinct().count()
    assert near and spark.read.parquet(f"{folder}/searches").count() == 2 + near
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(tally.totals(asked, found)) == rows_of(many.totals(asked, pairs))
    page = lambda found: rows_of(many.pages(asked, found).select("request", "place", "id", F.coalesce("km", F.lit(-1.0))))
    assert page(found) == page(pairs) and len(page(found)) > 1000


def test_few_and_many_texts_are_found_alike(spark, tables, monkeypatch):
    rows = [event(i, title=("Été au parc", "Musée", "ete", "Sport 100%")[i % 4], description=("au soleil", "rien")[i % 2]) for i in range(1, 40)]
    events, asked = inline(spark, "events", rows), spark.createDataFrame([("ete",), ("MUSEE",), ("100%",), ("soleil",), (None,), ("nowhere",)], "_q string")
    found = lambda: sorted((r["_id"], sorted(r["_texts"])) for r in tally._events(events, asked).collect())
    few = found()
    monkeypatch.setattr(tally, "TEXTS", 2)
    assert found() == few and few[0] == (1, ["MUSEE"]) and few[1] == (2, ["ete", "soleil"])
