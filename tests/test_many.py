import datetime as dt
import math
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lantern.functions import cover
from lantern.plans import many, requests
from lantern.plans.params import SearchParams
from lantern.plans.search import search
from lantern.sources.schema import inline
from lantern.sources.shared import written
from tests.conftest import YEAR, event

TODAY = dt.date(YEAR, 3, 1)


def test_blocks_make_up_an_interval(spark):
    rng = random.Random(1)
    ranges = [(0, cover.LIMIT - 1), (5, 5), (7, 8), (0, 7), (8, 63), (1, 62), (9, 3), (63, 64)] + [tuple(sorted(rng.sample(range(5000), 2))) for _ in range(80)]
    df = spark.createDataFrame(ranges, "low long, high long")
    for r in df.select("low", "high", cover.interval_blocks(F.col("low"), F.col("high")).alias("b")).collect():
        parts = sorted((b["block"] * 8 ** b["level"], (b["block"] + 1) * 8 ** b["level"]) for b in r["b"])
        assert (not parts and r["low"] > r["high"]) or (parts[0][0] == r["low"] and parts[-1][1] == r["high"] + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False)))
        assert len(parts) <= 14 * 8
    x = spark.createDataFrame([(4097,)], "x long").select(cover.point_blocks(F.col("x")).alias("b")).first()["b"]
    assert [b["block"] for b in x] == [4097 // 8**k for k in range(8)]


def km(a, b):
    up, over = (math.sin(math.radians(x - y) / 2) ** 2 for x, y in zip(a, b, strict=True))
    return 6371.0 * 2 * math.asin(math.sqrt(min(1.0, up + math.cos(math.radians(b[0])) * math.cos(math.radians(a[0])) * over)))


@pytest.mark.parametrize("hot", [100_000, 5])
def test_radius_of_many_points_anywhere_on_the_globe(spark, monkeypatch, hot):
    """Poles, the date line, circles of every size up to the globe, and cells that are split."""
    monkeypatch.setattr(many, "HOT_CELL", hot)
    rng = random.Random(2)
    place = lambda: (round(rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), -89.99, 48.85 + rng.uniform(-1, 1)]), 6), round(rng.choice([rng.uniform(-180, 180), 180.0, -180.0, 179.99, 2.35 + rng.uniform(-1, 1)]), 6))
    venues = [(i, *map(lambda x: Decimal(str(x)), place())) for i in range(400)] + [(1000 + i, Decimal("48.85"), Decimal("2.35")) for i in range(60)] + [(2000, None, Decimal("1")), (2001, Decimal("90"), Decimal("12")), (2002, Decimal("-90"), Decimal("-180"))]
    points = [(i, *place(), rng.choice([0.1, 1.0, 30.0, 300.0, 300.0, 2000.0, 9000.0, 15000.0, 20100.0])) for i in range(150)] + [(900, 48.85, 2.35, 0.0), (901, None, 1.0, 5.0), (902, 90.0, 0.0, 5.0), (903, 0.0, 180.0, 300.0)]
    v = spark.createDataFrame(venues, "id int, lat decimal(9,6), lng decimal(9,6)")
    found = many.near_many(spark.createDataFrame(points, "request int, lat double, lng double, radius_km double"), v)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = [(r["request"], r["_near"]) for r in found.collect()]
    want = {(q, i) for q, lat, lng, radius in points if lat is not None for i, a, b in venues if a is not None and km((float(a), float(b)), (lat, lng)) <= radius}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5000


def test_many_searches_are_the_single_ones(spark, tables, tmp_path):
    rng = random.Random(3)
    day = lambda: rng.choice([None, dt.date(YEAR, 1, 1) + dt.timedelta(days=rng.randint(0, 500))])
    rows = [
        event(i, title=rng.choice(["Été au parc", "Musée", "ete", "Sport 100%"]), description=rng.choice(["au soleil", "Étang"]), isFree=rng.random() < 0.3, price=rng.choice([None, Decimal("5"), Decimal("12.5")]), ageMin=rng.choice([None, 0, 3, 17, 20]),
              ageMax=rng.choice([None, 2, 7, 18, -1]), isPermanent=rng.random() < 0.2, dateStart=day(), dateEnd=day(), setting=rng.choice([None, "INDOOR", "OUTDOOR", "BOTH"]), status=rng.choice(["APPROVED", "APPROVED", "PENDING"]), venueId=rng.randint(1, 4), categoryId=rng.randint(1, 5))
        for i in range(1, 160)
    ]
    t = tables | {"events": inline(spark, "events", rows)}
    pick = lambda *x: rng.choice(["", "", *x])
    strings = ["", "page=2&pageSize=50", "age=99", "lat=1&lng=1&radiusKm=1", f"from={YEAR}-06-01&to={YEAR}-02-01"]
    for _ in range(60):
        first = dt.date(YEAR, 1, 1) + dt.timedelta(days=rng.randint(0, 400))
        strings.append("&".join(filter(None, [pick("q=ete", "q=%C3%89t", "q=100%25"), pick("free=true", "free=false"), pick("priceMax=0", "priceMax=12.5"), pick("age=0", "age=18", "age=5"), pick(f"from={first}"), pick(f"to={first + dt.timedelta(days=rng.choice([0, 1, 40]))}"), pick("setting=INDOOR", "setting=BOTH"), pick("categoryId=2"), pick("lat=48.85&lng=2.35&radiusKm=20", "lat=48.85&lng=2.35&radiusKm=300", "lat=48&lng=2"), pick("page=2", "page=3"), pick("pageSize=3", "pageSize=7")])))
    asked = written(requests.parsed(spark.createDataFrame(list(enumerate(strings)), "request long, query string")), f"file://{tmp_path}", "asked")
    found = many.matches(t, asked, TODAY)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    found = written(found, f"file://{tmp_path}", "found")
    total = {r["request"]: r["total"] for r in many.totals(asked, found).collect()}
    page = {}
    for r in many.pages(asked, found).orderBy("request", "place").collect():
        page.setdefault(r["request"], []).append((r["id"], r["km"]))
    assert 2 not in total
    for i, r in enumerate(asked.orderBy("request").collect()):
        if r["params"] is None:
            continue
        one = search(t, SearchParams(**r["params"].asDict()), TODAY)
        got = one.rows.select("id", *([F.col("distanceKm")] if "distanceKm" in one.rows.columns else [])).collect()
        assert total[i] == one.total(), strings[i]
        assert [x for x, _ in page.get(i, [])] == [x["id"] for x in got], strings[i]
    assert max(total.values()) > 50 and min(total.values()) == 0


def test_places_meet_once_and_their_pairs_are_dealt(spark, monkeypatch):
    """Many points and venues at few places: as many meetings as places of both, over all partitions, though their bytes are few."""
    monkeypatch.setattr(many, "HOT_POINTS", 50)
    points = spark.range(2000).select(F.col("id").alias("request"), (48 + F.col("id") % 5 / 100).alias("lat"), F.lit(2.0).alias("lng"), (F.col("id") % 3 + 0.5).alias("radius_km"))
    venues = spark.range(600).select("id", (48 + F.col("id") % 6 / 100).alias("lat"), F.lit(2.0).alias("lng"))
    met = many.meetings(points, venues)
    places = met.selectExpr("_asked[0].request % 5 AS a", "_nears[0] % 6 AS b").collect()
    assert len(places) == len(set(places)) < 30
    assert met.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(met.rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).collect()) > 1
    want = sum(400 * 100 for a in range(5) for b in range(6)) - sum(1 for q in range(2000) for b in range(6) if km((48 + q % 5 / 100, 2.0), (48 + b / 100, 2.0)) > q % 3 + 0.5) * 100
    assert many.each_near(met).count() == want


def test_no_loop_holds_the_rows_of_many_meetings(spark):
    """The join of places is not compiled into one loop with the rows made of its meetings, and places are dealt by their number."""
    points = spark.range(300).select(F.col("id").alias("request"), F.lit(48.0).alias("lat"), (2 + F.col("id") % 3 / 100).alias("lng"), F.lit(50.0).alias("radius_km"))
    venues = spark.range(900).select("id", (48 + F.col("id") % 30 / 1000).alias("lat"), F.lit(2.0).alias("lng"))
    found = many.near_many(points, venues)
    assert len(found.collect()) == 300 * 900
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    stage = lambda line: re.search(r"\*\((\d+)\)", line).group(1)
    makes = {stage(x) for x in plan.splitlines() if re.search(r"Generate explode\(_(asked|nears)", x)}
    joins = [x for x in plan.splitlines() if "Join" in x and "part_of_points" in x]
    assert makes and joins and all("*(" in x and stage(x) not in makes for x in joins)
    # points of few bytes are not copied to the tasks of the venues, as few tasks would have all pairs
    assert all("SortMergeJoin" in x for x in joins)
