import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lantern.functions import geo
from lantern.plans import search as s
from lantern.plans.params import Caller, InvalidParameter, Refused, SearchParams
from lantern.sources.schema import inline
from tests.conftest import YEAR, event

AS_OF = dt.date(YEAR, 5, 1)
CENTRE = {"lat": 48.8566, "lng": 2.3522}


def ids(tables, as_of=AS_OF, **how):
    return {r["id"] for r in s.search(tables, SearchParams(**how), as_of).rows.collect()}


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({}, {1, 2, 3, 4}), ({"age": 3}, {1, 2, 3}), ({"age": 13}, {3, 4}), ({"age": 0}, set()), ({"free": True}, {3}), ({"free": True, "price_max": 100.0}, {3}),
        ({"price_max": 10.0}, {1, 3}), ({"price_max": 7.0}, {1, 3}), ({"price_max": 0.0}, {3}), ({"setting": "INDOOR"}, {1, 2}), ({"setting": "OUTDOOR"}, {1, 3, 4}), ({"setting": "BOTH"}, {1}),
        ({"category_id": 1}, {1, 3}), ({"start": dt.date(YEAR, 1, 15), "end": dt.date(YEAR, 2, 1)}, {1, 2}), ({"start": dt.date(YEAR, 11, 2), "end": dt.date(YEAR, 11, 2)}, {1, 2, 4}),
        ({"q": "etang"}, {3}), ({"q": "JARDIN"}, {1}), ({"q": "%"}, set()), (CENTRE | {"radius_km": 10.0}, {1, 2}), (CENTRE | {"radius_km": 10.29}, {1, 2}),
        (CENTRE | {"radius_km": 10.3}, {1, 2, 3}), (CENTRE | {"radius_km": 31.0}, {1, 2, 3, 4}), ({"lat": 48.8566, "radius_km": 1.0}, {1, 2, 3, 4}),
    ],
)
def test_filters(tables, how, want):
    assert ids(tables, **how) == want


def test_default_start_is_the_given_day(tables):
    assert ids(tables, dt.date(YEAR, 11, 15)) == {1, 2}


def test_order_distance_and_relations(tables):
    rows = s.search(tables, SearchParams(radius_km=31.0, **CENTRE), AS_OF).rows.collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4]
    assert [r["distanceKm"] for r in rows] == [6.9, 5.1, 10.3, 30.9]
    assert rows[0]["venue"]["lat"] == 48.877778 and rows[1]["category"]["name"] == "Musée" and rows[0]["createdBy"]["displayName"] == "Z USER"
    assert rows[0]["dateStart"] == f"{YEAR}-01-01" and rows[2]["price"] is None
    assert "distanceKm" not in s.search(tables, SearchParams(), AS_OF).rows.columns


def test_edges_of_null_permanent_and_status(spark, tables):
    more = [
        event(5, status="PENDING"), event(6, status="REJECTED"), event(7, isPermanent=True, dateStart=None, dateEnd=None), event(8, dateStart=None, dateEnd=None),
        event(9, ageMax=10), event(10, ageMin=10), event(11, setting=None), event(12, price=None), event(13, description="100 % _vrai_"),
    ]
    t = tables | {"events": inline(spark, "events", more)}
    assert ids(t) == {7, 9, 10, 11, 12, 13}
    assert [r["id"] for r in s.search(t, SearchParams(), AS_OF).rows.collect()][0] == 7
    assert ids(t, age=10) == {7, 9, 10, 11, 12, 13} and ids(t, age=11) == {7, 10, 11, 12, 13}
    assert 11 in ids(t, setting="INDOOR") and 12 not in ids(t, price_max=1000.0) and ids(t, q="% _V") == {13}


def test_pages_make_up_the_whole(spark, tables):
    t = tables | {"events": inline(spark, "events", [event(i) for i in range(1, 31)])}
    pages = [s.search(t, SearchParams(page=p, page_size=7), AS_OF) for p in range(1, 7)]
    got = [[r["id"] for r in p.rows.collect()] for p in pages]
    assert sum(got, []) == list(range(1, 31)) and got[5] == [] and pages[0].total() == 30 and pages[0].pages() == 5


def test_page_plan_needs_no_full_sort(tables):
    plan = s.search(tables, SearchParams(page=2), AS_OF).rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_parse():
    p = SearchParams.parse({"q": "  ", "free": "false", "age": "0", "from": "2030-02-28", "page": "2", "pageSize": "50", "x": "y"})
    assert p.q is None and not p.free and p.age == 0 and p.start == dt.date(2030, 2, 28) and (p.page, p.page_size) == (2, 50)
    for bad in ({"age": "19"}, {"age": "1.5"}, {"from": "2030-02-31"}, {"to": "x"}, {"free": "yes"}, {"setting": "IN"}, {"radiusKm": "0.05"}, {"page": "0"}, {"pageSize": "51"}, {"q": "x" * 201}, {"lat": "91"}, {"priceMax": "nan"}):
        with pytest.raises(InvalidParameter):
            SearchParams.parse(bad)


def test_haversine_identity_and_antipode(spark):
    row = spark.range(1).select(geo.haversine_km(F.lit(10.0), F.lit(20.0), 10.0, 20.0), geo.haversine_km(F.lit(-10.0), F.lit(-160.0), 10.0, 20.0)).first()
    assert row[0] == 0.0 and abs(row[1] - 20015.09) < 0.1


@settings(max_examples=6, deadline=None)
@given(st.floats(-90, 90), st.floats(-180, 180), st.floats(0.1, 300))
def test_box_drops_nothing_in_the_radius(spark, lat, lng, radius):
    points = spark.range(4000).select((F.rand(1) * 180 - 90).alias("a"), (F.rand(2) * 360 - 180).alias("b"), (F.rand(3) * 6 - 3).alias("c"), (F.rand(4) * 6 - 3).alias("d"))
    near = points.select(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.lit(lat) + F.col("c"))).alias("lat"), ((F.lit(lng) + F.col("d") + 540) % 360 - 180).alias("lng"))
    rows = near.unionAll(points.select("a", "b"))
    lost = rows.where((geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng) <= radius) & ~geo.in_box(F.col("lat"), F.col("lng"), lat, lng, radius))
    assert lost.count() == 0


def test_reads_by_role(spark, tables):
    user, moderator, admin = Caller(3), Caller(2, "MODERATOR"), Caller(1, "ADMIN")
    t = tables | {"events": tables["events"].unionByName(inline(spark, "events", [event(5, status="PENDING", createdById=2), event(6, status="PENDING")]))}
    assert [r["id"] for r in s.mine(t, user).collect()] == [6, 4, 3, 2, 1]
    see = lambda who, i: s.detail(t, i, who).count()
    assert (see(None, 1), see(None, 5), see(user, 5), see(user, 6), see(moderator, 6), see(user, 99)) == (1, 0, 0, 1, 1, 0)
    queue = s.pending(t, moderator).collect()
    assert [r["id"] for r in queue] == [5, 6] and queue[0]["createdBy"]["email"] == "moderator@example.test" and "category" not in queue[0].asDict()
    for f in (s.pending, s.keys, s.assignable_users, s.users_with_counts):
        with pytest.raises(Refused):
            f(t, user)
    assert {r["role"]: r["events"] for r in s.users_with_counts(t, admin).collect()} == {"ADMIN": 0, "MODERATOR": 1, "USER": 5}
    assert [r["state"] for r in s.keys(t, moderator).collect()] == ["active", "revoked", "active"]
    assert [r["role"] for r in s.assignable_users(t, moderator).collect()] == ["MODERATOR", "USER"]
    assert [r["name"] for r in s.categories(t).collect()] == ["Autre", "Musée", "Parc", "Sport", "Théâtre"]
    assert s.user_by_email(t, "USER@Example.test ").count() == 1 and s.identity(t, "nothing").count() == 0
    assert Decimal(1) == 1
