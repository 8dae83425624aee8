import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lantern.operators import backfill, moderation, relations, validate
from lantern.operators import mutations as m
from lantern.plans import commands as c
from lantern.plans.params import Caller, InvalidParameter, Refused, SearchParams
from lantern.sources import geocode, schema
from lantern.sources.schema import inline
from lantern.streaming import ratelimit
from tests.conftest import YEAR, event

USER, MODERATOR, ADMIN = Caller(3), Caller(2, "MODERATOR"), Caller(1, "ADMIN")
def now():
    return F.lit(dt.datetime(YEAR, 6, 1))


def refused(code, f, *args):
    with pytest.raises(Refused) as e:
        f(*args)
    assert e.value.code == code


def test_state_machine_is_complete(spark):
    statuses, actions = ("PENDING", "APPROVED", "REJECTED"), ("approve", "reject", "edit", "nonsense")
    actors = {"author": (3, "USER"), "stranger": (4, "USER"), "moderator": (2, "MODERATOR"), "admin": (1, "ADMIN"), "author-moderator": (3, "MODERATOR")}
    cases = list(itertools.product(statuses, actions, actors))
    events = inline(spark, "events", [event(i, status=s, rejectionReason="old", moderatedById=9) for i, (s, _, _) in enumerate(cases)])
    commands = spark.createDataFrame([(i, 1, a, *actors[w], "why") for i, (_, a, w) in enumerate(cases)], "eventId int, seq int, action string, actorId int, actorRole string, reason string")
    got = {r["id"]: r for r in moderation.fold(events, commands).collect()}
    for i, (status, action, who) in enumerate(cases):
        actor, role = actors[who]
        power = role != "USER"
        want = (status, "old", 9)
        if action in ("approve", "reject") and power and status == "PENDING":
            want = ("APPROVED", None, actor) if action == "approve" else ("REJECTED", "why", actor)
        if action == "edit" and not power and actor == 3:
            want = ("PENDING", None, 9)
        r = got[i]
        assert (r["status"], r["rejectionReason"], r["moderatedById"]) == want, (status, action, who)
        assert r["applied"] + r["refused"] == 1


def test_fold_follows_the_sequence(spark):
    events = inline(spark, "events", [event(1, status="PENDING", moderatedById=None), event(2, status="PENDING")])
    rows = [(1, 3, "reject", 2, "MODERATOR", None), (1, 1, "approve", 2, "MODERATOR", None), (1, 2, "edit", 3, "USER", None), (9, 1, "approve", 2, "MODERATOR", None)]
    got = {r["id"]: r for r in moderation.fold(events, spark.createDataFrame(rows, "eventId int, seq int, action string, actorId int, actorRole string, reason string")).collect()}
    assert got[1]["status"] == "REJECTED" and got[1]["applied"] == 3 and got[2]["status"] == "PENDING" and len(got) == 2


def test_edit_delete_and_rights(spark, tables):
    change = spark.createDataFrame([("New", True)], "title string, isFree boolean")
    after = c.edit(tables, 1, change, USER)["events"].where("id = 1").first()
    assert (after["title"], after["status"], after["price"], after["moderatedById"]) == ("New", "PENDING", None, 2)
    assert c.edit(tables, 1, change, MODERATOR)["events"].where("id = 1").first()["status"] == "APPROVED"
    refused(403, c.edit, tables, 1, change, Caller(9))
    refused(404, c.delete, tables, 99, ADMIN)
    refused(403, c.delete, tables, 1, Caller(9))
    assert c.delete(tables, 1, USER)["events"].count() == 3


def test_create_reuses_and_creates_venues(spark, tables):
    schema = "title string, description string, isFree boolean, price decimal(8,2), isPermanent boolean, dateStart date, dateEnd date, categoryId int, venue struct<name:string,address:string,city:string,postalCode:string,lat:decimal(9,6),lng:decimal(9,6)>"
    day, at = dt.date(YEAR, 3, 1), (Decimal("1"), Decimal("2"))
    rows = [("x", "d", True, Decimal(9), True, day, day, 1, ("LIEU 1 ", "1 Rue", "ville", "99999", *at)), ("y", "d", False, Decimal(9), False, day, day, 1, ("Neu", "a", "b", "1", *at)), ("z", "d", False, None, False, day, day, 1, ("neu", "A", "B", "2", *at))]
    after = c.create(tables, spark.createDataFrame(rows, schema), USER, now())
    new = {r["title"]: r for r in after["events"].where("id > 4").collect()}
    assert (new["x"]["venueId"], new["x"]["price"], new["x"]["dateStart"], new["x"]["status"]) == (1, None, None, "PENDING")
    assert new["y"]["venueId"] == new["z"]["venueId"] == 5 and after["venues"].count() == 5 and sorted(r["id"] for r in new.values()) == [5, 6, 7]


def test_moderate_roles_categories_and_keys(spark, tables):
    t = tables | {"events": inline(spark, "events", [event(1, status="PENDING")])}
    assert c.moderate(t, 1, "reject", MODERATOR, "no")["events"].first()["rejectionReason"] == "no"
    refused(409, c.moderate, tables, 1, "approve", MODERATOR)
    refused(403, c.moderate, t, 1, "approve", USER)
    refused(400, c.set_role, tables, 1, "USER", ADMIN)
    assert c.set_role(tables, 3, "MODERATOR", ADMIN)["users"].where("role = 'MODERATOR'").count() == 2
    refused(409, c.save_category, tables, "musee", ADMIN, now())
    assert c.save_category(tables, "Cirque", ADMIN, now())["categories"].where("name = 'Cirque'").first()["id"] == 6
    assert c.save_category(tables, "MUSÉE", ADMIN, now(), 2)["categories"].where("id = 2").first()["name"] == "MUSÉE"
    refused(409, c.delete_category, tables, 1, ADMIN)
    assert c.delete_category(tables, 5, ADMIN)["categories"].count() == 4
    refused(403, c.issue, tables, "k", 1, "h", MODERATOR, now())
    assert c.issue(tables, "k", 3, "h", MODERATOR, now())["api_keys"].where("id = 4").first()["userId"] == 3
    refused(409, c.revoke, tables, 2, MODERATOR, now())
    assert c.revoke(tables, 1, MODERATOR, now())["api_keys"].where("revokedAt IS NULL").count() == 1


def test_seed_twice_changes_nothing(tables):
    people = [{"id": 9, "email": "USER@example.test", "passwordHash": "", "displayName": "n", "role": "ADMIN", "createdAt": dt.datetime(YEAR, 1, 1)}]
    once = c.seed(tables, ["parc", "Neuf"], people, now())
    twice = c.seed(once, ["parc", "Neuf"], people, now())
    assert once["categories"].count() == twice["categories"].count() == 6 and once["users"].count() == 3


def test_mutations_on_keys_and_uniqueness(spark, tables):
    uses = spark.createDataFrame([(1, dt.datetime(YEAR, 2, 1)), (1, dt.datetime(2000, 1, 1)), (3, dt.datetime(2001, 1, 1))], "id int, ts timestamp")
    got = {r["id"]: r["lastUsedAt"] for r in m.touched(tables["api_keys"], uses).collect()}
    assert got == {1: dt.datetime(YEAR, 2, 1), 2: None, 3: dt.datetime(2001, 1, 1)}
    assert m.deleted(tables["events"], spark.createDataFrame([(1,), (1,), (7,)], "id int")).count() == 3
    assert relations.repeated(tables["users"], "email").count() == 0 and relations.orphans(tables["events"], "venueId", tables["venues"]).count() == 0


VALID = {
    "title": "Trois", "description": "Assez long.", "sourceUrl": None, "isFree": True, "price": None, "ageMin": None, "ageMax": None, "isPermanent": True, "dateStart": None, "dateEnd": None,
    "openTime": None, "closeTime": None, "setting": None, "categoryId": 1, "venue": ("n", "a", "c", "7500", 1.0, 2.0),
}
COMMAND = (
    "title string, description string, sourceUrl string, isFree boolean, price double, ageMin int, ageMax int, isPermanent boolean, dateStart string, dateEnd string, openTime string, closeTime string, "
    "setting string, categoryId int, venue struct<name:string,address:string,city:string,postalCode:string,lat:double,lng:double>"
)


def test_first_error(spark):
    dated = {"isPermanent": False, "dateStart": "2030-01-02", "dateEnd": "2030-01-03"}
    cases = [
        ({}, None), ({"title": "  ab  "}, "title too short"), ({"title": "x" * 151}, "title too long"), ({"description": None}, "description too short"), ({"sourceUrl": ""}, None),
        ({"sourceUrl": "not a url"}, "invalid URL"), ({"sourceUrl": "https://a.b/c"}, None), ({"isFree": False}, "price required"), ({"isFree": False, "price": 0.0}, None), ({"price": -1.0}, "price out of range"),
        ({"ageMin": 18}, "ageMin out of range"), ({"ageMax": 18}, None), ({"ageMin": 5, "ageMax": 4}, "age range reversed"), ({"isPermanent": False}, "start date required"),
        ({"isPermanent": False, "dateStart": "2030-01-01"}, "end date required"), (dated, None), (dated | {"dateEnd": "2030-01-01"}, "end before start"), (dated | {"dateEnd": "2030-02-31"}, "invalid end date"),
        ({"openTime": "24:00"}, "invalid opening time"), ({"openTime": "10:00", "closeTime": "10:00"}, "opening must precede closing"), ({"openTime": "", "closeTime": "10:00"}, None),
        ({"setting": "ROOF"}, "invalid setting"), ({"categoryId": 0}, "category required"), ({"venue": ("n", "a", "c", "750", 1.0, 2.0)}, "postal code too short"),
        ({"venue": ("n", "a", "c", "7500", 91.0, 2.0)}, "latitude out of range"), ({"title": "x", "ageMin": 5, "ageMax": 4}, "title too short"),
    ]
    rows = spark.createDataFrame([tuple((VALID | x)[k] for k in VALID) for x, _ in cases], COMMAND)
    assert [r[0] for r in rows.coalesce(1).select(validate.event_error()).collect()] == [want for _, want in cases]
    one = lambda e: spark.range(1).select(e).first()[0]
    lit = F.lit
    assert one(validate.register_error(lit("a@b.fr"), lit("12345678"), lit("Jo"))) is None and one(validate.register_error(lit("a@b"), lit("1"), lit("J"))) == "invalid email"
    assert one(validate.login_error(lit("a@b.fr"), lit(""))) == "password required" and one(validate.category_error(lit("x"))) == "name too short"
    assert one(validate.moderation_error(lit("approve"), lit(None).cast("string"))) is None and one(validate.moderation_error(lit("x"), lit(""))) == "invalid action"
    assert one(validate.role_error(lit("KING"))) == "invalid role" and one(validate.key_error(lit("ok"), lit(0))) == "account required"


def test_backfills(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, title string")
    hours = inline(spark, "opening_hours", [{"id": i, "dayOfWeek": i, "openTime": o, "closeTime": z, "eventId": e} for i, (e, o, z) in enumerate([(2, "08:00", "12:00"), (3, "10:00", "11:00"), (3, "09:30", "17:00"), (3, "13:00", "20:00")])])
    after = backfill.migrate({"events": old, "opening_hours": hours}, 1)
    got = {r["id"]: (r["openTime"], r["closeTime"], r["categoryId"], r["isPermanent"], r["sourceUrl"]) for r in after["events"].collect()}
    assert got == {1: ("09:00", "18:00", 1, False, None), 2: ("08:00", "12:00", 1, False, None), 3: ("09:30", "20:00", 1, False, None)}
    assert "opening_hours" not in after and after["api_keys"].count() == 0


def test_photos_by_their_first_bytes(spark, tmp_path):
    files = {"a.jpg": "FFD8FFE0", "b.txt": "89504E470D0A1A0A00", "c.webp": "524946460000000057454250", "d.png": "3C737667", "e.jpg": ""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(bytes.fromhex(data))
    with open(tmp_path / "big.jpg", "wb") as f:
        f.write(b"\xff\xd8\xff")
        f.truncate(schema.PHOTO_BYTES + 1)
    assert {r["name"]: r["type"] for r in schema.photos(spark, str(tmp_path)).collect()} == {"a.jpg": "image/jpeg", "b.txt": "image/png", "c.webp": "image/webp"}


def test_a_table_of_a_live_database(spark, tables):
    """The database that comes with Spark, in memory; read in ranges of the key."""
    url = "jdbc:derby:memory:catalogue;create=true"
    tables["categories"].write.format("jdbc").options(url=url, dbtable="categories", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    rows = schema.jdbc(spark, url, "categories", key="id", low=1, high=6, parts=3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in rows.select("id", "name").collect()) == sorted(tuple(r) for r in tables["categories"].select("id", "name").collect())


def test_numbers_must_be_finite():
    for query in ({"priceMax": "inf"}, {"page": "inf"}, {"page": "1e400"}, {"lat": "nan"}, {"age": "-inf"}):
        with pytest.raises(InvalidParameter):
            SearchParams.parse(query)


def test_fold_is_the_steps_one_by_one(spark):
    """Random commands, each event's put through ``step``."""
    rng = random.Random(2)
    events = [(i, rng.choice(["PENDING", "APPROVED", "REJECTED"]), rng.choice([None, "old"]), rng.choice([None, 9]), 3) for i in range(40)]
    given = [(rng.randrange(42), n, rng.choice(["approve", "reject", "edit", "x", None]), rng.choice([2, 3, 4, None]), rng.choice(["USER", "MODERATOR", "ADMIN", None]), rng.choice([None, "why"])) for n in range(400)]
    df = spark.createDataFrame(events, "id int, status string, rejectionReason string, moderatedById int, createdById int")
    commands = spark.createDataFrame(given, "eventId int, seq int, action string, actorId int, actorRole string, reason string")
    entry = F.struct("seq", "action", "actorId", "actorRole", "reason")
    queued = df.join(commands.groupBy("eventId").agg(F.array_sort(F.collect_list(entry)).alias("all")), F.col("id") == F.col("eventId"), "left")
    start = F.struct("status", "rejectionReason", "moderatedById", F.lit(0).alias("applied"), F.lit(0).alias("refused")).cast(moderation.STATE)
    folded = queued.select("id", F.aggregate(F.coalesce("all", F.filter(F.array(entry_of_nulls()), lambda x: F.lit(False))), start, lambda s, c: moderation.step(s, c, F.col("createdById"))).alias("s")).select("id", "s.*")
    names = ["id", "status", "rejectionReason", "moderatedById", "applied", "refused"]
    assert sorted(map(tuple, moderation.fold(df, commands).select(names).collect())) == sorted(map(tuple, folded.select(names).collect()))


def entry_of_nulls():
    return F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("seq", "int"), ("action", "string"), ("actorId", "int"), ("actorRole", "string"), ("reason", "string"))))


def test_geocoder_shapes(spark):
    national = '{"features":[{"properties":{"label":"1 Rue X","name":"1 Rue","city":"P","postcode":"75"},"geometry":{"coordinates":[2.5,48.5]}}]}'
    world = '{"features":[' + ",".join(['{"properties":{"city":"P","street":"Rue","housenumber":"3"},"geometry":{"coordinates":[1,2]}}'] + ['{"properties":{"name":"N","postcode":"9"},"geometry":{"coordinates":[3,4]}}'] * 6) + "]}"
    bodies = spark.createDataFrame([(1, national), (2, "{"), (3, None), (4, '{"features":[]}')], "q int, body string")
    assert [tuple(r)[2:] for r in geocode.suggestions(bodies, "national").collect()] == [("1 Rue X", "1 Rue", "P", "75", 48.5, 2.5)]
    got = [tuple(r)[2:] for r in geocode.suggestions(spark.createDataFrame([(1, world)], "q int, body string"), "world").collect()]
    assert len(got) == 5 and got[0] == ("3 Rue, P", "3 Rue", "P", "", 2.0, 1.0) and got[1] == ("N, 9", "N", "", "9", 4.0, 3.0)


def test_rate_limits(spark, tmp_path):
    at = lambda m: dt.datetime(2030, 1, 1, 0, m)
    rows = [("Bearer a", at(x)) for x in (10, 14, 16, 24, 26)] + [("Basic b", at(1)), (None, at(1))]
    df = spark.createDataFrame(rows, "h string, ts timestamp").withColumn("key", ratelimit.bearer(F.col("h")))
    assert sorted((r["start"].minute, r["n"]) for r in ratelimit.windows(df, "key").collect()) == [(0, 2), (15, 3)]
    assert sorted((r["start"].minute, r["n"]) for r in ratelimit.anchored(df, "key").collect()) == [(10, 4), (26, 1)]
    assert ratelimit.exceeded(df, "key", 2).count() == 1
    df.write.parquet(f"{tmp_path}/in")
    stream = ratelimit.windows(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "key", late="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("limits").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    assert sorted((r["start"].minute, r["n"]) for r in spark.table("limits").collect()) == [(0, 2), (15, 3)]
