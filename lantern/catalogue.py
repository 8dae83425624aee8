"""The catalogue's reads, commands and shapes, over a catalogue made of the driver's tables, each with its SQL.

Customers are users, suppliers are venues, nations are categories, orders are events, and a third of the
customers have a key. Every query calls the library's own functions; the SQL states what they mean.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.driver import KM_SQL, Query
from lantern.functions import shape, text
from lantern.operators import backfill, mutations, predicates, rank, relations, validate
from lantern.plans import commands, search, statements
from lantern.plans.params import Caller, SearchParams
from lantern.sources import geocode, schema
from lantern.streaming import ratelimit

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ADMIN, MODERATOR, OWNER = Caller(1, "ADMIN"), Caller(2, "MODERATOR"), Caller(43)
NOW = dt.datetime(2001, 1, 1)


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BASE_SQL}{sql}" if sql.startswith(",") else f"WITH {BASE_SQL} {sql}"
        return f

    return add


BASE_SQL = """users AS (SELECT c_custkey + 1 AS id, 'u' || c_custkey || '@example.org' AS email, c_name AS "displayName",
        CASE c_custkey % 10 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'MODERATOR' ELSE 'USER' END AS role, TIMESTAMP '2000-01-01' + INTERVAL 1 HOUR * c_custkey AS "createdAt" FROM customer),
    venues AS (SELECT s_suppkey + 1 AS id, s_name AS name, s_nationkey || ' rue' AS address, 'Ville ' || (s_nationkey % 5) AS city, CAST(75000 + s_nationkey AS VARCHAR) AS "postalCode",
        CAST(CAST(48.8566::DOUBLE + ((s_suppkey * 37) % 101 - 50) / 100.0::DOUBLE AS DECIMAL(9,6)) AS DOUBLE) AS lat, CAST(CAST(2.3522::DOUBLE + ((s_suppkey * 53) % 103 - 51) / 100.0::DOUBLE AS DECIMAL(9,6)) AS DOUBLE) AS lng FROM supplier),
    categories AS (SELECT n_nationkey + 1 AS id, n_name AS name FROM nation),
    entries AS (SELECT k + 1 AS id, 'Sortie ' || k || CASE WHEN k % 3 = 0 THEN ' Été' ELSE ' hiver' END AS title, 'Une description, ' || o_orderpriority AS description, k % 7 = 0 AS "isFree",
        CASE WHEN k % 7 <> 0 THEN floor(o_totalprice / 1000) END AS price, nullif(k % 10, 0) AS "ageMin", CASE WHEN k % 13 <> 0 THEN k % 10 + 5 END AS "ageMax", k % 11 = 0 AS "isPermanent",
        CASE WHEN k % 11 <> 0 THEN day END AS "dateStart", CASE WHEN k % 11 <> 0 THEN day + CAST(k % 60 AS INTEGER) END AS "dateEnd", CASE k % 4 WHEN 0 THEN 'INDOOR' WHEN 1 THEN 'OUTDOOR' WHEN 2 THEN 'BOTH' END AS setting,
        CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'no' END AS reason, o_orderdate AS "createdAt",
        k % 10 + 1 AS "venueId", k % 25 + 1 AS "categoryId", o_custkey + 1 AS "createdById" FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders)),
    keys AS (SELECT c_custkey + 1 AS id, 'key ' || c_custkey AS name, sha256('secret' || c_custkey) AS hash, c_custkey % 6 = 0 AS revoked, c_custkey + 1 AS "userId" FROM customer WHERE c_custkey % 3 = 0),
    rel AS (SELECT e.*, v.name AS venue_name, v.lat AS venue_lat, v.lng AS venue_lng, c.name AS category_name, u."displayName" AS author, u.email AS author_email
        FROM entries e JOIN venues v ON v.id = e."venueId" JOIN categories c ON c.id = e."categoryId" JOIN users u ON u.id = e."createdById")"""


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The catalogue, with its declared schemas."""
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    c, k, s = F.col("c_custkey"), F.col("o_orderkey"), F.col("s_suppkey")
    since = lambda n: F.timestamp_seconds(F.lit(946_684_800) + n * 3600)
    text_of = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    none = F.lit(None)
    day = F.when(k % 11 != 0, F.to_date("o_orderdate"))
    rows = {
        "users": read("customer").select(
            (c + 1).alias("id"), text_of("u", c, "@example.org").alias("email"), F.lit("x").alias("passwordHash"), F.col("c_name").alias("displayName"),
            F.when(c % 10 == 0, "ADMIN").when(c % 10 == 1, "MODERATOR").otherwise("USER").alias("role"), since(c).alias("createdAt"),
        ),
        "venues": read("supplier").select(
            (s + 1).alias("id"), F.col("s_name").alias("name"), text_of(F.col("s_nationkey"), " rue").alias("address"), text_of("Ville ", F.col("s_nationkey") % 5).alias("city"), (75_000 + F.col("s_nationkey")).alias("postalCode"),
            (F.lit(48.8566) + ((s * 37) % 101 - 50) / F.lit(100.0)).alias("lat"), (F.lit(2.3522) + ((s * 53) % 103 - 51) / F.lit(100.0)).alias("lng"),
        ),
        "categories": read("nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("name"), since(F.lit(0)).alias("createdAt")),
        "events": read("orders").select(
            (k + 1).alias("id"), text_of("Sortie ", k, F.when(k % 3 == 0, " Été").otherwise(" hiver")).alias("title"), text_of("Une description, ", F.col("o_orderpriority")).alias("description"), none.alias("sourceUrl"),
            (k % 7 == 0).alias("isFree"), F.when(k % 7 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("price"), none.alias("photoUrl"), F.nullif(k % 10, F.lit(0)).alias("ageMin"), F.when(k % 13 != 0, k % 10 + 5).alias("ageMax"),
            (k % 11 == 0).alias("isPermanent"), day.alias("dateStart"), F.date_add(day, (k % 60).cast("int")).alias("dateEnd"), F.lit("10:00").alias("openTime"), F.lit("18:00").alias("closeTime"),
            F.when(k % 4 == 0, "INDOOR").when(k % 4 == 1, "OUTDOOR").when(k % 4 == 2, "BOTH").alias("setting"),
            F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("REJECTED").alias("status"), F.when(F.col("o_orderstatus") == "P", "no").alias("rejectionReason"),
            F.col("o_orderdate").alias("createdAt"), (k % 10 + 1).alias("venueId"), (k % 25 + 1).alias("categoryId"), (F.col("o_custkey") + 1).alias("createdById"), none.alias("moderatedById"),
        ),
        "api_keys": read("customer").where(c % 3 == 0).select(
            (c + 1).alias("id"), text_of("key ", c).alias("name"), F.sha2(text_of("secret", c), 256).alias("keyHash"), since(c).alias("createdAt"), none.alias("lastUsedAt"), F.when(c % 6 == 0, since(c)).alias("revokedAt"), (c + 1).alias("userId"),
        ),
    }
    # the driver's keys are longer than the catalogue's
    return {n: df.select(*(F.col(f.name).cast(f.dataType) for f in schema.struct(n))) for n, df in rows.items()}


def flat(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "title", "price", "dateStart", F.col("venue.name").alias("venue_name"), F.col("venue.lat").alias("venue_lat"), F.col("createdBy.displayName").alias("author"), *more)


FLAT = "id, title, CAST(price AS DOUBLE) AS price, strftime(\"dateStart\", '%Y-%m-%d') AS \"dateStart\", venue_name, venue_lat, author"


@query(f""", m AS (SELECT *, {KM_SQL.replace("lat", "venue_lat").replace("lng", "venue_lng").replace("48.8566", "48.85").replace("2.3522", "2.35")} AS km FROM rel),
    f AS (SELECT * FROM m WHERE status = 'APPROVED' AND (contains(strip_accents(lower(title)), 'ete') OR contains(strip_accents(lower(description)), 'ete')) AND ("isFree" OR price <= 300)
      AND ("ageMin" IS NULL OR "ageMin" <= 6) AND ("ageMax" IS NULL OR "ageMax" >= 6) AND ("isPermanent" OR "dateEnd" >= DATE '1995-01-01') AND ("isPermanent" OR "dateStart" <= DATE '1998-12-31')
      AND (setting IS NULL OR setting IN ('INDOOR', 'BOTH')) AND km <= 60.0::DOUBLE)
    SELECT {FLAT}, category_name, floor(km * 10 + 0.5::DOUBLE) / 10 AS "distanceKm", (SELECT count(*) FROM f) AS total FROM f ORDER BY f."dateStart" NULLS FIRST, id LIMIT 5 OFFSET 5""")
def search_page(spark, d):
    """Every filter of a search at once, its second page, and the total."""
    asked = {"q": " Ete ", "priceMax": "300", "age": "6", "from": "1995-01-01", "to": "1998-12-31", "setting": "INDOOR", "lat": "48.85", "lng": "2.35", "radiusKm": "60", "page": "2", "pageSize": "5"}
    found = search.search(tables(spark, d), SearchParams.parse(asked), dt.date(2030, 1, 1))
    rows = flat(found.rows, F.col("category.name").alias("category_name"), "distanceKm")
    return rows.crossJoin(found.matches.agg(F.count(F.lit(1)).alias("total")))


@query(f"""SELECT {FLAT} FROM rel WHERE status = 'APPROVED' AND ("isPermanent" OR "dateEnd" >= DATE '1997-01-01') ORDER BY rel."dateStart" NULLS FIRST, id LIMIT 12""")
def search_defaults(spark, d):
    """No filter given: from today on, first page of twelve; a point without a radius counts for nothing."""
    return flat(search.search(tables(spark, d), SearchParams.parse({"lat": "1", "lng": "2"}), dt.date(1997, 1, 1)).rows)


@query(f"""SELECT {FLAT} FROM rel WHERE status = 'APPROVED' AND "isFree" AND "categoryId" = 8 AND ("isPermanent" OR "dateEnd" >= DATE '1992-01-01') ORDER BY rel."dateStart" NULLS FIRST, id LIMIT 50""")
def search_free_in_category(spark, d):
    """Free suppresses the price cap."""
    asked = SearchParams.parse({"free": "true", "priceMax": "0", "categoryId": "8", "pageSize": "50"})
    return flat(search.search(tables(spark, d), asked, dt.date(1992, 1, 1)).rows)


@query(f"SELECT {FLAT}, status FROM rel WHERE \"createdById\" = 43")
def my_events(spark, d):
    return flat(search.mine(tables(spark, d), OWNER), "status")


@query(f"SELECT {FLAT} FROM rel WHERE (id = 5 AND status = 'APPROVED') OR (id = 7 AND (status = 'APPROVED' OR \"createdById\" = 43)) OR id = 9")
def event_details(spark, d):
    """As seen by nobody, by a user and by a moderator; what is hidden is no row."""
    t = tables(spark, d)
    return flat(search.detail(t, 5, None)).unionAll(flat(search.detail(t, 7, OWNER))).unionAll(flat(search.detail(t, 9, MODERATOR)))


@query(f"SELECT {FLAT}, author_email, row_number() OVER (ORDER BY rel.\"createdAt\", rel.id) AS place, count(*) OVER () AS queued FROM rel WHERE status = 'PENDING'")
def moderation_queue(spark, d):
    """With the authors' emails, the place in the queue, and its length."""
    rows = search.pending(tables(spark, d), MODERATOR)
    length = rows.agg(F.count(F.lit(1)).alias("queued"))
    found = rank.placed(flat(rows, "createdAt", F.col("createdBy.email").alias("author_email")), [F.col("createdAt"), F.col("id")])
    return found.drop("createdAt").crossJoin(length)


@query('SELECT id, email, "displayName", role, coalesce(n, 0) AS events FROM users LEFT JOIN (SELECT "createdById" AS author, count(*) AS n FROM entries GROUP BY 1) ON author = id')
def users_with_event_counts(spark, d):
    return search.users_with_counts(tables(spark, d), ADMIN).select("id", "email", "displayName", "role", "events")


@query("SELECT id, name, row_number() OVER (ORDER BY strip_accents(lower(name)), id) AS place FROM categories")
def categories_by_name(spark, d):
    rows = search.categories(tables(spark, d)).select("id", "name")
    return rank.placed(rows, [text.by_name("name"), F.col("id")])


@query('SELECT k.id, k.name, CASE WHEN revoked THEN \'revoked\' ELSE \'active\' END AS state, u.email, u.role, strftime(u."createdAt", \'%Y-%m-%d %H\') AS since FROM keys k JOIN users u ON u.id = "userId"')
def keys_with_users(spark, d):
    """Hashes are never among the columns."""
    rows = search.keys(tables(spark, d), MODERATOR)
    assert "keyHash" not in rows.columns
    return rows.select("id", "name", "state", "user.email", "user.role", F.date_format("createdAt", "yyyy-MM-dd HH").alias("since"))


@query("""SELECT id, "displayName", role, row_number() OVER (ORDER BY strip_accents(lower("displayName")), id) AS place FROM users WHERE role IN ('USER', 'MODERATOR')""")
def assignable_users(spark, d):
    rows = search.assignable_users(tables(spark, d), MODERATOR).select("id", "displayName", "role")
    return rank.placed(rows, [text.by_name("displayName"), F.col("id")])


@query("SELECT id, email FROM users WHERE email = 'u42@example.org'")
def user_by_email(spark, d):
    """Case and trailing spaces do not matter."""
    return search.user_by_email(tables(spark, d), "U42@Example.ORG  ").select("id", "email")


@query("""SELECT k.id AS "keyId", u.id AS "userId", u.email, u.role FROM keys k JOIN users u ON u.id = k."userId" WHERE NOT revoked AND hash IN (sha256('secret33'), sha256('secret36'), sha256('nobody'))""")
def identity_of_keys(spark, d):
    """An active key, a revoked one and an unknown one, each by its secret."""
    t = tables(spark, d)
    found = [search.identity(t, s).select("keyId", "userId", "email", "role") for s in ("secret33", "secret36", "nobody")]
    return found[0].unionAll(found[1]).unionAll(found[2])


NEW_SQL = """n AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS free FROM orders WHERE o_orderkey % 50 = 0),
    w AS (SELECT k, free, CASE WHEN k % 100 = 0 THEN v.name ELSE 'Salle ' || (k % 4) END AS name, CASE WHEN k % 100 = 0 THEN v.address ELSE 'Quai' END AS address, CASE WHEN k % 100 = 0 THEN v.city ELSE 'Port' END AS city FROM n JOIN venues v ON v.id = k % 10 + 1)"""


def _new_events(spark, d):
    k = F.col("o_orderkey")
    venues = tables(spark, d)["venues"].select(F.col("id").alias("at"), "name", "address", "city")
    old = k % 100 == 0
    rows = spark.read.parquet(f"{d}/orders.parquet").where(k % 50 == 0).join(venues, k % 10 + 1 == F.col("at"))
    given = lambda name, other: F.when(old, F.upper(F.col(name)) if name == "name" else F.col(name)).otherwise(other).alias(name)
    venue = F.struct(
        given("name", F.concat(F.lit("Salle "), k % 4)), given("address", F.lit("Quai")), given("city", F.lit("Port")), F.lit("13000").alias("postalCode"),
        F.lit(43).cast("decimal(9,6)").alias("lat"), F.lit(5).cast("decimal(9,6)").alias("lng"),
    )
    values = {
        "id": F.lit(None), "title": F.concat(F.lit("Neuf "), k), "description": F.lit("Une description."), "isFree": k % 2 == 0, "price": F.lit(9), "isPermanent": k % 3 == 0,
        "dateStart": F.to_date(F.lit("2001-02-03")), "dateEnd": F.to_date(F.lit("2001-02-04")), "categoryId": F.lit(1), "venue": venue,
    }
    kinds = {f.name: f.dataType for f in schema.struct("events")}
    return rows.select(*((c.cast(kinds[n]) if n in kinds else c).alias(n) for n, c in values.items()), *(F.lit(None).cast(t).alias(n) for n, t in kinds.items() if n not in values and n not in ("venueId", "status", "createdById", "createdAt", "rejectionReason", "moderatedById")))


@query(f""", {NEW_SQL}, made AS (SELECT DISTINCT name, address, city FROM w WHERE k % 100 <> 0)
    SELECT 'Neuf ' || k AS title, CASE WHEN NOT free THEN 9.0 END AS price, CASE WHEN k % 3 <> 0 THEN '2001-02-03' END AS "dateStart", 'PENDING' AS status, 43 AS "createdById", name AS venue_name, city,
        (SELECT count(*) FROM venues) + (SELECT count(*) FROM made) AS n_venues, (SELECT count(*) FROM entries) + (SELECT count(*) FROM w) AS n_ids FROM w""")
def create_events(spark, d):
    """Venues are reused, without regard to case, or created once; free events lose their price, permanent ones their dates."""
    t = tables(spark, d)
    after = commands.create(t, _new_events(spark, d), OWNER, F.lit(NOW))
    venues = after["venues"].select(F.col("id").alias("at"), F.col("name").alias("venue_name"), "city")
    rows = after["events"].where(F.startswith("title", F.lit("Neuf "))).join(venues, F.col("venueId") == F.col("at"))
    sizes = after["venues"].agg(F.count_distinct("id").alias("n_venues")).crossJoin(after["events"].agg(F.count_distinct("id").alias("n_ids")))
    rows = rows.select("title", F.col("price").cast("double").alias("price"), shape.day(F.col("dateStart")).alias("dateStart"), "status", "createdById", "venue_name", "city")
    return rows.crossJoin(sizes)


EDITED = "CASE WHEN id = 8 THEN 'Neuf' ELSE title END AS title, CASE WHEN id = 8 THEN {} ELSE status END AS status, CASE WHEN id = 8 THEN {} ELSE reason END AS reason"


@query("SELECT id, " + EDITED.format("'PENDING'", "NULL") + ", 'author' AS by FROM entries UNION ALL SELECT id, " + EDITED.format("status", "reason") + ", 'moderator' FROM entries")
def edit_event(spark, d):
    """The author's own edit goes back to the queue; a moderator's does not."""
    t = tables(spark, d)
    owner = t["events"].where("id = 8").first()["createdById"]
    change = spark.createDataFrame([("Neuf",)], "title string")
    shown = lambda after, by: after["events"].select("id", "title", "status", F.col("rejectionReason").alias("reason"), F.lit(by).alias("by"))
    # whoever the author is, their role counts here as a user's
    return shown(commands.edit(t, 8, change, Caller(owner)), "author").unionAll(shown(commands.edit(t, 8, change, MODERATOR), "moderator"))


@query("SELECT id FROM entries WHERE id <> 8 AND id % 5 <> 0")
def delete_events(spark, d):
    """One by a command, others by a relation of ids."""
    t = commands.delete(tables(spark, d), 8, MODERATOR)
    gone = t["events"].where("id % 5 = 0").select("id")
    return mutations.deleted(t["events"], gone.unionAll(gone)).select("id")


@query("""SELECT id, CASE WHEN id = p THEN 'REJECTED' ELSE status END AS status, CASE WHEN id = p THEN 'trop loin' ELSE reason END AS reason, CASE WHEN id = p THEN 2 END AS moderator
    FROM entries, (SELECT min(id) AS p FROM entries WHERE status = 'PENDING')""")
def moderate_event(spark, d):
    t = tables(spark, d)
    first = t["events"].where("status = 'PENDING'").agg(F.min("id")).first()[0]
    after = commands.moderate(t, first, "reject", MODERATOR, "trop loin")
    return after["events"].select("id", "status", F.col("rejectionReason").alias("reason"), F.col("moderatedById").alias("moderator"))


@query("SELECT id, CASE WHEN id = 43 THEN 'MODERATOR' ELSE role END AS role FROM users")
def set_role(spark, d):
    return commands.set_role(tables(spark, d), 43, "MODERATOR", ADMIN)["users"].select("id", "role")


@query("SELECT id, CASE WHEN id = 3 THEN 'Musée' ELSE name END AS name FROM categories UNION ALL SELECT 26, 'Cirque'")
def save_categories(spark, d):
    """One is renamed, one added, and another added and deleted again."""
    t = commands.save_category(tables(spark, d), "Musée", ADMIN, F.lit(NOW), 3)
    t = commands.save_category(t, "Cirque", ADMIN, F.lit(NOW))
    t = commands.save_category(t, "Vide", ADMIN, F.lit(NOW))
    return commands.delete_category(t, 27, ADMIN)["categories"].select("id", "name")


@query("""SELECT id, name, CASE WHEN revoked OR id = 4 THEN 'revoked' ELSE 'active' END AS state, "userId" FROM keys UNION ALL SELECT (SELECT max(id) + 1 FROM keys), 'neuve', 'active', 43""")
def issue_and_revoke_keys(spark, d):
    t = commands.issue(tables(spark, d), "neuve", 43, "h", MODERATOR, F.lit(NOW))
    return commands.revoke(t, 4, MODERATOR, F.lit(NOW))["api_keys"].select("id", "name", shape.key_state(F.col("revokedAt")).alias("state"), "userId")


@query("SELECT id, CASE WHEN id = 1 THEN '2001-01-01 00' WHEN id = 4 THEN '2000-06-01 05' END AS last FROM keys")
def touched_keys(spark, d):
    """The latest use of a batch counts."""
    uses = spark.createDataFrame([(1, NOW), (1, dt.datetime(2000, 1, 1)), (4, dt.datetime(2000, 6, 1, 5)), (5, NOW)], "id int, ts timestamp")
    return mutations.touched(tables(spark, d)["api_keys"], uses).select("id", F.date_format("lastUsedAt", "yyyy-MM-dd HH").alias("last"))


@query("SELECT name, 'category' AS kind FROM categories UNION ALL VALUES ('Parc', 'category'), ('Été', 'category') UNION ALL SELECT email, 'user' FROM users UNION ALL SELECT 'seed@example.org', 'user'")
def seed_tables(spark, d):
    """What is there stays; names alike but for case and accents are there."""
    people = [{"id": 900_000, "email": e, "passwordHash": "x", "displayName": "S", "role": "USER", "createdAt": NOW} for e in ("seed@example.org", "U5@EXAMPLE.org")]
    t = commands.seed(tables(spark, d), ["Parc", "nation_3", "Été"], people, F.lit(NOW))
    return t["categories"].select("name", F.lit("category").alias("kind")).unionAll(t["users"].select("email", F.lit("user")))


@query("""SELECT id, provider, rank, CASE provider WHEN 'national' THEN name || ', ' || city ELSE concat_ws(', ', CASE WHEN rank % 2 = 0 THEN name ELSE rank || ' ' || address END, "postalCode", city) END AS label,
        CASE WHEN provider = 'national' OR rank % 2 = 0 THEN name ELSE rank || ' ' || address END AS name, city, "postalCode" AS postcode, lat, lng
    FROM venues, (VALUES ('national'), ('world')) p(provider), range(5) r(rank) WHERE id % 3 = 0""")
def address_suggestions(spark, d):
    """Seven features a payload, of which five are shown; broken payloads give none."""
    venues = tables(spark, d)["venues"]
    spot = F.struct(F.array(F.col("lng").cast("double"), F.col("lat").cast("double")).alias("coordinates")).alias("geometry")
    def payload(provider):
        def feature(i):
            if provider == "national":
                properties = F.struct(F.concat_ws(", ", "name", "city").alias("label"), "name", "city", F.col("postalCode").alias("postcode"))
            else:
                properties = F.struct(F.when(i % 2 == 0, F.col("name")).otherwise("").alias("name"), "city", F.col("postalCode").alias("postcode"), F.col("address").alias("street"), i.cast("string").alias("housenumber"))
            return F.struct(properties.alias("properties"), spot)

        return F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(6)), feature).alias("features")))
    rows = [venues.select("id", F.lit(p).alias("provider"), F.when(F.col("id") % 3 == 0, payload(p)).when(F.col("id") % 3 == 1, "{").alias("body")) for p in ("national", "world")]
    shown = [geocode.suggestions(r, p) for r, p in zip(rows, ("national", "world"), strict=True)]
    return shown[0].unionByName(shown[1])


@query("""SELECT doc_id, CASE WHEN length(q) >= 3 THEN 'https://geo.example.org/?q=' || replace(replace(replace(replace(replace(url_encode(q), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') || '&limit=5' END AS url
    FROM (SELECT doc_id, trim(substr(text, 1, CAST(doc_id % 40 AS INTEGER)), ' ' || chr(10) || chr(9) || chr(160)) AS q FROM documents)""")
def request_urls(spark, d):
    """A query of a document's first letters, encoded as part of a URL."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    q = F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 40).cast("int"))
    return docs.select("doc_id", geocode.request_url("https://geo.example.org/", q).alias("url"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 5 = 0 AS malformed FROM events")
def json_records(spark, d):
    """Bodies of which each fifth is cut off."""
    body = F.when(F.col("event_id") % 5 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    rows = schema.records(spark.read.parquet(f"{d}/events.parquet").select("event_id", body.alias("body")), "k BIGINT")
    return rows.select("event_id", F.col("record.k").alias("k"), "malformed")


@query("SELECT CAST(to_json({'id': id, 'email': email, 'displayName': \"displayName\", 'role': role}) AS VARCHAR) AS line FROM users")
def json_lines(spark, d):
    return tables(spark, d)["users"].select(shape.as_json("id", "email", "displayName", "role").alias("line"))


@query("""SELECT id, CASE WHEN "isPermanent" OR "dateStart" IS NULL THEN 'Toute l’année' WHEN "dateStart" = "dateEnd" THEN strftime("dateStart", '%Y-%m-%d') ELSE strftime("dateStart", '%Y-%m-%d') || ' → ' || strftime("dateEnd", '%Y-%m-%d') END AS dates,
        "ageMin" || ' - ' || "ageMax" AS ages, CASE setting WHEN 'INDOOR' THEN 'Intérieur' WHEN 'OUTDOOR' THEN 'Extérieur' WHEN 'BOTH' THEN 'Intérieur & extérieur' END AS setting,
        'https://map.example.org/' || lat || ',' || lng AS map FROM (SELECT e.*, printf('%.6f', v.lat) AS lat, printf('%.6f', v.lng) AS lng FROM entries e JOIN venues v ON v.id = e."venueId")""")
def card_labels(spark, d):
    t = tables(spark, d)
    at = t["venues"].select(F.col("id").alias("at"), "lat", "lng")
    c = F.col
    return t["events"].join(at, c("venueId") == c("at")).select(
        "id", shape.date_label(c("isPermanent"), c("dateStart"), c("dateEnd")).alias("dates"), shape.both(c("ageMin"), c("ageMax"), " - ").alias("ages"),
        shape.label(c("setting"), shape.SETTING_LABELS).alias("setting"), shape.map_url("https://map.example.org/", c("lat"), c("lng")).alias("map"),
    )


@query("""SELECT k AS id, CASE WHEN k % 37 = 0 THEN 'title too short' WHEN k % 37 = 1 THEN 'description too long' WHEN k % 37 = 2 THEN 'invalid URL' WHEN k % 37 = 3 THEN 'URL too long' WHEN k % 37 = 4 THEN 'isFree required'
      WHEN k % 37 = 5 THEN 'price out of range' WHEN k % 37 = 6 THEN 'ageMin out of range' WHEN k % 37 = 7 THEN 'ageMax out of range' WHEN k % 37 = 8 THEN 'invalid start date' WHEN k % 37 = 9 THEN 'invalid end date'
      WHEN k % 37 = 10 THEN 'invalid opening time' WHEN k % 37 = 11 THEN 'invalid closing time' WHEN k % 37 = 12 THEN 'invalid setting' WHEN k % 37 = 13 THEN 'category required' WHEN k % 37 = 14 THEN 'venue name required'
      WHEN k % 37 = 15 THEN 'postal code too short' WHEN k % 37 = 16 THEN 'latitude out of range' WHEN k % 37 = 17 THEN 'age range reversed' WHEN k % 37 = 18 THEN 'start date required' WHEN k % 37 = 19 THEN 'end before start'
      WHEN k % 37 = 20 THEN 'price required' WHEN k % 37 = 21 THEN 'opening must precede closing' END AS error FROM (SELECT o_orderkey AS k FROM orders)""")
def event_errors(spark, d):
    """One fault each, and sound ones."""
    k = F.col("o_orderkey")
    fault = lambda n, bad, good: F.when(k % 37 == n, bad).otherwise(good)
    text_or = lambda x: F.lit(x).cast("string")
    url = F.when(k % 37 == 2, "no url").when(k % 37 == 3, F.concat(F.lit("https://a.b/"), F.repeat(F.lit("x"), 500))).when(k % 2 == 0, "").otherwise("https://a.b/c")
    venue = F.struct(
        fault(14, F.lit("  "), F.lit("n")).alias("name"), F.lit("a").alias("address"), F.lit("c").alias("city"), fault(15, F.lit("750"), F.lit("7500")).alias("postalCode"),
        fault(16, F.lit(91.0), F.lit(48.0)).alias("lat"), F.lit(2.0).alias("lng"),
    )
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("id"), fault(0, F.lit("  ab "), F.lit("Trois")).alias("title"), fault(1, F.repeat(F.lit("x"), 10_001), F.lit("Assez long.")).alias("description"), url.alias("sourceUrl"),
        F.when(k % 37 == 4, F.lit(None)).otherwise(k % 37 != 20).alias("isFree"), F.when(k % 37 == 5, F.lit(100_001.0)).alias("price"),
        F.when(k % 37 == 6, 18).when(k % 37 == 17, 9).alias("ageMin"), F.when(k % 37 == 7, 19).when(k % 37 == 17, 8).alias("ageMax"), (k % 37 != 18).alias("isPermanent"),
        F.when(k % 37 == 8, "01/02/2030").when(k % 37 == 19, "2030-02-02").alias("dateStart"), F.when(k % 37 == 9, "2030-02-31").when(k % 37 == 19, "2030-02-01").alias("dateEnd"),
        fault(10, F.lit("24:00"), fault(21, F.lit("18:00"), text_or("09:00"))).alias("openTime"), fault(11, F.lit("9:00"), text_or("18:00")).alias("closeTime"),
        fault(12, F.lit("ROOF"), text_or(None)).alias("setting"), fault(13, F.lit(0), F.lit(1)).alias("categoryId"), venue.alias("venue"),
    )
    return rows.select("id", validate.event_error().alias("error"))


@query("""SELECT id, CASE id % 7 WHEN 0 THEN 'invalid email' WHEN 1 THEN 'invalid email' WHEN 2 THEN 'invalid email' WHEN 3 THEN 'password too short' WHEN 4 THEN 'name too short' END AS register,
        CASE WHEN id % 7 IN (0, 1, 2) THEN 'invalid email' WHEN id % 7 = 3 THEN 'password required' END AS login, CASE id % 3 WHEN 0 THEN 'invalid action' WHEN 1 THEN 'reason too long' END AS moderation,
        CASE WHEN id % 2 = 0 THEN 'invalid role' END AS role, CASE id % 3 WHEN 0 THEN 'name too long' WHEN 1 THEN 'account required' END AS key, CASE id % 3 WHEN 0 THEN 'name too short' WHEN 1 THEN 'name too long' END AS category FROM users""")
def account_errors(spark, d):
    id = F.col("id")
    email = F.when(id % 7 == 0, ".a@b.co").when(id % 7 == 1, "a..b@c.co").when(id % 7 == 2, "a@b").otherwise(F.col("email"))
    password = F.when(id % 7 == 3, "").otherwise("12345678")
    reason = F.when(id % 3 == 1, F.repeat(F.lit("x"), 1001))
    names = F.when(id % 3 == 0, F.repeat(F.lit("x"), 101)).otherwise("clé")
    return tables(spark, d)["users"].select(
        "id", validate.register_error(email, password, F.when(id % 7 == 4, "J").otherwise("Jo")).alias("register"), validate.login_error(email, password).alias("login"),
        validate.moderation_error(F.when(id % 3 == 0, "burn").otherwise("reject"), reason).alias("moderation"), validate.role_error(F.when(id % 2 == 0, "KING").otherwise("ADMIN")).alias("role"),
        validate.key_error(names, F.when(id % 3 == 1, 0).otherwise(1)).alias("key"), validate.category_error(F.when(id % 3 == 0, " x ").when(id % 3 == 1, F.repeat(F.lit("x"), 51)).otherwise("Parc")).alias("category"),
    )


@query("""SELECT id, title, 1 AS "categoryId", coalesce(low, '09:00') AS "openTime", coalesce(high, '18:00') AS "closeTime", FALSE AS "isPermanent", 22 AS n_columns, 0 AS n_keys FROM entries
    LEFT JOIN (SELECT l_orderkey + 1 AS event, min(strftime(l_shipdate, '%d:%m')) AS low, max(strftime(l_shipdate, '%d:%m')) AS high FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) ON event = id""")
def migrate_all_versions(spark, d):
    """From nothing but the first version's rows through every version."""
    t = tables(spark, d)
    items = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 3 <> 0")
    clock = F.date_format("l_shipdate", "dd:MM")
    hours = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("id"), F.lit(1).alias("dayOfWeek"), clock.alias("openTime"), clock.alias("closeTime"), (F.col("l_orderkey") + 1).cast("int").alias("eventId"))
    first = ["id", "title", "description", "isFree", "price", "photoUrl", "ageMin", "ageMax", "dateStart", "dateEnd", "setting", "status", "rejectionReason", "createdAt", "venueId", "createdById", "moderatedById"]
    after = backfill.migrate({"users": t["users"], "venues": t["venues"], "events": t["events"].select(first), "opening_hours": hours}, 0)
    events = after["events"]
    rows = events.select("id", "title", "categoryId", "openTime", "closeTime", "isPermanent", F.lit(len(events.columns)).alias("n_columns"))
    return rows.crossJoin(after["api_keys"].agg(F.count(F.lit(1)).alias("n_keys")))


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE name END AS name, CASE WHEN id % 4 = 0 THEN 'Ville' ELSE city END AS city FROM venues""")
def updated_rows(spark, d):
    """Null is a value that a change can set."""
    venues = tables(spark, d)["venues"]
    changes = venues.where("id % 4 = 0").select("id", F.lit("Ville").alias("city"), F.lit(None).cast("string").alias("name"))
    return mutations.updated(venues, changes).select("id", "name", "city")


@query(f"SELECT id, km FROM (SELECT id, {KM_SQL} AS km FROM venues) WHERE km <= 40.0::DOUBLE")
def venues_by_statement(spark, d):
    """Parameterised SQL."""
    return statements.venues_within(tables(spark, d)["venues"], 48.8566, 2.3522, 40.0)


@query(""", r AS (SELECT user_id, ts FROM events)
    SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS start, CAST(n AS BIGINT) AS n FROM (
        WITH RECURSIVE s AS (SELECT user_id, min(ts) AS w FROM r GROUP BY 1 UNION ALL
            SELECT s.user_id, (SELECT min(r.ts) FROM r WHERE r.user_id = s.user_id AND r.ts >= s.w + INTERVAL 15 MINUTE) FROM s WHERE s.w IS NOT NULL)
        SELECT s.user_id, s.w, count(*) AS n FROM s JOIN r ON r.user_id = s.user_id AND r.ts >= s.w AND r.ts < s.w + INTERVAL 15 MINUTE WHERE s.w IS NOT NULL GROUP BY 1, 2)""")
def anchored_windows(spark, d):
    """Windows that begin with a key's first request after the last one."""
    found = ratelimit.anchored(spark.read.parquet(f"{d}/events.parquet"), "user_id")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Bearer ' || user_id END AS key, CASE WHEN d LIKE '____-__-__' THEN CAST(try_cast(d AS DATE) AS VARCHAR) END AS day, trim(padded, ' ' || chr(9) || chr(160) || chr(8195)) AS trimmed
    FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-29' WHEN 2 THEN '24-2-1' ELSE strftime(ts, '%Y-%m-%d') END AS d, chr(160) || event_type || chr(9) || ' ' || chr(8195) AS padded FROM events)""")
def header_and_text(spark, d):
    """Bearer keys, dates that exist, and white space of any script."""
    id = F.col("event_id")
    header = F.when(id % 3 == 0, F.concat(F.lit("Bearer "), "user_id")).when(id % 3 == 1, F.concat(F.lit("bearer "), "user_id"))
    day = F.when(id % 4 == 0, "2024-02-30").when(id % 4 == 1, "2024-02-29").when(id % 4 == 2, "24-2-1").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    padded = F.concat(F.lit(" "), "event_type", F.lit("\t  "))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", ratelimit.bearer(header).alias("key"), shape.iso_date(day).cast("string").alias("day"), text.trimmed(padded).alias("trimmed"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' END AS type FROM part""")
def photo_types(spark, d):
    """Told by the first bytes, whatever the name says."""
    k = F.col("p_partkey")
    head = F.when(k % 5 == 0, "FFD8FFE000").when(k % 5 == 1, "89504E470D0A1A0A00").when(k % 5 == 2, "524946460000000057454250").when(k % 5 == 3, "3C7376673E").otherwise("")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", schema.photo_type(F.unhex(head)).alias("type"))


@query('SELECT id, title FROM entries WHERE "createdById" = 43')
def changeable_events(spark, d):
    """What a user may edit or delete; a moderator may all."""
    events = tables(spark, d)["events"]
    assert str(predicates.changeable(F.col("createdById"), MODERATOR)) != str(predicates.changeable(F.col("createdById"), OWNER))
    return events.where(predicates.changeable(F.col("createdById"), OWNER)).select("id", "title")


@query(""", w AS (SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE 'Halle ' || (id % 4) END AS name, city FROM venues)
    SELECT w.id, w.name, w.city, v.low IS NOT NULL AS found, (SELECT count(*) FROM venues) + (SELECT count(*) FROM (SELECT DISTINCT name, city FROM w WHERE id % 2 = 1)) AS n_venues
    FROM w LEFT JOIN (SELECT name, city, min(id) AS low FROM venues GROUP BY 1, 2) v ON v.name = w.name AND v.city = w.city""")
def seed_venues(spark, d):
    """By name and city only, whatever the address."""
    venues = tables(spark, d)["venues"]
    name = F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("Halle "), F.col("id") % 4))
    wanted = venues.select(F.col("id").alias("asked"), name.alias("name"), F.lit("ailleurs").alias("address"), "city", "postalCode", "lat", "lng")
    after, rows = mutations.get_or_create(venues, wanted, mutations.SEED_KEY)
    top = venues.agg(F.max("id").alias("top"))
    rows = rows.crossJoin(top).crossJoin(after.agg(F.count_distinct("id").alias("n_venues")))
    return rows.select(F.col("asked").alias("id"), "name", "city", (F.col("venueId") <= F.col("top")).alias("found"), "n_venues")


@query("SELECT event_type, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 20")
def login_limits(spark, d):
    """More than twenty in a window, here of a day, by a key."""
    found = ratelimit.exceeded(spark.read.parquet(f"{d}/events.parquet"), "event_type", ratelimit.LOGIN_LIMIT, window="1 day")
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("SELECT id, CASE role WHEN 'USER' THEN 'Simple' WHEN 'MODERATOR' THEN 'Modérateur' ELSE 'Administrateur' END AS label FROM users")
def role_labels(spark, d):
    return tables(spark, d)["users"].select("id", shape.label(F.col("role"), shape.ROLE_LABELS).alias("label"))


@query("""SELECT 'orphan' AS kind, o_orderkey AS key FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'repeated', c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1""")
def broken_constraints(spark, d):
    """What a foreign key and a unique key would forbid."""
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    orders = read("orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("parent"))
    lost = relations.orphans(orders, "parent", read("customer"), "c_custkey").select(F.lit("orphan").alias("kind"), F.col("o_orderkey").alias("key"))
    return lost.unionAll(relations.repeated(read("customer"), "c_nationkey").select(F.lit("repeated"), F.col("c_nationkey").cast("long")))


@query("""SELECT a.id AS actor, t.id AS target, CASE WHEN a.role <> 'ADMIN' THEN 403 WHEN t.id = a.id OR a.id % 7 = 3 THEN 400 END AS refused FROM users a JOIN users t ON t.id = CASE WHEN a.id % 3 = 0 THEN a.id ELSE a.id + 1 END""")
def role_changes(spark, d):
    """Whose change of another's role is refused: only an administrator's, to a role that exists, and never one's own."""
    users = tables(spark, d)["users"]
    wanted = users.select(F.col("id").alias("actor"), F.col("role").alias("actor_role"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + 1).alias("target"), F.when(F.col("id") % 7 == 3, "OWNER").otherwise("MODERATOR").alias("role"))
    asked = wanted.join(users.select(F.col("id").alias("target")), "target")
    return asked.select("actor", "target", commands.role_refusal(F.col("actor"), F.col("actor_role"), F.col("target"), F.col("role")).alias("refused"))


@query("""SELECT o_orderkey, try_cast('2001-' || strftime(o_orderdate, '%m-%d') AS DATE)::VARCHAR AS day FROM orders""")
def seeded_dates(spark, d):
    """Days of seeded events in the year of a given now; a day that the year lacks is none."""
    day = shape.in_year(F.lit(NOW), F.date_format("o_orderdate", "MM-dd"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", day.cast("string").alias("day"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
