"""The catalogue's operators over the driver's tables, each with the SQL that gives the same rows.

The tables are not the catalogue's, so every query is an adaptation: the operator is the library's own, its
columns are derived where the tables have none of the kind (null bounds, coordinates, flags).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import geo, shape, text
from lantern.operators import backfill, moderation, mutations, predicates, relations, validate
from lantern.plans.params import Caller
from lantern.plans.search import paged
from lantern.sources import geocode
from lantern.streaming import ratelimit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str, kept: Column | None = None) -> DataFrame:
    """Orders as events of a period: from the order's date to its last shipment; permanent if nothing ships.

    ``kept`` tests columns of orders only, so what is grouped is the items of orders that pass.
    """
    orders = _t(spark, d, "orders").withColumn("first_day", F.to_date("o_orderdate"))
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    if kept is not None:
        orders = orders.where(kept)
        items = items.join(orders.select(F.col("o_orderkey").alias("kept")), F.col("l_orderkey") == F.col("kept"), "left_semi")
    ends = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.to_date(F.max("l_shipdate")).alias("last_day"))
    return orders.join(ends, F.col("o_orderkey") == F.col("k"), "left").drop("k").withColumn("permanent", F.col("last_day").isNull())


EVENTS_SQL = """SELECT o.*, CAST(o_orderdate AS DATE) AS first_day, e.last_day, e.last_day IS NULL AS permanent FROM orders o
    LEFT JOIN (SELECT l_orderkey AS k, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1) e ON k = o_orderkey"""


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def status_filter(spark, d):
    return _t(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), strip_accents(lower('Eau')))")
def substring_ci_ai(spark, d):
    return _t(spark, d, "documents").where(text.contains(F.col("text"), "Eau")).select("doc_id", "lang")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_type), 'small')")
def multi_column_or_search(spark, d):
    found = predicates.any_contains([F.col("p_name"), F.col("p_type")], "Small")
    return _t(spark, d, "part").where(found).select("p_partkey", "p_name", "p_type")


def _priced(spark, d):
    return _t(spark, d, "part").withColumn("is_free", F.col("p_partkey") % 7 == 0).withColumn("price", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")))


PRICED_SQL = "SELECT *, p_partkey % 7 = 0 AS is_free, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part"


@query(f"SELECT p_partkey, is_free, price FROM ({PRICED_SQL}) WHERE is_free OR price <= 1200.0::DOUBLE")
def price_cap_or_free(spark, d):
    return _priced(spark, d).where(predicates.affordable(F.col("is_free"), F.col("price"), 1200.0)).select("p_partkey", "is_free", "price")


@query(f"SELECT p_partkey, price FROM ({PRICED_SQL}) WHERE is_free")
def free_overrides_cap(spark, d):
    return _priced(spark, d).where("is_free").select("p_partkey", "price")


@query("""SELECT p_partkey, low, high FROM (SELECT p_partkey, nullif(p_size % 10, 0) AS low, nullif(p_size % 20, 0) AS high FROM part)
    WHERE (low IS NULL OR low <= 5) AND (high IS NULL OR high >= 5)""")
def null_open_range(spark, d):
    zero = F.lit(0)
    rows = _t(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size") % 10, zero).alias("low"), F.nullif(F.col("p_size") % 20, zero).alias("high"))
    return rows.where(predicates.within_open(F.col("low"), F.col("high"), 5))


@query(f"SELECT o_orderkey, permanent FROM ({EVENTS_SQL}) WHERE (permanent OR last_day >= DATE '1995-01-01') AND (permanent OR first_day <= DATE '1996-06-30')")
def period_overlap(spark, d):
    import datetime as dt

    p = F.col("permanent")
    kept = predicates.ends_from(p, F.col("last_day"), dt.date(1995, 1, 1)) & predicates.starts_by(p, F.col("first_day"), dt.date(1996, 6, 30))
    return _events(spark, d).where(kept).select("o_orderkey", "permanent")


@query("""SELECT p_partkey, setting FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'INDOOR' WHEN 1 THEN 'OUTDOOR' WHEN 2 THEN 'BOTH' END AS setting FROM part)
    WHERE setting IS NULL OR setting IN ('INDOOR', 'BOTH')""")
def enum_widening_in(spark, d):
    kind = F.col("p_size") % 4
    rows = _t(spark, d, "part").select("p_partkey", F.when(kind == 0, "INDOOR").when(kind == 1, "OUTDOOR").when(kind == 2, "BOTH").alias("setting"))
    return rows.where(predicates.widened(F.col("setting"), "INDOOR"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 7")
def category_eq(spark, d):
    nations = _t(spark, d, "nation").where("n_nationkey = 7")
    return _t(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query(f"""SELECT o_orderkey, o_orderdate, o_totalprice, c_name, n_name, permanent FROM ({EVENTS_SQL}) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P' AND (o_totalprice <= 250000.0::DOUBLE OR o_orderpriority LIKE '1%') AND (permanent OR last_day >= DATE '1995-01-01') AND (permanent OR first_day <= DATE '1997-12-31')
      AND contains(lower(c_name), 'customer') AND (c_acctbal IS NULL OR c_acctbal >= 0)""")
def conjunctive_search(spark, d):
    """The flagship's shape: every clause at once, joined to its to-one relations."""
    import datetime as dt

    c = F.col
    plain = predicates.every([c("o_orderstatus") != "P", predicates.affordable(c("o_orderpriority").startswith("1"), c("o_totalprice"), 250000.0)])
    kept = predicates.every([
        predicates.ends_from(c("permanent"), c("last_day"), dt.date(1995, 1, 1)),
        predicates.starts_by(c("permanent"), c("first_day"), dt.date(1997, 12, 31)),
    ])
    owners = _t(spark, d, "customer").where(text.contains(c("c_name"), "CUSTOMER") & (c("c_acctbal").isNull() | (c("c_acctbal") >= 0)))
    rows = _events(spark, d, plain).where(kept).join(owners, c("o_custkey") == c("c_custkey")).join(_t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return rows.select("o_orderkey", "o_orderdate", "o_totalprice", "c_name", "n_name", "permanent")


def _placed(spark, d, table="supplier", key="s_suppkey"):
    """Coordinates from the key: spread around one point."""
    k = F.col(key)
    return _t(spark, d, table).withColumns({"lat": F.lit(48.8566) + ((k * 37) % 101 - 50) / F.lit(100.0), "lng": F.lit(2.3522) + ((k * 53) % 103 - 51) / F.lit(100.0)})


PLACED_SQL = "SELECT *, 48.8566::DOUBLE + ((s_suppkey * 37) % 101 - 50) / 100.0::DOUBLE AS lat, 2.3522::DOUBLE + ((s_suppkey * 53) % 103 - 51) / 100.0::DOUBLE AS lng FROM supplier"
KM_SQL = """6371.0::DOUBLE * 2 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - 48.8566::DOUBLE) / 2), 2)
    + cos(radians(48.8566::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lng - 2.3522::DOUBLE) / 2), 2))))"""


@query(f"SELECT s_suppkey, floor(km * 10 + 0.5::DOUBLE) / 10 AS km FROM (SELECT s_suppkey, {KM_SQL} AS km FROM ({PLACED_SQL})) WHERE km <= 25.0::DOUBLE")
def haversine_radius(spark, d):
    lat, lng = F.col("lat"), F.col("lng")
    rows = _placed(spark, d).where(geo.in_box(lat, lng, 48.8566, 2.3522, 25.0)).withColumn("km", geo.haversine_km(lat, lng, 48.8566, 2.3522)).where("km <= 25.0")
    return rows.select("s_suppkey", geo.tenths(F.col("km")).alias("km"))


@query(f"SELECT c_custkey, n_near FROM customer JOIN (SELECT s_nationkey, count(*) AS n_near FROM (SELECT s_nationkey, {KM_SQL} AS km FROM ({PLACED_SQL})) WHERE km <= 25.0::DOUBLE GROUP BY 1) ON s_nationkey = c_nationkey")
def semi_join_radius(spark, d):
    near = _placed(spark, d).select(F.col("s_suppkey").alias("id"), "lat", "lng", "s_nationkey")
    counts = relations.within(near, 48.8566, 2.3522, 25.0, "s_nationkey").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_near"))
    return _t(spark, d, "customer").join(counts, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "n_near")


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_nested_relation(spark, d):
    c = F.col
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    rows = rows.join(_t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(_t(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    nested = rows.select("o_orderkey", F.struct("c_name", F.struct("n_name", "r_name").alias("nation")).alias("customer"))
    return nested.select("o_orderkey", "customer.c_name", "customer.nation.n_name", "customer.nation.r_name")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 12 OFFSET 24")
def page_offset_ordered(spark, d):
    return paged(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").asc_nulls_first(), F.col("o_orderkey")], 3, 12)


@query("""SELECT o_orderkey, total FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 12 OFFSET 12)
    CROSS JOIN (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O')""")
def page_with_total(spark, d):
    matches = _t(spark, d, "orders").where("o_orderstatus = 'O'")
    page = paged(matches.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").asc_nulls_first(), F.col("o_orderkey")], 2, 12)
    return page.crossJoin(matches.agg(F.count(F.lit(1)).alias("total"))).select("o_orderkey", "total")


@query("SELECT o_orderstatus, count(*) AS total, CAST(greatest(1, ceil(count(*) / 12.0)) AS BIGINT) AS pages FROM orders GROUP BY 1")
def page_count(spark, d):
    counts = _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumn("pages", shape.page_count(F.col("total"), F.lit(12)))


@query("SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def count_per_parent_zero(spark, d):
    return relations.counted(_t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "lineitem"), "l_orderkey", "n", "o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def category_in_use(spark, d):
    return relations.used(_t(spark, d, "nation").select("n_nationkey", "n_name"), _t(spark, d, "supplier").where("s_suppkey % 3 = 0"), "s_nationkey", "n_nationkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def category_unused(spark, d):
    return relations.used(_t(spark, d, "nation").select("n_nationkey", "n_name"), _t(spark, d, "supplier").where("s_suppkey % 3 = 0"), "s_nationkey", "n_nationkey", yes=False)


@query("""SELECT o_orderkey, coalesce(low, '09:00') AS opens, coalesce(high, '18:00') AS closes FROM orders LEFT JOIN
    (SELECT l_orderkey, min(strftime(l_shipdate, '%m-%d')) AS low, max(strftime(l_shipdate, '%m-%d')) AS high FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def min_max_backfill(spark, d):
    items = _t(spark, d, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "MM-dd").alias("day"))
    low, high = ("day", "opens", F.lit(backfill.OPENS)), ("day", "closes", F.lit(backfill.CLOSES))
    return backfill.with_hours(_t(spark, d, "orders").select("o_orderkey"), items, "l_orderkey", low, high, "o_orderkey")


@query("SELECT n_nationkey, n_name, (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') AS default_region FROM nation")
def scalar_backfill(spark, d):
    one = _t(spark, d, "region").where("r_name = 'EUROPE'")
    return backfill.with_constant(_t(spark, d, "nation").select("n_nationkey", "n_name"), one, "r_regionkey", "default_region")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def queue_fifo(spark, d):
    return _t(spark, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 42")
def owner_rows(spark, d):
    return _t(spark, d, "orders").where("o_custkey = 42").orderBy(F.col("o_orderdate").desc(), "o_orderkey").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_custkey = 42")
def row_visibility(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("PENDING")
    return _t(spark, d, "orders").where(predicates.visible(status, F.col("o_custkey"), Caller(42))).select("o_orderkey", "o_orderstatus")


SEGMENTS = ("HOUSEHOLD", "FURNITURE", "MACHINERY", "BUILDING", "AUTOMOBILE")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'FURNITURE', 'MACHINERY')")
def role_level_filter(spark, d):
    return _t(spark, d, "customer").where(predicates.level(F.col("c_mktsegment"), SEGMENTS) <= 2).select("c_custkey", "c_mktsegment")


@query("""WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS t FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
    l AS (SELECT user_id, count(*) AS n, coalesce(max(CASE WHEN t = 'signup' THEN pos END), 0) AS edit FROM c GROUP BY 1),
    f AS (SELECT c.user_id, arg_min(t, pos) AS t FROM c JOIN l USING (user_id) WHERE pos > edit GROUP BY 1),
    g AS (SELECT user_id, pos, t, sum(CASE WHEN t = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS spell FROM c),
    e AS (SELECT user_id, count(DISTINCT CASE WHEN t <> 'signup' THEN spell END) + count(CASE WHEN t = 'signup' THEN 1 END) AS applied FROM g GROUP BY 1)
    SELECT l.user_id, CASE f.t WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED' ELSE 'PENDING' END AS status, CASE WHEN f.t = 'error' THEN 'error' END AS reason,
           CAST(e.applied AS INTEGER) AS applied, CAST(l.n - e.applied AS INTEGER) AS refused FROM l JOIN e USING (user_id) LEFT JOIN f USING (user_id)""")
def state_machine_fold(spark, d):
    """A user's events as commands on one entry of theirs: a purchase approves, an error rejects, a signup edits."""
    kinds = {"purchase": "approve", "error": "reject", "signup": "edit"}
    known = _t(spark, d, "events").where(F.col("event_type").isin(*kinds))
    edits = F.col("event_type") == "signup"
    commands = known.select(
        F.col("user_id").alias("eventId"), F.struct("ts", "event_id").alias("seq"), shape.label(F.col("event_type"), kinds).alias("action"),
        F.when(edits, F.col("user_id")).otherwise(-1).cast("int").alias("actorId"), F.when(edits, "USER").otherwise("MODERATOR").alias("actorRole"), F.col("event_type").alias("reason"),
    )
    entries = known.select(F.col("user_id").alias("id")).distinct().select("id", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("rejectionReason"), F.lit(None).cast("int").alias("moderatedById"), F.col("id").cast("int").alias("createdById"))
    return moderation.fold(entries, commands).select(F.col("id").alias("user_id"), "status", F.col("rejectionReason").alias("reason"), "applied", "refused")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)""")
def insert_if_absent(spark, d):
    nations = _t(spark, d, "nation").select("n_nationkey", "n_name")
    return mutations.insert_absent(nations.where("n_nationkey % 2 = 0"), nations.withColumn("n_nationkey", F.col("n_nationkey") + 100), "n_name")


@query("""SELECT p_partkey, p_name, p_brand, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS venue_id FROM part""")
def get_or_create(spark, d):
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("city"))
    _, rows = mutations.get_or_create(parts, parts.select(F.col("id").alias("p_partkey"), "name", "city"), ("name", "city"))
    return rows.select("p_partkey", F.col("name").alias("p_name"), F.col("city").alias("p_brand"), F.col("venueId").alias("venue_id"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'revoked' ELSE 'active' END AS state FROM customer WHERE NOT (c_acctbal < 0 AND c_custkey % 2 = 0)")
def soft_delete_active(spark, d):
    revoked = F.when(F.col("c_acctbal") < 0, F.lit("2000-01-01").cast("timestamp"))
    rows = _t(spark, d, "customer").withColumn("revokedAt", revoked)
    return rows.where(predicates.active(F.col("revokedAt")) | (F.col("c_custkey") % 2 != 0)).select("c_custkey", shape.key_state(F.col("revokedAt")).alias("state"))


@query("SELECT c_custkey, sha256(c_name) AS hash FROM customer")
def hash_sha256(spark, d):
    return _t(spark, d, "customer").select("c_custkey", shape.hashed(F.col("c_name")).alias("hash"))


@query("""SELECT p_partkey, CASE WHEN low > high THEN 'age range reversed' WHEN first IS NULL THEN 'start date required' WHEN NOT (p_partkey % 7 = 0) AND price IS NULL THEN 'price required'
      WHEN opens >= closes THEN 'opening must precede closing' END AS error FROM (SELECT p_partkey, nullif(p_size % 10, 0) AS low, nullif(p_size % 6, 0) AS high, nullif(p_partkey % 11, 0) AS first,
      CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, substr(p_name, 1, 1) AS opens, substr(p_type, 1, 1) AS closes FROM part)""")
def validate_first_error(spark, d):
    zero = F.lit(0)
    day = F.nullif(F.col("p_partkey") % 11, zero)
    rules = validate.cross_rules(
        F.nullif(F.col("p_size") % 10, zero), F.nullif(F.col("p_size") % 6, zero), F.lit(False), day, day, F.col("is_free"), F.col("price"),
        F.substring("p_name", 1, 1), F.substring("p_type", 1, 1),
    )
    return _priced(spark, d).select("p_partkey", validate.first_error(*rules).alias("error"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_shape(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Approuvée' WHEN 'O' THEN 'Refusée' WHEN 'P' THEN 'En attente de modération' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Gratuit' ELSE concat(CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR), ' €') END AS price FROM (SELECT o_orderkey, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders)""")
def label_map(spark, d):
    status = shape.label(F.col("o_orderstatus"), {"F": "APPROVED", "O": "REJECTED", "P": "PENDING"})
    price = shape.price_label(F.col("o_orderkey") % 5 == 0, F.floor("o_totalprice"))
    return _t(spark, d, "orders").select("o_orderkey", shape.label(status, shape.STATUS_LABELS).alias("status"), price.alias("price"))


@query("""SELECT s_suppkey, concat_ws(', ', nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, ''), nullif(n_name, '')) AS label,
    coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, ''), n_name) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def concat_skip_empty(spark, d):
    rows = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name, nation = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")), F.col("n_name")
    return rows.select("s_suppkey", geocode.joined(", ", name, nation).alias("label"), geocode.first_given(name, nation).alias("name"))


@query("SELECT user_id, CAST(time_bucket(INTERVAL '15 minutes', ts) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_window(spark, d):
    found = ratelimit.exceeded(_t(spark, d, "events"), "user_id", 1)
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, max(ts) AS last_used FROM events GROUP BY 1")
def last_used(spark, d):
    return ratelimit.last_used(_t(spark, d, "events"), "user_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
