"""Totals and pages of many searches without their pairs: bitmaps of events, one for each value that requests test.

Most requests fit a large part of all events, so pairs of both grow with their product. Here events are dealt into segments, by
category, by venue and over all, and requests to those that they can fit. In a segment, sorted by start date and id, a test's
value is a bitmap; a search is the conjunction of a few, its total the number of bits and its page among the first of them.
Equal searches of many requests are one. Texts are compared once for each different text that is sought. Segments and parts of searches are of bounded size.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators import predicates as p
from lantern.plans import many
from lantern.plans.search import Tables
from lantern.sources.schema import SETTINGS
from lantern.sources.shared import written

#: Events of a segment, searches of a part, and bytes of bitmaps that are kept.
SEGMENT, PART, KEPT = 1 << 18, 1 << 16, 64_000_000
#: Texts that are sought in an event at once; rows of a batch that leaves.
TEXTS, BATCH = 100, 1 << 16
LOW, HIGH = -(2**31), 2**31 - 1
KEY = ["_kind", "_value"]
TILE = [*KEY, "_segment", "_part"]
TESTS = {"_q": "string", "_free": "boolean", "_cap": "double", "_age": "int", "_from": "int", "_to": "int", "_setting": "int", "_category": "int"}
FACTS = {"_low": "int", "_high": "int", "_youngest": "int", "_oldest": "int", "_given": "boolean", "_price": "double", "_place": "int", "_kin": "int", "_texts": "array<string>", "_start": "date"}


def _code(setting: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SETTINGS)), setting).cast("int")


def _events(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Approved events as numbers that need no null: what is open lies beyond all values asked for, what fits nothing likewise."""
    c, low, high = F.col, F.lit(LOW), F.lit(HIGH)
    permanent, free = F.coalesce("isPermanent", F.lit(False)), F.coalesce("isFree", F.lit(False))
    rows = events.where("status = 'APPROVED'")
    texts = asked.where("_q IS NOT NULL").select("_q").distinct()
    lists = -(-texts.count() // TEXTS)
    own = F.array().cast("array<string>")
    if lists == 1:
        own = F.filter(F.array(*(F.lit(r["_q"]) for r in texts.collect())), lambda q: p.any_contains([c("title"), c("description")], q))
    elif lists:
        listed = texts.groupBy(F.pmod(F.xxhash64("_q"), F.lit(lists)).alias("_list")).agg(F.collect_list("_q").alias("_qs"))
        met = rows.select("id", "title", "description", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))).alias("_list")).join(listed, "_list")
        met = met.select("id", F.explode(F.filter("_qs", lambda q: p.any_contains([c("title"), c("description")], q))).alias("_q"))
        rows = rows.join(met.groupBy("id").agg(F.collect_list("_q").alias("_own")), "id", "left")
        own = F.coalesce("_own", own)
    facts = {
        "_low": F.when(permanent, low).otherwise(F.coalesce(F.unix_date("dateStart"), high)), "_high": F.when(permanent, high).otherwise(F.coalesce(F.unix_date("dateEnd"), low)),
        "_youngest": F.coalesce("ageMin", low), "_oldest": F.coalesce("ageMax", high), "_given": free, "_price": F.when(free, float("-inf")).otherwise(F.coalesce(c("price").cast("double"), F.lit(float("nan")))),
        "_place": F.when(c("setting").isNull() | (c("setting") == "BOTH"), 0).otherwise(F.coalesce(F.nullif(_code(c("setting")), F.lit(0)), low)), "_kin": F.coalesce("categoryId", low), "_texts": own, "_start": c("dateStart"),
    }
    return rows.select(c("id").cast("long").alias("_id"), "venueId", *(x.cast(FACTS[n]).alias(n) for n, x in facts.items()))


def _keys(*pairs: tuple[int, Column]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("_kind"), v.cast("int").alias("_value")) for k, v in pairs))).alias("_key")


def tallied(tables: Tables, requests: DataFrame, as_of: dt.date, folder: str) -> DataFrame:
    """``request, n, id, dateStart, km``: the sum of ``n`` is a request's total, and its page is among the rows (see ``many.pages``).

    ``requests`` has ``request``, a unique id, and ``params``; ``folder`` is for tables that are used twice.
    """
    c = F.col
    asked = requests.where("params IS NOT NULL").select("request", "params.lat", "params.lng", "params.radius_km", (c("params.page").cast("long") * c("params.page_size")).alias("_first"), *(x.cast(TESTS[n]).alias(n) for n, x in {
        "_q": c("params.q"), "_free": c("params.free"), "_cap": c("params.price_max"), "_age": c("params.age"), "_from": F.unix_date(F.coalesce("params.start", F.lit(as_of))), "_to": F.unix_date("params.end"), "_setting": _code(c("params.setting")), "_category": c("params.category_id"),
    }.items()))
    events = written(_events(tables["events"], asked), folder, "facts")
    located = c("lat").isNotNull() & c("lng").isNotNull() & c("radius_km").isNotNull()
    used = events.select(c("venueId").alias("id")).distinct()
    carried = ("_first", *TESTS)
    near = many.near_many(asked.where(located), tables["venues"].join(used, "id", "left_semi"), carried).select("request", "km", F.lit(2).alias("_kind"), c("_near").cast("int").alias("_value"), *carried)
    # by category where one is asked for
    kind = F.when(c("_category").isNull(), 0).otherwise(1)
    far = asked.where(~located).select("request", F.lit(None).cast("double").alias("km"), kind.alias("_kind"), F.coalesce("_category", F.lit(0)).alias("_value"), *carried)
    asked = written(near.unionByName(far).select("request", "km", "_first", F.struct(*KEY, *TESTS).alias("_same")), folder, "asked")
    # one search for all requests that are equal but for their page, with its first rows up to the last page of any
    searches = written(asked.groupBy("_same").agg(F.max("_first").alias("_first")).withColumn("_search", F.monotonically_increasing_id()), folder, "searches")
    found = written(_found(events, searches.select("_search", "_first", "_same.*"), folder), folder, "tiles")
    whole = Window.partitionBy("_search")
    ranked = found.select("_search", "id", "dateStart", F.sum("n").over(whole).alias("n"), F.row_number().over(whole.orderBy(c("dateStart").asc_nulls_first(), "id")).alias("_rank"))
    asked = asked.join(searches.select("_same", "_search"), "_same").select("request", "km", "_first", "_search")
    # the first row of a request and search says how many there are
    return asked.join(ranked, "_search").where("_rank <= _first").select("request", F.when(c("_rank") == 1, c("n")).otherwise(0).alias("n"), "id", "dateStart", "km")


def _found(events: DataFrame, searches: DataFrame, folder: str) -> DataFrame:
    """``_search, n, id, dateStart``: the events that fit a search in each segment, their number in the first of its rows there."""
    c = F.col
    filed = events.select("*", _keys((0, F.lit(0)), (1, c("_kin")), (2, c("venueId")))).select("*", "_key.*").drop("_key", "venueId")
    count = lambda rows, size, name: rows.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
    dealt = written(count(filed, SEGMENT, "_segments").join(count(searches, PART, "_parts"), KEY), folder, "dealt")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), c(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), c(n))
    left = filed.join(dealt, KEY).select("*", one("_id", "_segments").alias("_segment"), every("_parts").alias("_part")).drop("_segments", "_parts")
    right = searches.join(dealt, KEY).select("*", one("_search", "_parts").alias("_part"), every("_segments").alias("_segment")).drop("_segments", "_parts")
    both = left.unionByName(right, allowMissingColumns=True).repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), *TILE)
    both = both.select(*TILE, "_id", *FACTS, "_search", "_first", *TESTS)
    return both.groupBy(*TILE).applyInArrow(_tile, "_search long, n long, id long, dateStart date")


def totals(requests: DataFrame, found: DataFrame) -> DataFrame:
    """``request, total`` of every sound request, 0 included."""
    counts = found.groupBy("request").agg(F.sum("n").alias("total"))
    return requests.where("params IS NOT NULL").select("request").join(counts, "request", "left").withColumn("total", F.coalesce("total", F.lit(0)))


class Segment:
    """Events in the order of pages, and the bitmaps of the tests asked for."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("_low_start", "ascending"), ("_id", "ascending")])
        self.ids, self.starts, self.size = rows["_id"].combine_chunks(), rows["_start"].combine_chunks(), len(rows)
        self.facts = {n: rows[n].to_numpy() for n in FACTS if n not in ("_texts", "_start")}
        texts = rows["_texts"].combine_chunks()
        self.holders, self.texts = np.repeat(np.arange(len(rows)), np.asarray(texts.value_lengths())), texts.flatten().dictionary_encode()
        self.known = {t: i for i, t in enumerate(self.texts.dictionary.to_pylist())}
        self.kept: dict[tuple, np.ndarray] = {}

    def _flags(self, name: str, value) -> np.ndarray:
        f = self.facts
        if name == "_q":
            out = np.zeros(self.size, bool)
            if value in self.known:
                out[self.holders[np.asarray(self.texts.indices) == self.known[value]]] = True
            return out
        return {
            "_free": lambda: f["_given"].astype(bool), "_cap": lambda: f["_price"] <= value, "_age": lambda: (f["_youngest"] <= value) & (f["_oldest"] >= value), "_from": lambda: f["_high"] >= value,
            "_to": lambda: f["_low"] <= value, "_setting": lambda: (f["_place"] == 0) | (f["_place"] == value), "_category": lambda: f["_kin"] == value,
        }[name]()

    def bits(self, name: str, value) -> np.ndarray:
        found = self.kept.get((name, value))
        if found is None:
            if len(self.kept) * self.size // 8 > KEPT:
                self.kept.clear()
            packed = np.packbits(self._flags(name, value))
            found = np.zeros(-(-len(packed) // 8), np.uint64)
            found.view(np.uint8)[: len(packed)] = packed
            self.kept[name, value] = found
        return found

    def fits(self, tests: dict) -> np.ndarray:
        """The conjunction of all tests that are on; a free event needs no price."""
        on = [(n, v) for n, v in tests.items() if v is not None and not (n == "_free" and not v) and not (n == "_cap" and tests["_free"])]
        out = self.bits(*on[0]).copy()
        for test in on[1:]:
            out &= self.bits(*test)
        return out


def first_bits(bits: np.ndarray, n: int) -> np.ndarray:
    """The places of the first ``n`` bits; most lie near the beginning, so a little is read before all."""
    octets = bits[: 8 * n].view(np.uint8)
    at = np.flatnonzero(octets)[:n]
    if len(at) < n:
        octets = bits.view(np.uint8)
        at = np.flatnonzero(octets)[:n]
    return np.flatnonzero(np.unpackbits(octets[at]))[:n] % 8 + 8 * np.repeat(at, np.bitwise_count(octets[at]))[:n]


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals and first rows of each search of a part in one segment."""
    rows = pa.Table.from_batches(list(batches))
    is_event = rows["_id"].is_valid()
    # in an order in which bitmaps of days are needed for a while and then no more
    events, asked = rows.filter(is_event), rows.filter(pc.invert(is_event)).sort_by([("_from", "ascending"), ("_to", "ascending")])
    low = pc.fill_null(pc.cast(events["_start"], pa.int32()), LOW)
    segment = Segment(events.append_column("_low_start", low))
    by_category = asked["_kind"][0].as_py() == 1
    names = [n for n in TESTS if not (by_category and n == "_category")]
    columns = [asked[n].to_pylist() for n in names]
    firsts = asked["_first"].to_pylist()
    who, n_of, at, pending = [], [], [], 0

    def batch() -> pa.RecordBatch:
        sizes = [len(a) for a in at]
        which, places = pa.array(np.repeat(who, sizes)), pa.array(np.concatenate(at))
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = np.zeros(len(places), np.int64)
        n[begins] = n_of
        take = lambda name: asked[name].take(which).combine_chunks()
        return pa.RecordBatch.from_arrays([take("_search"), pa.array(n), segment.ids.take(places), segment.starts.take(places)], names=["_search", "n", "id", "dateStart"])

    for i, values in enumerate(zip(*columns, strict=True)):
        bits = segment.fits(dict(zip(names, values, strict=True)))
        n = int(np.bitwise_count(bits).sum())
        if n:
            who.append(i)
            n_of.append(n)
            at.append(first_bits(bits, firsts[i]))
            pending += len(at[-1])
        if pending >= BATCH:
            yield batch()
            who, n_of, at, pending = [], [], [], 0
    if who:
        yield batch()
