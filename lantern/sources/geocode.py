"""Addresses out of captured geocoder payloads (GeoJSON text), for both providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import shape, text

#: Coordinates are longitude, latitude.
_GEOMETRY = "geometry STRUCT<coordinates: ARRAY<DOUBLE>>"
NATIONAL = f"STRUCT<features: ARRAY<STRUCT<properties: STRUCT<label: STRING, name: STRING, city: STRING, postcode: STRING>, {_GEOMETRY}>>>"
WORLD = f"STRUCT<features: ARRAY<STRUCT<properties: STRUCT<name: STRING, city: STRING, postcode: STRING, street: STRING, housenumber: STRING>, {_GEOMETRY}>>>"
RESULTS, LEAST_QUERY = 5, 3


def joined(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def first_given(*parts: Column) -> Column:
    return F.coalesce(*(F.nullif(p, F.lit("")) for p in parts))


def asked(q: Column) -> Column:
    """Shorter queries get no suggestions."""
    return F.length(text.trimmed(q)) >= LEAST_QUERY


def request_url(base: str, q: Column) -> Column:
    """What a provider is asked, null for a query that is too short."""
    return F.when(asked(q), F.concat(F.lit(f"{base}?q="), shape.url_encoded(text.trimmed(q)), F.lit(f"&limit={RESULTS}")))


def suggestions(payloads: DataFrame, provider: str, body: str = "body") -> DataFrame:
    """``payloads`` with one row for each of the first results: label, name, city, postcode, lat, lng.

    A payload that does not parse, or has no features, gives no rows.
    """
    parsed = F.from_json(body, NATIONAL if provider == "national" else WORLD, {"mode": "PERMISSIVE"})
    first = F.slice(parsed["features"], 1, RESULTS)
    rows = payloads.select(*(c for c in payloads.columns if c != body), F.posexplode(first).alias("rank", "f"))
    p, at = F.col("f.properties"), F.col("f.geometry.coordinates")
    if provider == "national":
        shaped = {"label": p["label"], "name": p["name"], "city": p["city"], "postcode": p["postcode"]}
    else:
        name = first_given(p["name"], joined(" ", p["housenumber"], p["street"]))
        empty = F.lit("")
        shaped = {"label": joined(", ", name, p["postcode"], p["city"]), "name": F.coalesce(name, empty), "city": F.coalesce(p["city"], empty), "postcode": F.coalesce(p["postcode"], empty)}
    shaped |= {"lat": F.get(at, F.lit(1)), "lng": F.get(at, F.lit(0))}
    return rows.select("*", *(c.alias(k) for k, c in shaped.items())).drop("f")
