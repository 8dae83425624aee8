"""Parameterised SQL over DataFrames: values are named parameters, relations are named in braces; no text is put together."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Venues in a radius, by their unrounded distance.
VENUES_WITHIN = """
    SELECT id, km FROM (
        SELECT id, 6371.0D * 2 * asin(sqrt(least(1.0D, pow(sin(radians(CAST(lat AS DOUBLE) - :lat) / 2), 2)
            + cos(radians(:lat)) * cos(radians(CAST(lat AS DOUBLE))) * pow(sin(radians(CAST(lng AS DOUBLE) - :lng) / 2), 2)))) AS km
        FROM {venues})
    WHERE km <= :radius"""


def statement(text: str, args: dict[str, object] | None = None, **relations: DataFrame) -> DataFrame:
    """The rows of ``text``, with ``:name`` from ``args`` and ``{name}`` from ``relations`` (one at least)."""
    spark = next(iter(relations.values())).sparkSession
    return spark.sql(text, args=args or {}, **relations)


def venues_within(venues: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    return statement(VENUES_WITHIN, {"lat": lat, "lng": lng, "radius": radius_km}, venues=venues)
