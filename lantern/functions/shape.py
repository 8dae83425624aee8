"""Scalar shaping of results: labels, dates, hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels that the catalogue shows.
SETTING_LABELS = {"INDOOR": "Intérieur", "OUTDOOR": "Extérieur", "BOTH": "Intérieur & extérieur"}
STATUS_LABELS = {"PENDING": "En attente de modération", "APPROVED": "Approuvée", "REJECTED": "Refusée"}
ROLE_LABELS = {"USER": "Simple", "MODERATOR": "Modérateur", "ADMIN": "Administrateur"}
FREE, ALL_YEAR = "Gratuit", "Toute l’année"


def label(c: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), c)


def number(c: Column) -> Column:
    return c.cast("double")


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def price_label(is_free: Column, price: Column) -> Column:
    return F.when(is_free, FREE).otherwise(F.concat(price.cast("string"), F.lit(" €")))


def date_label(permanent: Column, start: Column, end: Column) -> Column:
    """All year if permanent or a date is missing, one day, or a range."""
    ranged = F.concat(day(start), F.lit(" → "), day(end))
    return F.when(permanent | start.isNull() | end.isNull(), ALL_YEAR).when(start == end, day(start)).otherwise(ranged)


def both(low: Column, high: Column, separator: str) -> Column:
    """Ages and hours are shown only if both ends are set."""
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit(separator), high.cast("string")))


def key_state(revoked_at: Column) -> Column:
    return F.when(revoked_at.isNull(), "active").otherwise("revoked")


def hashed(c: Column) -> Column:
    return F.sha2(c, 256)


def map_url(base: str, lat: Column, lng: Column) -> Column:
    return F.format_string(base + "%s,%s", lat.cast("string"), lng.cast("string"))


def url_encoded(c: Column) -> Column:
    """As a part of a query string: all but letters, digits and ``-_.~!*'()`` as UTF-8 bytes in hex, a space as ``%20``."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def as_json(*columns: str | Column) -> Column:
    """A row as JSON text; keys of null values are left out."""
    return F.to_json(F.struct(*columns))


def iso_date(c: Column) -> Column:
    """A date from ``yyyy-MM-dd``, null if it has another form or does not exist."""
    return F.when(c.rlike("\\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"), F.try_to_date(c, "yyyy-MM-dd"))


def in_year(now: Column, day: Column) -> Column:
    """``MM-dd`` in the year of ``now``; null if that year has no such day."""
    return iso_date(F.concat(F.date_format(now, "yyyy"), F.lit("-"), day))


def page_count(total: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` uses it: else every use is a copy of its whole expression."""
    return F.get(F.transform(F.array(c), f), F.lit(0))
