"""Validation of commands as a Column: the first error's message, null if the row is valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions import shape, text
from lantern.sources.schema import ROLES, SETTINGS

#: Fixed value: the form of a time. Forms are of the whole text: the end is \\z, as $ would let a line end follow.
TIME = "\\A([01][0-9]|2[0-3]):[0-5][0-9]\\z"
#: Well-formedness, no more. A URL has a scheme and something after it.
URL = "\\A[A-Za-z][A-Za-z0-9+.-]*:(//)?[^\\s/?#]+\\S*\\z"
#: Before the one @, words joined by single dots; after it, two labels or more, of which the last is letters.
_WORD, _LABEL = "[A-Za-z0-9_'+-]+", "[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = f"\\A{_WORD}(\\.{_WORD})*@({_LABEL}\\.)+[A-Za-z]{{2,}}\\z"


def first_error(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that is broken; a rule that is null is not broken."""
    return F.coalesce(*(F.when(broken, F.lit(message)) for broken, message in rules))


def _length(c: Column, low: int | None, high: int | None, short: str, long: str) -> list[tuple[Column, str]]:
    n = F.length(text.trimmed(c))
    rules = [] if low is None else [(c.isNull() | (n < low), short)]
    return rules + ([] if high is None else [(n > high, long)])


def _given(c: Column) -> Column:
    """Optional text: the empty one counts as not given."""
    return F.nullif(c, F.lit(""))


def _outside(c: Column, low, high) -> Column:
    return (c < low) | (c > high)


def _broken(c: Column) -> Column:
    """Not a whole number, whatever the column's type."""
    return c != F.floor(c)


def venue_rules(name: Column, address: Column, city: Column, postal: Column, lat: Column, lng: Column) -> list[tuple[Column, str]]:
    return [
        *_length(name, 1, 120, "venue name required", "venue name too long"),
        *_length(address, 1, 255, "venue address required", "venue address too long"),
        *_length(city, 1, 120, "venue city required", "venue city too long"),
        *_length(postal, 4, 10, "postal code too short", "postal code too long"),
        (lat.isNull() | _outside(lat, -90, 90), "latitude out of range"),
        (lng.isNull() | _outside(lng, -180, 180), "longitude out of range"),
    ]


def cross_rules(age_min: Column, age_max: Column, permanent: Column, start: Column, end: Column, is_free: Column, price: Column, opens: Column, closes: Column) -> list[tuple[Column, str]]:
    """Rules between fields, in order. Those that compare pass when an operand is missing."""
    return [
        (age_min > age_max, "age range reversed"),
        (~permanent & start.isNull(), "start date required"),
        (~permanent & end.isNull(), "end date required"),
        (start > end, "end before start"),
        (~is_free & price.isNull(), "price required"),
        (opens >= closes, "opening must precede closing"),
    ]


def event_error(c=F.col) -> Column:
    """Of an event command with the fields of an event and ``venue``; fields first, then the rules between them."""
    at = c("venue")
    start, end, opens, closes, url = (_given(c(x)) for x in ("dateStart", "dateEnd", "openTime", "closeTime", "sourceUrl"))
    permanent = F.coalesce(c("isPermanent"), F.lit(False))
    # an impossible day has the form of a date, but is refused as well
    bad_date = lambda d: d.isNotNull() & shape.iso_date(d).isNull()
    return first_error(
        *_length(c("title"), 3, 150, "title too short", "title too long"),
        *_length(c("description"), 10, 10_000, "description too short", "description too long"),
        (url.isNotNull() & ~text.trimmed(url).rlike(URL), "invalid URL"),
        (F.length(text.trimmed(url)) > 500, "URL too long"),
        (c("isFree").isNull(), "isFree required"),
        (_outside(c("price"), 0, 100_000), "price out of range"),
        (_broken(c("ageMin")), "ageMin not whole"),
        (_outside(c("ageMin"), 0, 17), "ageMin out of range"),
        (_broken(c("ageMax")), "ageMax not whole"),
        (_outside(c("ageMax"), 0, 18), "ageMax out of range"),
        (bad_date(start), "invalid start date"),
        (bad_date(end), "invalid end date"),
        (opens.isNotNull() & ~opens.rlike(TIME), "invalid opening time"),
        (closes.isNotNull() & ~closes.rlike(TIME), "invalid closing time"),
        (~c("setting").isin(*SETTINGS), "invalid setting"),
        (c("categoryId").isNull() | (c("categoryId") <= 0) | _broken(c("categoryId")), "category required"),
        *venue_rules(at["name"], at["address"], at["city"], at["postalCode"], at["lat"], at["lng"]),
        *cross_rules(c("ageMin"), c("ageMax"), permanent, start, end, c("isFree"), c("price"), opens, closes),
    )


def category_error(name: Column) -> Column:
    return first_error(*_length(name, 2, 50, "name too short", "name too long"))


def register_error(email: Column, password: Column, display_name: Column) -> Column:
    return first_error(
        (email.isNull() | ~email.rlike(EMAIL), "invalid email"),
        (password.isNull() | (F.length(password) < 8), "password too short"),
        *_length(display_name, 2, 50, "name too short", "name too long"),
    )


def login_error(email: Column, password: Column) -> Column:
    return first_error((email.isNull() | ~email.rlike(EMAIL), "invalid email"), (password.isNull() | (F.length(password) < 1), "password required"))


def moderation_error(action: Column, reason: Column) -> Column:
    return first_error((action.isNull() | ~action.isin("approve", "reject"), "invalid action"), *_length(reason, None, 1000, "", "reason too long"))


def role_error(role: Column) -> Column:
    return first_error((role.isNull() | ~role.isin(*ROLES), "invalid role"))


def key_error(name: Column, user_id: Column) -> Column:
    return first_error(*_length(name, 2, 100, "name too short", "name too long"), (user_id.isNull() | (user_id <= 0), "account required"))
