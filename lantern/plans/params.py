"""Typed parameters of a search, and who asks."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass

from lantern.sources.schema import ROLES, SETTINGS


class InvalidParameter(ValueError):
    """A parameter that makes the whole request invalid."""


class Refused(Exception):
    """A command that the rules do not allow; ``code`` says why, as an HTTP status would."""

    def __init__(self, code: int):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Caller:
    id: int
    role: str = "USER"

    @property
    def level(self) -> int:
        return ROLES.index(self.role)

    def has(self, role: str) -> bool:
        return self.level >= ROLES.index(role)

    def need(self, role: str) -> None:
        if not self.has(role):
            raise Refused(403)


#: Forms of numbers and days in a query string, whole, in digits of ASCII.
DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
PREFIXED = {"0x": r"\A0[xX][0-9a-fA-F]{1,16}\z", "0o": r"\A0[oO][0-7]{1,21}\z", "0b": r"\A0[bB][01]{1,64}\z"}
DAY = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
#: White space of any script at an end of a text.
_SPACE = "[\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def _is(form: str, text: str) -> bool:
    return re.fullmatch(form.removeprefix(r"\A").removesuffix(r"\z"), text) is not None


def trimmed(text: str) -> str:
    return re.sub(f"\\A{_SPACE}|{_SPACE}\\Z", "", text)


def _number(text, name: str, low: float | None, high: float | None = None, whole: bool = False):
    text = trimmed(str(text))
    if text == "":
        value = 0.0
    elif _is(DECIMAL, text):
        value = float(text)
    elif any(_is(form, text) for form in PREFIXED.values()):
        value = float(int(text, 0))
    else:
        raise InvalidParameter(name)
    if not math.isfinite(value) or (low is not None and value < low) or (high is not None and value > high) or (whole and (value != int(value) or abs(value) > 2147483647)):
        raise InvalidParameter(name)
    return int(value) if whole else value


def _date(text: str, name: str) -> dt.date:
    if not _is(DAY, text):
        raise InvalidParameter(name)
    try:
        return dt.date.fromisoformat(text)
    except ValueError:  # a day that does not exist
        raise InvalidParameter(name) from None


def _one_of(text: str, name: str, allowed: tuple[str, ...]) -> str:
    if text not in allowed:
        raise InvalidParameter(name)
    return text


#: The limits of the search's parameters.
QUERY_CHARS, AGES, RADII, PAGE_SIZES, PAGE_SIZE = 200, (0, 18), (0.1, 300), (1, 50), 12


@dataclass(frozen=True)
class SearchParams:
    """Filters that are None are off; 0 is a value like any other."""

    q: str | None = None
    free: bool = False
    price_max: float | None = None
    age: int | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    setting: str | None = None
    category_id: int | None = None
    lat: float | None = None
    lng: float | None = None
    radius_km: float | None = None
    page: int = 1
    page_size: int = PAGE_SIZE

    @property
    def near(self) -> tuple[float, float, float] | None:
        """Point and radius, if all three are given; else they count for nothing."""
        if self.lat is None or self.lng is None or self.radius_km is None:
            return None
        return self.lat, self.lng, self.radius_km

    @classmethod
    def parse(cls, query: dict[str, str]) -> SearchParams:
        """From a query string's fields. One bad field makes the request invalid; unknown ones are ignored."""
        given = lambda name, read: read(query[name]) if query.get(name) is not None else None
        number = lambda name, *limits, **how: given(name, lambda x: _number(x, name, *limits, **how))
        one_of = lambda name, *allowed: given(name, lambda x: _one_of(x, name, allowed))
        q = given("q", trimmed)
        # counted in units of 16 bits
        if q is not None and len(q.encode("utf-16-le", "surrogatepass")) > 2 * QUERY_CHARS:
            raise InvalidParameter("q")
        # in this order, so that the first bad field is named
        return cls(
            q=q or None,
            free=one_of("free", "true", "false") == "true",
            price_max=number("priceMax", 0),
            age=number("age", *AGES, whole=True),
            start=given("from", lambda x: _date(x, "from")),
            end=given("to", lambda x: _date(x, "to")),
            setting=one_of("setting", *SETTINGS),
            category_id=number("categoryId", 1, whole=True),
            lat=number("lat", -90, 90),
            lng=number("lng", -180, 180),
            radius_km=number("radiusKm", *RADII),
            page=1 if (page := number("page", 1, whole=True)) is None else page,
            page_size=PAGE_SIZE if (size := number("pageSize", *PAGE_SIZES, whole=True)) is None else size,
        )
