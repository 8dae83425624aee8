"""Query strings of a whole table of searches, parsed and tested as Columns: typed parameters, or the first field that is bad.

The single form is ``SearchParams.parse``; both read numbers, dates and texts by the same rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import shape, text
from lantern.plans import params as p

#: Fields in the order in which they are tested, with the parameter that each sets and its type.
FIELDS = {
    "q": ("q", "string"), "free": ("free", "boolean"), "priceMax": ("price_max", "double"), "age": ("age", "int"), "from": ("start", "date"), "to": ("end", "date"), "setting": ("setting", "string"),
    "categoryId": ("category_id", "int"), "lat": ("lat", "double"), "lng": ("lng", "double"), "radiusKm": ("radius_km", "double"), "page": ("page", "int"), "pageSize": ("page_size", "int"),
}


def decoded(part: Column) -> Column:
    """A name or value of a query string: ``+`` is a space, ``%`` and two digits a byte of UTF-8; what cannot be decoded stays as it is."""
    plain = F.replace(part, F.lit("+"), F.lit(" "))
    found = F.try_url_decode(part)
    # bytes that are not UTF-8 come back as this sign, unless it was meant
    broken = F.contains(found, F.lit("�")) & ~F.contains(part, F.lit("�")) & ~F.contains(F.upper(part), F.lit("%EF%BF%BD"))
    return F.when(found.isNull() | broken, plain).otherwise(found)


def pairs(query: Column) -> Column:
    """``array<struct<name, value>>`` of a query string, in order; a leading ``?`` and what follows ``#`` are no part of it."""
    body = F.regexp_replace(F.substring_index(query, "#", 1), "^\\?", "")
    parts = F.filter(F.split(body, "&"), lambda x: x != "")
    name = lambda x: F.substring_index(x, "=", 1)
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).otherwise("")
    return F.transform(parts, lambda x: F.struct(decoded(name(x)).alias("name"), decoded(value(x)).alias("value")))


def number(c: Column) -> Column:
    """The finite number that a text is, else null: decimal, or hexadecimal, octal or binary with its prefix; a text of white space is 0."""

    def read(t: Column) -> Column:
        base = lambda digits, radix: F.conv(F.substr(digits, F.lit(3)), radix, 10).cast("double")
        found = F.when(t == "", F.lit(0.0)).when(t.rlike(p.DECIMAL), t.try_cast("double"))
        for form, radix in (("0x", 16), ("0o", 8), ("0b", 2)):
            found = found.when(t.rlike(p.PREFIXED[form]), base(t, radix))
        return found

    return shape.let(shape.let(text.trimmed(c), read), lambda x: F.when(F.abs(x) < float("inf"), x))


def utf16_length(c: Column) -> Column:
    """Length in units of 16 bits, of which a sign beyond the basic plane takes two."""
    return F.length(c) + F.length(F.regexp_replace(c, "[^\\x{10000}-\\x{10FFFF}]", ""))


def within(c: Column, low: float | None, high: float | None = None, whole: bool = False) -> Column:
    """``c`` where it lies in the limits, else null."""

    def test(x: Column) -> Column:
        tests = ([x >= low] if low is not None else []) + ([x <= high] if high is not None else []) + ([x == F.floor(x), F.abs(x) <= 2147483647] if whole else [])
        return F.when(reduce(Column.__and__, tests, F.lit(True)), x)

    return shape.let(c, test)


def _typed(name: str, value: Column) -> Column:
    """The value of the field ``name`` as its type, null if it is none."""
    n = lambda *limits, **how: within(number(value), *limits, **how)
    tests = {
        "q": lambda: shape.let(text.trimmed(value), lambda q: F.when(utf16_length(q) <= p.QUERY_CHARS, q)), "free": lambda: F.when(value.isin("true", "false"), value == "true"), "priceMax": lambda: n(0),
        "age": lambda: n(*p.AGES, whole=True), "from": lambda: shape.iso_date(value), "to": lambda: shape.iso_date(value), "setting": lambda: F.when(value.isin(*p.SETTINGS), value), "categoryId": lambda: n(1, whole=True),
        "lat": lambda: n(-90, 90), "lng": lambda: n(-180, 180), "radiusKm": lambda: n(*p.RADII), "page": lambda: n(1, whole=True), "pageSize": lambda: n(*p.PAGE_SIZES, whole=True),
    }
    return tests[name]()


def parsed(requests: DataFrame, query: str = "query") -> DataFrame:
    """``requests`` with ``params``, a struct of what each query string asks for, and ``bad``, the first field that makes it invalid.

    Of a bad one ``params`` is null. A field given twice, or with brackets, is bad; unknown fields are ignored; a
    null query string asks for nothing. The defaults of page and page size are filled in.
    """
    given = F.coalesce(pairs(F.col(query)), F.array().cast("array<struct<name:string,value:string>>"))

    def read(name: str, kind: str):
        """Whether the field is given, and as what, out of all pairs."""

        def of(pairs: Column) -> Column:
            own = F.filter(pairs, lambda x: x["name"] == name)
            twice = (F.size(own) > 1) | F.exists(pairs, lambda x: F.startswith(x["name"], F.lit(f"{name}[")))
            value = F.get(own, F.lit(0))["value"]
            typed = _typed(name, value).cast(kind)
            return shape.let(F.struct(twice.alias("twice"), value.isNotNull().alias("given"), typed.alias("value")), lambda x: F.struct((x["twice"] | (x["given"] & x["value"].isNull())).alias("bad"), x["value"].alias("value")))

        return of

    def whole(pairs: Column) -> Column:
        fields = F.struct(*(read(n, kind)(pairs).alias(n) for n, (_, kind) in FIELDS.items()))

        def told(x: Column) -> Column:
            found = {n: x[n]["value"] for n in FIELDS}
            found |= {"q": F.nullif(found["q"], F.lit("")), "free": F.coalesce(found["free"], F.lit(False)), "page": F.coalesce(found["page"], F.lit(1)), "pageSize": F.coalesce(found["pageSize"], F.lit(p.PAGE_SIZE))}
            return F.struct(F.struct(*(found[n].alias(name) for n, (name, _) in FIELDS.items())).alias("params"), F.coalesce(*(F.when(x[n]["bad"], F.lit(n)) for n in FIELDS)).alias("bad"))

        return shape.let(fields, told)

    split = requests.withColumn("_told", shape.let(given, whole))
    kept = [c for c in requests.columns if c not in ("params", "bad")]
    return split.select(*kept, F.when(F.col("_told.bad").isNull(), F.col("_told.params")).alias("params"), F.col("_told.bad").alias("bad"))


def parsed_once(requests: DataFrame, query: str = "query") -> DataFrame:
    """As ``parsed``, but a query string is read once for all requests that send it; for tables in which many do."""
    # a number of its own, as reading takes long for few bytes
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = parsed(requests.select(F.col(query).alias("_said")).repartition(parts, "_said").distinct(), "_said")
    kept = [c for c in requests.columns if c not in ("params", "bad")]
    return requests.select(*kept).join(read, F.col(query).eqNullSafe(F.col("_said"))).drop("_said")
