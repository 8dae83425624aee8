import random
from urllib.parse import quote, unquote_to_bytes

from lantern.plans import requests
from lantern.plans.params import InvalidParameter, SearchParams

NAMES = ["q", "free", "priceMax", "age", "from", "to", "setting", "categoryId", "lat", "lng", "radiusKm", "page", "pageSize"]


def one(query):
    """The query string read sign by sign, then the single parser: its parameters, or the first bad field."""
    given = {}
    for part in (query or "").split("#")[0].removeprefix("?").split("&"):
        if part:
            name, _, value = part.partition("=")
            pair = []
            for x in (name, value):
                at = [i for i, c in enumerate(x) if c == "%"]
                sound = all(len(x[i + 1 : i + 3]) == 2 and all(c in "0123456789abcdefABCDEF" for c in x[i + 1 : i + 3]) for i in at)
                x = x.replace("+", " ")
                try:
                    pair.append(unquote_to_bytes(x).decode() if sound else x)
                except UnicodeDecodeError:
                    pair.append(x)
            given.setdefault(pair[0], []).append(pair[1])
    for n in NAMES:
        if len(given.get(n, [])) > 1 or any(k.startswith(f"{n}[") for k in given):
            # what comes before it may be bad as well
            rest = {k: v[0] for k, v in given.items() if k in NAMES[: NAMES.index(n)]}
            try:
                SearchParams.parse(rest)
            except InvalidParameter as e:
                return str(e)
            return n
    try:
        return SearchParams.parse({k: v[0] for k, v in given.items()})
    except InvalidParameter as e:
        return str(e)


def many(spark, strings):
    df = spark.createDataFrame(list(enumerate(strings)), "id long, query string").repartition(3)
    rows = requests.parsed(df).orderBy("id").collect()
    return [r["bad"] if r["params"] is None else SearchParams(**r["params"].asDict()) for r in rows]


def test_known_strings(spark):
    cases = {
        "": SearchParams(), "?": SearchParams(), None: SearchParams(), "&&x=1&=2&q": SearchParams(), "q=+%C3%A9t%C3%A9+&age=4.0": SearchParams(q="été", age=4), "q=%zz": SearchParams(q="%zz"), "q=%ff": SearchParams(q="%ff"),
        "q=%EF%BF%BD": SearchParams(q="�"), "priceMax=": SearchParams(price_max=0.0), "priceMax=0x1F": SearchParams(price_max=31.0), "priceMax=1_0": "priceMax", "priceMax=%D9%A1": "priceMax", "priceMax=1e400": "priceMax", "priceMax=-1": "priceMax",
        "priceMax=%20%2B.5e1%C2%A0": SearchParams(price_max=5.0), "age=18": SearchParams(age=18), "age=19": "age", "age=3.5": "age", "age=": SearchParams(age=0), "from=2024-02-30": "from", "from=2024-02-29": one("from=2024-02-29"),
        "from=2024-02-29%0A": "from", "to=0000-01-01": "to", "free=TRUE": "free", "free=false": SearchParams(), "setting=BOTH&free=true": SearchParams(setting="BOTH", free=True), "setting=": "setting", "categoryId=0": "categoryId",
        "categoryId=9999999999": "categoryId", "lat=90&lng=-180&radiusKm=0.1": SearchParams(lat=90.0, lng=-180.0, radius_km=0.1), "radiusKm=": "radiusKm", "page=0": "page", "page=3&pageSize=50": SearchParams(page=3, page_size=50), "pageSize=51": "pageSize",
        "lat=1&lat=1": "lat", "q[]=a": "q", "age[x]=1&page=0": "age", "page=0&age=99": "age", "q=" + "x" * 200: SearchParams(q="x" * 200), "q=" + "x" * 201: "q", "q=" + "%F0%9D%84%9E" * 100: SearchParams(q="\U0001d11e" * 100),
        "q=" + "%F0%9D%84%9E" * 101: "q", "q=a%26b%3Dc=d#age=99": SearchParams(q="a&b=c=d"),
    }
    got = many(spark, list(cases))
    for (query, want), found in zip(cases.items(), got, strict=True):
        assert found == want == one(query), query


def test_random_strings_against_the_single_parser(spark):
    rng = random.Random(4)
    values = ["", "1", "0", "18", "4.0", "-3", "1e1", ".5", "5.", "0x1f", "0b11", "0o7", "1_0", "NaN", "Infinity", " 7 ", "\t2\n", " 3", "٣", "2024-02-29", "2023-02-29", "2030-1-1", "true", "false", "INDOOR", "BOTH", "été & co", "a=b", "%", "%4", "%41", "+", "💡", "x" * 199 + "é", "300", "0.1", "-90", "180.5", "12", "1e-7", "+5", "--5", "5 5"]
    plain = lambda s: s if rng.random() < 0.2 and not set(s) & set("&#") else quote(s, safe="" if rng.random() < 0.5 else "+%")
    strings = []
    for _ in range(3000):
        names = rng.choices([*NAMES, "other", "Q"], k=rng.randint(0, 5))
        strings.append(rng.choice(["", "?"]) + "&".join(rng.choice([n, n, n, n + "[]"] if rng.random() < 0.05 else [n]) + rng.choice(["=", "=", "=", ""] if rng.random() < 0.1 else ["="]) + plain(rng.choice(values)) for n in names) + rng.choice(["", "", "#x", "&"]))
    want = [one(s) for s in strings]
    assert many(spark, strings) == want and 500 < sum(isinstance(w, SearchParams) for w in want) < 2900 and {w for w in want if isinstance(w, str)} == set(NAMES)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([("age=3", "p", "b")], "query string, params string, bad string")
    assert requests.parsed(df).first()["params"]["age"] == 3 and requests.parsed(df.limit(0)).columns == ["query", "params", "bad"] and requests.parsed(df.limit(0)).count() == 0
