import functools
import random
import re

import duckdb

from lantern.llm import url_filter as x
from tests.llm.data import pages

EDGES = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "https://EXAMPLE.org"), (6, "https://EXAMPLE.org/"), (7, "https://a.example.org/en/12?x"), (8, "https://example.org/en/2"), (9, "https://notexample.org/es/"),
    (10, "https://example.org/es/1#f"), (11, "http://x.com/fr/"), (12, "http://x.com/de/?q"), (13, "http://x.com:80/de/"), (14, "http://www.cheap-pills.net/x"), (15, "a://b://c.org/es/"), (16, "http://x.net/?u=http://y.org/"),
    (17, "http://x.com/FR/"), (18, "http://ÉXAMPLE.org/"), (19, "http://x.com\n/de/"), (20, "http://casino.net/"), (21, "http://a-CASINO-b.co.uk:80/x"), (22, "http://casinotown.net/"), (23, "http://x.net/casino/"), (24, "http://free_bets.net"), (25, "http://m.xxx.example.com/fr/"), (26, "http://ads.example.com/fr"), (11, "http://x.com/fr/"),
]


def frame(spark):
    return spark.createDataFrame(EDGES, "page_id long, url string").unionByName(pages(spark).select("page_id", "url"))


def test_against_sql_and_by_joins(spark, tmp_path):
    frame(spark).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, x.query(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.execute(x.oracle()).fetchall(), key=str)
    joined = x.judge(frame(spark), x.LISTED + x.GENERAL, inline=0).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["verdict"]) for r in joined), key=str) == sorted(((a, b, c, e) for a, b, c, _, e in got), key=str)


@functools.cache
def compiled(pattern):
    return re.compile(pattern)


def brute(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
    subject = "".join(c.lower() if c.isascii() else c for c in host) + path
    fits = [(r.tier, -len(r.rule), r.rule, r.verdict) for r in rules if compiled(r.pattern).match(subject)]
    return min(fits)[2:] if fits else (None, "allow")


def test_thousands_of_rules_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("news", "shop", "a", "x1", "b+c", "p.q", "Ü") for b in range(12)]
    tops = ["com", "org", "de", "co.uk"]
    def rule():
        host = ".".join(rng.sample(words, rng.randint(0, 2)) + [rng.choice(tops)])
        path = "/".join(rng.choices(words, k=rng.randint(0, 2)))
        text = f"{host}/{path}"
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("*^") + text[k + rng.randint(0, 3) :]
        return text if "/" in text else text + "/"
    rules = list({(t := rule()): x.Rule(t, rng.choice(["allow", "block"]), rng.randint(0, 2)) for _ in range(3000)}.values()) + [x.Rule("*/", "block", 3), x.Rule("*q*/w*", "allow", 2), x.Rule("x*y[/(", "block", 0)]
    urls = [f"http://{'.'.join(rng.choices(words, k=rng.randint(0, 2)) + [rng.choice(tops)])}/{'/'.join(rng.choices(words, k=rng.randint(0, 3)))}" for _ in range(400)] + ["http://xAy[/(", None, "none"]
    df = spark.createDataFrame([(u, "theirs") for u in urls + urls[:5]], "url string, best string")
    table = spark.createDataFrame([(r.rule, r.verdict, r.tier) for r in rules], "rule string, verdict string, tier int")
    want = {u: brute(u, rules) for u in urls}
    got = x.judge(df, table).collect()
    assert len(got) == len(urls) + 5 and all((r["rule"], r["verdict"]) == want[r["url"]] and r["best"] == "theirs" for r in got)
    few = rules[:50] + rules[-3:]
    want = {u: brute(u, few) for u in urls}
    assert all((r["rule"], r["verdict"]) == want[r["url"]] for r in x.judge(df, few).collect())
    assert all((r["rule"], r["verdict"]) == want[r["url"]] for r in x.judge(df, few, inline=10).collect())


def test_keys_and_wildcards(spark):
    assert x.Rule("example.org/en/1", "block").keys == ["example", "org", "en"] and x.Rule("*x*/", "block").keys == [] and x.Rule("*abad*/", "block").keys == ["*aba", "*bad"]
    rules = [x.Rule("*bad*/", "block"), x.Rule("org/a*/c", "allow"), x.Rule("*^not^be*/", "block"), x.Rule("*^\\^e^f*/", "block")]
    listed = spark.createDataFrame([(r.rule, r.verdict, r.tier) for r in [*rules, x.Rule("example.org/en/1", "block")]], "rule string, verdict string, tier int")
    assert {r["rule"]: (sorted(r["keys"]), r["pattern"].replace("\\", "")) for r in x.rule_table(listed).collect()} == {r.rule: (sorted(set(r.keys)), r.pattern.replace("\\", "")) for r in [*rules, x.Rule("example.org/en/1", "block")]}
    urls = spark.createDataFrame([("http://verybadhost.de/",), ("http://x.org/ab/cd",), ("http://x.org/b/c",)], "url string").withColumn("rule", x.F.lit(1))
    assert [r["rule"] for r in x.judge(urls, rules).collect()] == ["*bad*/", "org/a*/c", None]
    assert [r["verdict"] for r in x.judge(urls, [], default="block").collect()] == ["block"] * 3
    assert x.judge(urls.limit(0), rules).collect() == [] == x.judge(urls.limit(0), listed).collect()
