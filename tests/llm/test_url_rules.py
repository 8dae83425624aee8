import random

from lantern.llm import url_filter
from lantern.llm import url_rules as x

FILTERS = {
    "||Ads.example.com^": ["ads.example.com/", "ads.example.com:*/"], "||ads.example.com^*": ["ads.example.com/", "ads.example.com:*/"], "||track": ["track*/"], "||x.com/A/b*c": ["x.com/A/b*c"], "||x.com/": ["x.com/"],
    "-Banner-": ["*-banner-*/", "*/*-Banner-"], "/ads/": "expression", "/ads/x": ["*/ads/x", "*/*/ads/x"], "**pop**up": ["*pop*up*/", "*/*pop*up"], "x.com##.ad": "element", "x.com#@#.ad": "element",
    "||x.com^$third-party": "options", "||x.com$script,domain=~y.com": "options", "|http://x.com/": "anchor", "x.swf|": "anchor", "http://x": "anchor", "||": "empty", "*": "empty", "||/a": "empty", "/a?b=": "query",
    "||x.com/a^b": "separator", "a^b": "separator", "||x.com^a": "separator", "  ||y.de^\r": ["y.de/", "y.de:*/"], "/a/$b/c": ["*/a/$b/c", "*/*/a/$b/c"],
}


def lines(spark, rows):
    return spark.createDataFrame([(r, 1) for r in rows], "line string, rule int")


def told(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["line"], []).append(r["rule"] if r["refused"] is None else r["refused"])
        assert (r["rule"] is None) == (r["refused"] is not None)
    return found


def test_filters(spark):
    given = [*FILTERS, *(f"@@{k}" for k in FILTERS if k.startswith("||")), None, "", "  ", "! note", "[Lists 2.0]"]
    got = told(x.filters(lines(spark, given)))
    want = {k: [v] if isinstance(v, str) else v for k, v in FILTERS.items()}
    want |= {f"@@{k}": v for k, v in want.items() if k.startswith("||")}
    assert got == want
    assert {(r["line"][:2] == "@@", r["verdict"], r["tier"]) for r in x.filters(lines(spark, given), 4).collect()} == {(True, "allow", 4), (False, "block", 5)}
    assert x.filters(lines(spark, [])).collect() == []
    long = "||x.com/" + "ab/" * 20_000
    assert [r["rule"] for r in x.filters(lines(spark, [long, long])).collect()] == [long[2:]] * 2


def test_hosts(spark, tmp_path):
    text = "# list\n127.0.0.1 localhost\n::1 localhost ip6-loopback\n0.0.0.0 Bad.example.com other.net # both\n\nalone.org\n0.0.0.0\n0.0.0.0 a/b\n.dotted.de.\n"
    (tmp_path / "hosts.txt").write_text(text)
    got = [(r["rule"], r["verdict"], r["tier"], r["refused"]) for r in x.read(spark, str(tmp_path), "hosts").collect()]
    assert got == [("bad.example.com/", "block", 2, None), ("other.net/", "block", 2, None), ("alone.org/", "block", 2, None), (None, "block", 2, "name"), ("dotted.de/", "block", 2, None)]


def brute(url, filters):
    """The verdict by the meaning of each line, without rules or regular expressions."""
    host, _, path = url.partition("://")[2].partition("/")
    host, path = host.lower(), "/" + path
    verdict = "allow"
    for line in filters:
        body = line.removeprefix("@@")
        if body.startswith("||"):
            name, sep, tail = body[2:].partition("^") if body.endswith("^") else (*body[2:].partition("/")[:2], body[2:].partition("/")[2])
            suffixes = [host[i:] for i in range(len(host)) if i == 0 or host[i - 1] == "."]
            if sep == "^":
                fits = any(s == name or s.startswith(name + ":") for s in suffixes)
            elif sep == "/":
                fits = name in suffixes and path.startswith("/" + tail)
            else:
                fits = any(s.startswith(name) for s in suffixes)
        elif "/" in body:
            fits = (host + path).find(body) >= 0
        else:
            fits = body in host or body in path
        if fits and line.startswith("@@"):
            return "allow"
        verdict = "block" if fits else verdict
    return verdict


def test_thousands_of_lines_against_their_meaning(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ad", "news", "shop", "zz") for b in range(9)]
    host = lambda: ".".join([*rng.choices(words, k=rng.randint(1, 3)), rng.choice(["com", "org"])])
    path = lambda: "/".join(rng.choices(words, k=rng.randint(1, 3)))
    def line():
        kind = rng.choice(["||{0}^", "||{0}/{1}", "||{0}", "-{2}-", "{2}/{2}/x", "@@||{0}^", "@@||{0}/{1}"])
        return kind.format(host(), path(), rng.choice(words))
    listed = [line() for _ in range(2500)]
    urls = list({f"http://{rng.choice([host(), host() + ':8080', 'a-' + rng.choice(words) + '-b.org'])}/{rng.choice([path(), path() + '-' + rng.choice(words) + '-', path() + '/x', ''])}" for _ in range(400)})
    rules = x.filters(lines(spark, listed)).where("refused IS NULL")
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules.select("rule", "verdict", "tier")).collect()
    assert len(got) == len(urls) and {r["url"]: r["verdict"] for r in got} == {u: brute(u, listed) for u in urls}
    assert {r["verdict"] for r in got} == {"allow", "block"}
