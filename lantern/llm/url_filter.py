"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a row of ``rule, verdict, tier``: text of the form ``host/path``, ``allow`` or ``block``, and a whole number. The
host part fits a host and its subdomains, the path part is a prefix of the URL's path, and ``*`` stands for any run of
characters (none in it is a ``/`` in the host part), ``^`` for a place that has no letter or digit on one side at least. Rule
sets are data: a list, or a DataFrame of any size, as ``url_rules`` reads it from public forms of lists.

Each rule is filed under one of its keys, the one that the fewest URLs have: its whole literal tokens, or, if it has
none, its literal runs of ``GRAM`` characters. The keys of a URL fetch the candidate rules, and only those run their
regular expression. A rule without any key (``*x*/``) is a candidate for every URL, so no rule is ever lost. Of the
rules that fit, the lowest tier decides, then the longest rule, then the first by code point.

Everything here is a DataFrame expression. A list of up to ``INLINE_RULES`` rules is planned as a map
literal and judges a row without any shuffle; others are a table joined on the key, where each distinct URL is judged
once, and where the engine's skew join may split a key that many URLs or rules have, as nothing needs a key's rows together.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; a very long URL is judged
whole; repeated rows are judged alike, each on its own; of equal rules with different verdicts (ties) ``allow`` decides;
an empty table gives an empty result; columns of the input with the names of the outputs are replaced, all others are
kept, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import ascii_lower, small_or_plain, table, workspace, written

#: Lists of rules up to this size become a literal in the plan; the list is a parameter and does not grow with the data.
INLINE_RULES = 256
#: Characters of a literal run that is a key.
GRAM = 3
#: Rules up to which their table is broadcast; beyond, the join is shuffled.
BROADCAST_RULES = 100_000
#: Literal runs that every fitting URL has as whole tokens: not beside ``*``, not at the open end.
TOKEN = "(?<![A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])"
#: What ``^`` stands for in a pattern.
BORDER = "(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))"


@dataclass(frozen=True)
class Rule:
    """``tier`` 0 is judged before ``tier`` 1, and so on; ``verdict`` is ``allow`` or ``block``."""

    rule: str
    verdict: str
    tier: int = 0

    @property
    def pattern(self) -> str:
        host, _, path = self.rule.partition("/")
        free = lambda text, run: run.join(re.escape(x).replace(r"\^", BORDER) for x in text.split("*"))
        return rf"\A(?:[^/]*\.)?{free(host, '[^/]*')}/{free(path, '(?s:.*)')}"

    @property
    def keys(self) -> list[str]:
        grams = [f"*{x[i : i + GRAM]}" for x in re.split("[*^]", self.rule) for i in range(len(x) - GRAM + 1)]
        return [m[0] for m in re.finditer(TOKEN, self.rule)] or grams


#: The rules of the query's contract, as given.
LISTED = [
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
]
#: Words that name what no corpus wants, as whole tokens of a host. A list is the caller's to choose: "adult"
#: also stands in hosts of schools.
UNWANTED = ["adult", "porn", "xxx", "escort", "casino", "poker", "bets", "betting", "gambling", "jackpot", "viagra", "cialis", "pills", "spam", "malware", "phishing", "warez", "keygen", "ads", "adserver"]
#: The method's own verdict on URLs that no listed rule fits: block hosts with such a word, else allow.
GENERAL = [Rule(f"*^{word}^*/", "block", 1) for word in UNWANTED]


def host_of(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = ascii_lower(F.regexp_extract(after, "\\A[^/?#]*", 0))
    return F.when(F.locate("://", url) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(after, "\\A[^/?#]*([^?#]*)", 1)).otherwise("")


def keys_of(subject: Column, grams: bool) -> Column:
    """What a URL can fetch rules by; its runs of ``GRAM`` characters, marked by a ``*``, only if asked for."""
    keys = F.split(subject, "[^A-Za-z0-9]+")
    if grams:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(subject) - (GRAM - 1)))
        keys = F.concat(keys, F.transform(places, lambda i: F.concat(F.lit("*"), F.substring(subject, i, F.lit(GRAM)))))
    return F.array_distinct(F.concat(keys, F.array(F.lit(""))))


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules`` with ``keys`` and ``pattern``, as ``Rule`` has them."""
    host, path = F.substring_index("rule", "/", 1), F.expr("substring(rule, locate('/', rule) + 1)")
    plain = lambda c: F.replace(F.regexp_replace(c, "([\\\\.\\[\\]{}()+?^$|])", "\\\\$1"), F.lit("\\^"), F.lit(BORDER))
    free = lambda c, run: F.array_join(F.transform(F.split(c, "\\*", -1), plain), run)
    pattern = F.concat(F.lit("\\A(?:[^/]*\\.)?"), free(host, "[^/]*"), F.lit("/"), free(path, "(?s:.*)"))
    tokens = F.regexp_extract_all("rule", F.lit(TOKEN), F.lit(0))
    places = lambda x: F.when(F.length(x) >= GRAM, F.sequence(F.lit(1), F.length(x) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.transform(F.split("rule", "[*^]", -1), lambda x: F.transform(places(x), lambda i: F.concat(F.lit("*"), F.substring(x, i, F.lit(GRAM))))))
    keys = F.when(F.size(tokens) > 0, tokens).otherwise(grams)
    return rules.select("rule", "verdict", F.col("tier").cast("int").alias("tier"), F.array_distinct(keys).alias("keys"), pattern.alias("pattern")).distinct()


def _counted(subjects: DataFrame, wanted: DataFrame, grams: bool) -> DataFrame:
    """How many rows of ``subjects`` have each ``key`` of ``wanted``."""
    seen = subjects.select(F.explode(keys_of(F.col("subject"), grams)).alias("key"))
    return seen.join(wanted, "key", "left_semi").groupBy("key").count()


def index_rules(subjects: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """The rules by the key that the fewest rows of ``subjects`` have; ``""`` has those without a key.

    The counts that reach the driver are one per distinct key of the rules, whatever the rows.
    """
    wanted = sorted({t for r in rules for t in r.keys})
    seen = subjects.select(F.explode(keys_of(F.col("subject"), any(t.startswith("*") for t in wanted))).alias("key"))
    counts = {x["key"]: x["count"] for x in seen.where(F.col("key").isin(wanted)).groupBy("key").count().collect()} if wanted else {}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.keys, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def _entry(r: Rule) -> Column:
    fields = {"rank": r.tier, "size": -len(r.rule), "rule": r.rule, "verdict": r.verdict, "tier": r.tier, "pattern": r.pattern}
    return F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))


def judge(df: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (of the rule that decides, else null), ``tier`` and ``verdict``."""
    # the caller's columns stay together, so that no name of theirs meets one of these
    keep = [c for c in df.columns if c not in {"host", "path", "rule", "tier", "verdict"} - {url}]
    rows = df.select(F.struct(*keep).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("subject", F.concat("host", "path"))
    if isinstance(rules, DataFrame):
        rows = _joined(rows, rules)
    elif len(rules) > inline:
        literal = F.array(*(F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.tier).alias("tier")) for r in rules))
        rows = _joined(rows, df.sparkSession.range(1).select(F.inline(literal)))
    else:
        rows = rows.withColumn("best", _inline(index_rules(rows, rules)))
    out = [F.col("best.rule").alias("rule"), F.col("best.tier").alias("tier"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")]
    return rows.select("row.*", *(c for c in ("host", "path") if c != url), *out)


def _inline(index: dict[str, list[Rule]]) -> Column:
    if not index:
        return F.lit(None).cast("struct<rule:string,tier:int,verdict:string>")
    filed = F.create_map(*(x for t, rules in sorted(index.items()) for x in (F.lit(t), F.array(*map(_entry, rules)))))
    keys = keys_of(F.col("subject"), any(t.startswith("*") for t in index))
    found = F.filter(F.transform(keys, lambda t: F.try_element_at(filed, t)), lambda x: x.isNotNull())
    fits = F.filter(F.flatten(found), lambda c: F.regexp_like(F.col("subject"), c["pattern"]))
    # structs compare field by field: lowest tier, longest rule, first by code point
    return F.array_min(fits)


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins, for rule sets too large for the plan. Distinct subjects are judged once each."""
    folder = workspace(rows.sparkSession)
    known = written(rule_table(rules), folder, "rules")
    subjects = rows.select("subject").distinct()
    wanted = known.select(F.explode("keys").alias("key")).distinct()
    # runs of characters are made of a URL only if some rule has to be filed under one
    grams = bool(wanted.where(F.startswith("key", F.lit("*"))).take(1))
    counts = _counted(subjects, small_or_plain(wanted, BROADCAST_RULES), grams)
    each = known.select("rule", "verdict", "tier", "pattern", F.explode_outer("keys").alias("key")).join(counts, "key", "left")
    rarest = F.min_by("key", F.struct(F.coalesce("count", F.lit(0)), "key"))
    filed = each.groupBy("rule", "verdict", "tier", "pattern").agg(F.coalesce(rarest, F.lit("")).alias("key"))
    filed = written(filed, folder, "filed")
    asked = subjects.select("subject", F.explode(keys_of(F.col("subject"), grams)).alias("key"))
    fits = asked.join(small_or_plain(filed, BROADCAST_RULES), "key").where(F.regexp_like("subject", F.col("pattern")))
    rank = F.struct(F.col("tier").alias("rank"), (-F.length("rule")).alias("size"), "rule", "verdict", "tier")
    best = fits.groupBy(F.col("subject").alias("of_subject")).agg(F.min(rank).alias("best"))
    return rows.join(best, F.col("subject") == F.col("of_subject"), "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every row of ``pages``."""
    judged = judge(table(spark, sf_dir, "pages", "page_id", "url"), LISTED + GENERAL)
    listed = F.when(F.col("tier") == 0, F.col("rule"))
    return judged.select("page_id", "host", "path", listed.alias("rule"), "verdict")


def oracle() -> str:
    def fits(r: Rule) -> str:
        host, _, path = r.rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    ranked = sorted(LISTED, key=lambda r: -len(r.rule))
    case = lambda what: " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in ranked)
    unwanted = f"starts_with(path, '/') AND regexp_matches(host, '(^|[^A-Za-z0-9])({'|'.join(UNWANTED)})([^A-Za-z0-9]|$)')"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {letters}) AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
    SELECT page_id, host, path, CASE {case('rule')} ELSE NULL END AS rule,
           CASE {case('verdict')} WHEN {unwanted} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""
