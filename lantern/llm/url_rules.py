"""Rule lists in two public written forms, as the rules of ``url_filter``.

``filters``, one pattern a line: ``||host^`` (a host and its subdomains, any port), ``||host`` (what begins so),
``||host/path``, and any other text, which may stand anywhere in host and path; ``*`` stands for any run, ``@@`` makes an
exception; lines with ``!`` and headers in brackets say nothing. ``hosts``: an address and names on a line, or a name alone, ``#``
begins a comment; a name covers its subdomains as well, and the names of the machine itself are left out.

Everything is a DataFrame expression over a table of lines, so a list may have any size. Exceptions get ``tier``, other
rules ``tier + 1``, as an exception is stronger. Hosts are lower-cased, paths are compared as written.

What a rule of host and path cannot say is refused, never guessed at: a row with null ``rule`` and a reason in ``refused``
(``element``, ``expression``, ``options``, ``anchor``, ``separator`` in a path, ``query``, ``name``, ``empty``).

Defined results: a null or blank line gives no row; repeated lines (ties) give their rules as often, which judge alike; a very long
line is a rule like any other; an empty table gives no rows; columns other than ``line`` play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import ascii_lower

#: Names that a hosts file gives to the machine itself.
OWN_NAMES = ["localhost", "localhost.localdomain", "local", "broadcasthost", "ip6-localhost", "ip6-loopback", "ip6-allnodes", "ip6-allrouters"]


def _host_lowered(rule: Column) -> Column:
    host = F.substring_index(rule, "/", 1)
    return F.concat(ascii_lower(host), F.substring(rule, F.length(host) + 1, F.length(rule)))


def _told(rows: DataFrame, rules: Column, refused: Column, tier: Column) -> DataFrame:
    """One row a rule, or one row that tells why there is none."""
    rows = rows.select("line", "verdict", tier.cast("int").alias("tier"), refused.alias("refused"), rules.alias("_rules"))
    each = F.when(F.col("refused").isNull(), F.col("_rules")).otherwise(F.array(F.lit(None).cast("string")))
    return rows.select("line", F.explode(each).alias("rule"), "verdict", "tier", "refused")


def filters(lines: DataFrame, tier: int = 1) -> DataFrame:
    """``line, rule, verdict, tier, refused`` of a list of filter patterns."""
    text = F.trim(F.regexp_replace("line", "[\\r\\n\\t]", " "))
    rows = lines.select("line", text.alias("_text")).where("_text <> ''").where("NOT startswith(_text, '!') AND NOT _text RLIKE '^\\\\[.*\\\\]$'")
    exempt = F.startswith("_text", F.lit("@@"))
    body = F.regexp_replace(F.regexp_replace("_text", "^@@", ""), "\\*+", "*")
    rows = rows.select("line", F.when(exempt, "allow").otherwise("block").alias("verdict"), body.alias("_body"))
    anchored = F.startswith("_body", F.lit("||"))
    rest = F.regexp_replace("_body", "^\\|\\|", "")
    host = F.regexp_extract(rest, "^[^/^]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    refused = (
        F.when(F.col("_body").rlike("#[@?$%]?#"), "element")
        .when(F.col("_body").rlike("^/.+/(\\$[^/]*)?$"), "expression")
        .when(F.col("_body").rlike("\\$~?[A-Za-z][^/]*$"), "options")
        .when(F.col("_body").rlike("^[*^|/]*$") | (anchored & (host == "")), "empty")
        .when(F.col("_body").rlike("\\|$|^\\|[^|]|[^|]\\||://"), "anchor")
        .when(F.contains("_body", F.lit("?")), "query")
        .when(F.when(anchored, F.contains(tail, F.lit("^")) & ~tail.rlike("^\\^\\*?$")).otherwise(F.contains("_body", F.lit("^"))), "separator")
    )
    whole = F.array(F.concat(host, F.lit("/")), F.concat(host, F.lit(":*/")))
    at_host = F.when(tail == "", F.array(F.concat(host, F.lit("*/")))).when(F.startswith(tail, F.lit("^")), whole).otherwise(F.array(rest))
    in_path = F.concat(F.lit("*/*"), F.col("_body"))
    anywhere = F.when(F.contains("_body", F.lit("/")), F.array(F.concat(F.lit("*"), "_body"), in_path)).otherwise(F.array(F.concat(F.lit("*"), "_body", F.lit("*/")), in_path))
    rules = F.transform(F.when(anchored, at_host).otherwise(anywhere), lambda r: _host_lowered(F.regexp_replace(r, "\\*+", "*")))
    return _told(rows, rules, refused, F.when(F.col("verdict") == "allow", tier).otherwise(tier + 1))


def hosts(lines: DataFrame, tier: int = 1) -> DataFrame:
    """``line, rule, verdict, tier, refused`` of a hosts file or a list of names."""
    words = F.filter(F.split(F.regexp_replace("line", "#.*", ""), "\\s+"), lambda w: w != "")
    names = F.when(F.try_element_at(words, F.lit(1)).rlike("^[0-9]+(\\.[0-9]+){3}$|:"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    rows = lines.select("line", F.lit("block").alias("verdict"), F.explode(F.transform(names, ascii_lower)).alias("_name"))
    rows = rows.where(~F.col("_name").isin(OWN_NAMES))
    refused = F.when(~F.col("_name").rlike("^[^/?#*^:@|]+$"), "name")
    return _told(rows, F.array(F.concat(F.regexp_replace("_name", "^\\.+|\\.+$", ""), F.lit("/"))), refused, F.lit(tier + 1))


def read(spark: SparkSession, path: str, form: str = "filters", tier: int = 1) -> DataFrame:
    """The rules of the lists below ``path``, with what was refused."""
    return {"filters": filters, "hosts": hosts}[form](spark.read.text(path).withColumnRenamed("value", "line"), tier)
