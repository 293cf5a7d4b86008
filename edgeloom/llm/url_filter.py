"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the rules whose patterns then run."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ascii_lower, table

#: (host, path, verdict), as the query's contract states them.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words of host names that follow each other, for URLs that no rule fits: gambling, drugs, adult pages, link farms, copies, advertisements.
HOST_WORDS = (
    "casino", "casinos", "poker", "jackpot", "free bets", "online betting", "slot machines", "cheap pills", "online pharmacy", "viagra", "cialis", "payday loans", "replica watches", "porn", "xxx", "escorts",
    "spam farm", "link farm", "warez", "torrents", "adserver", "doubleclick", "click tracker",
)
#: Parts of paths that hold no texts: log-ins, baskets, scripts, feeds of statistics.
PATHS = ("/wp-login.php", "/wp-admin/", "/cgi-bin/", "/cart/", "/checkout/", "/xmlrpc.php", "/phpmyadmin/", "/server-status/")
#: (pattern over host and path, its literal tokens, verdict).
PATTERNS = (
    *((rf"^(?:[^/]*[.-])?{'[.-]'.join(w.split())}[.:/-]", tuple(w.split()), "block") for w in HOST_WORDS),
    *((f"{re.escape(p)}", tuple(re.findall("[A-Za-z0-9]+", p)), "block") for p in PATHS),
)
#: Lists of so many rules go to the executors as a whole, to be looked up within the row; longer ones are joined.
LITERAL_RULES = 20_000
_RULE = "struct<token: string, rank: int, rule: string, pattern: string, verdict: string>"


class Rule(NamedTuple):
    rule: str | None
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def compile_rules(rules=RULES, patterns=PATTERNS) -> list[Rule]:
    """A host rule fits the host and its subdomains if the path starts with its path; longer rules rank higher, patterns below all.

    The literal tokens of a rule are those that every URL it fits has: runs of A-Z, a-z and 0-9, but for one that the rule's end may cut.
    """
    out = []
    for host, path, verdict in rules:
        literal = tuple(dict.fromkeys(re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", host + path)))
        out.append(Rule(host + path, rf"^(?:[^/]*\.)?\Q{host}{path}\E", literal, verdict, len(host + path)))
    return out + [Rule(None, p, tokens, verdict, -i - 1) for i, (p, tokens, verdict) in enumerate(patterns)]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    given = F.from_json(F.lit(json.dumps([r._asdict() for r in rules])), "array<struct<rule: string, pattern: string, tokens: array<string>, verdict: string, rank: int>>")
    return spark.range(1).select(F.inline(given))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct runs of A-Z, a-z and 0-9 in host and path, and '' for the rules without a token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.concat_ws("/", host, path), "[^A-Za-z0-9]+")))


def rule_index(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rank, rule, pattern, verdict): each of rules(rule, pattern, tokens, verdict, rank) under the literal token that the fewest
    URLs of pages(host, path) have, which are counted over all rows. A rule without any literal token stands under ''.
    """
    each = rules.select("rank", "rule", "pattern", "verdict", F.explode_outer("tokens").alias("t")).withColumn("t", F.coalesce("t", F.lit("")))
    wanted = each.select("t").where("t <> ''").distinct()
    counts = pages.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("t")).join(wanted, "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("x")
    return each.join(counts, "t", "left").groupBy("rank", "rule", "pattern", "verdict").agg(rarest).select(F.col("x.t").alias("token"), "rank", "rule", "pattern", "verdict")


def _in_row(index: DataFrame, buckets: int, tokens: Column, url: Column) -> Column:
    """The rules that fit a URL, looked up within its row: the index is one constant, rules in buckets by a hash of their tokens."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")
    own = index.groupBy(place(F.col("token")).alias("b")).agg(F.collect_list(F.struct("token", "rank", "rule", "pattern", "verdict")).alias("rules"))
    every = index.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(own, "b", "left").select("b", F.coalesce("rules", F.array().cast(f"array<{_RULE}>")).alias("rules"))
    rows = every.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("b", "rules"))), lambda x: x["rules"])).alias("index"))
    table = F.from_json(F.lit(rows.first()["index"]), f"array<array<{_RULE}>>")  # LITERAL_RULES rules at most; folded to a value once
    return F.flatten(F.transform(tokens, lambda t: F.filter(F.element_at(table, place(t) + 1), lambda r: (r["token"] == t) & F.rlike(url, r["pattern"]))))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url).

    rules: as compile_rules() gives them, or a table like rule_table()'s, of any length. Null URLs and those without ``://`` have an empty
    host and path, fit no rule and get the default; repeated rows and repeated or null ids each keep their row; other columns are ignored;
    an empty table gives an empty result. Of the rules that fit the longest wins, and of equally long ones the first in alphabetical order;
    where none fits, the first fitting pattern decides, else the default.
    """
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, compile_rules() if rules is None else rules)
    host, path = url_parts(pages["url"].cast("string"))
    p = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    index, n = rule_index(p, rules), rules.count()
    tokens, url = url_tokens(F.col("host"), F.col("path")), F.concat("host", "path")
    best = lambda r: F.struct((-r["rank"]).alias("order"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))
    if n <= LITERAL_RULES:
        fits = _in_row(index, 1 << max(4, (2 * n).bit_length()), tokens, url)
        found = p.withColumn("best", F.array_min(F.transform(fits, best)))
    else:  # each distinct URL is judged once
        each = p.select("host", "path").distinct().select("host", "path", F.explode(tokens).alias("token")).join(index, "token").where(F.rlike(url, F.col("pattern")))
        found = p.join(each.groupBy("host", "path").agg(F.min(best({c: F.col(c) for c in ("rank", "rule", "verdict")})).alias("best")), ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = [(h, p, v) for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    test = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: " ".join(f"WHEN {test(h, p)} THEN '{pick(h, p, v)}'" for h, p, v in fits)
    spam = " ".join(f"WHEN regexp_matches(host || path, '{p}') THEN '{v}'" for p, _, v in PATTERNS)
    return f"""
WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s)
SELECT page_id, host, path, CASE {case(lambda h, p, v: h + p)} END AS rule,
       CASE {case(lambda h, p, v: v)} {spam} ELSE 'allow' END AS verdict FROM p"""


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE_SQL = {"op6_url_filter": _sql()}


