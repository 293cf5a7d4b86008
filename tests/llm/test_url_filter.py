import re
from collections import Counter

import duckdb
import pytest

from edgeloom.llm import url_filter
from edgeloom.llm.url_filter import RULES, compile_rules, judge

URLS = [
    None, "", "no scheme", "http://", "https://org", "https://org/", "https://a.org/x", "https://xorg/", "https://EXAMPLE.org/es/1", "http://www.Example.ORG/en/1", "http://www.example.org/en/12?x#y",
    "http://www.example.org/en/2", "http://example.org?/es/", "http://example.org#/es/", "http://example.org/es", "http://example.com/fr/", "http://a.b.com/de/x", "http://com/de/", "http://notcom/de/",
    "http://example.com/FR/", "http://spam-farm.example.net/x", "http://x.spam-farm.net/", "http://notspam-farm.net/", "http://example.org:80/es/", "http://u@example.org/es/", "a://b://c.org/fr/", "http://example.org/es/\n",
    "http://\nexample.org/es/", "http://ünï.org/es/", "http://.org/", "http://a..com/fr/", "http://e.org/" + "x/" * 5000, "HTTP://A.COM/fr/?q=1", "http://a.com/fr/", "http://a.com/fr/",
    "http://casino.net/", "http://m.free-bets.example.net/x", "http://freebets.net/", "http://free-pills.net/", "http://mycasino.net/", "http://a.net/casino/", "http://a.net/x/cart/1", "http://a.net/CART/", "http://cheap.pills.net/wp-login.php", "http://casino",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, next((v for p, _, v in url_filter.PATTERNS if re.search(p, host + path)), "allow")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i if i else None, u, "h", "t", "r") for i, u in enumerate(URLS)] + [(5, URLS[5], "h", "t", "r")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, token string, rule string")


def test_equals_brute_force(pages):
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(pages).collect())
    assert got == Counter((r.page_id, *brute(r.url)) for r in pages.collect())


def test_main_path_is_native(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages"))
    plan = judge(spark.read.parquet(str(tmp_path / "pages")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_sql(pages):
    c = duckdb.connect()
    given = pages.toPandas()  # noqa: F841
    c.sql("CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url FROM given")
    want = Counter(c.sql(url_filter.ORACLE_SQL["op6_url_filter"]).fetchall())
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(pages).collect()) == want


def test_other_rules(pages):
    assert {r.verdict for r in judge(pages, [], "block").collect()} == {"block"}
    rules = compile_rules([("b.com", "/", "block"), ("com", "/de/", "allow")], [(r"^$", (), "block")])
    got = {(r.host, r.path): (r.rule, r.verdict) for r in judge(pages, rules).collect()}
    assert got["a.b.com", "/de/x"] == ("com/de/", "allow")
    assert got["", ""] == (None, "block")


def test_rarest_token_and_candidates_only(spark, pages):
    """A rule stands under its rarest token, and its pattern, which would raise, runs for no URL without that token."""
    rule = url_filter.Rule("bad", "(", ("org", "nowhere", "com"), "block", 5)
    rules = url_filter.rule_table(spark, [*compile_rules(), rule])
    host, path = url_filter.url_parts(pages["url"])
    index = url_filter.rule_index(pages.select(host.alias("host"), path.alias("path")), rules).collect()
    assert {r.token for r in index if r.rule == "bad"} == {"nowhere"}
    assert {r.rule: r.token for r in index if r.rule and r.rule.startswith("example")} == {"example.org/es/": "es", "example.org/en/1": "en"}
    got = Counter((r.page_id, r.verdict) for r in judge(pages, rules).collect())
    assert got == Counter((r.page_id, r.verdict) for r in judge(pages).collect())
    other = spark.createDataFrame([(1, "http://nowhere.com.org/")], "page_id long, url string")
    with pytest.raises(Exception, match="(?i)pattern|regex|group"):
        judge(other, rules).collect()


@pytest.mark.parametrize("literal", [20_000, 10])
def test_long_lists(spark, pages, monkeypatch, literal):
    """Thousands of rules, looked up in the row and joined: the same verdicts."""
    monkeypatch.setattr(url_filter, "LITERAL_RULES", literal)
    many = compile_rules([*RULES, *((f"host{i}.net", f"/p{i}/", "block") for i in range(5000))])
    more = pages.union(spark.createDataFrame([(90, "http://x.host77.net/p77/y", "", "", ""), (91, "http://host77.net/p7/", "", "", "")], pages.schema))
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in judge(more, many).collect()}
    assert got[90, "x.host77.net", "/p77/y"] == ("host77.net/p77/", "block")
    assert got[91, "host77.net", "/p7/"] == (None, "allow")
    for r in pages.collect():
        host, path, rule, verdict = brute(r.url)
        assert got[r.page_id, host, path] == (rule, verdict)


def test_no_shuffle(pages, tmp_path, spark):
    pages.write.parquet(str(tmp_path / "pages"))
    plan = judge(spark.read.parquet(str(tmp_path / "pages")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "from_json"))


def test_empty_table(pages):
    assert judge(pages.limit(0)).collect() == []
