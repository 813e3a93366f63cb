import re

from pyspark.sql import functions as F

from millrace.llm import url_filter as U
from millrace.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "http://a.example.org/es/x?q=1", "https://x.org/", "https://org/en/1", "http://example.org/en/12#a", "http://example.org/en/2",
    "http://b.com/fr/1", "http://b.com/de/1", "http://b.com/de", "http://xcom/de/", "http://casino-win.net/en", "http://a.net/cheap-pills", "http://a.net/cheap/x", "http://a.net/cheap/cheap",
    "http://a.net/xcasino", "http://casino.org/", "http://é.net/sex", "http://a.net/?u=http://b.com/de/", "http://a\n.net/free-bets", "x" * 20000 + "://free.bets/", "http://a.net/freebets",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    v, low = U.Vocabulary(), (url or "").lower()
    hits = lambda terms: sum(bool(re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", low)) for t in terms)
    bad = hits(v.strict) > 0 or hits(v.soft) >= v.soft_needed
    return host, path, best and best.name, best.action if best else ("block" if bad else "allow")


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, "url", U.UrlPolicy(URL_RULES)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_distinct_soft_terms_and_prefix(spark):
    df = spark.createDataFrame([("http://a.net/free/free",), ("http://a.net/free/bets",)], "url string")
    out = U.judge(df, "url", prefix="u_").orderBy(F.length("url"), "url").collect()
    assert {(r.u_soft_hits, r.u_verdict) for r in out} == {(1, "allow"), (2, "block")}
    assert U.judge(df.limit(0), "url").collect() == []


def test_a_table_of_rules_is_joined(spark):
    """The same verdicts from a constant, from many rules and from a table; ties, repeated rows and clashing names."""
    df = spark.createDataFrame([(i, u, i, "x") for i, u in enumerate(URLS)] * 2, "page_id int, url string, h int, rules string")
    table = spark.createDataFrame([(r.host, r.path, r.action) for r in URL_RULES] * 2, "host string, path string, action string")
    many = URL_RULES + tuple(U.Rule("block", f"h{i}.net", f"/{i}") for i in range(2 * U.INLINE_RULES))
    want = sorted((i, *brute(u)) for i, u in enumerate(URLS)) * 2
    for rules in (URL_RULES, many, table):
        out = U.judge(df, "url", U.UrlPolicy(rules))
        assert out.columns[:4] == ["page_id", "url", "h", "rules"]
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert U.judge(df.limit(0), "url", U.UrlPolicy(rules)).collect() == []
    assert U.judge(df, "url", U.UrlPolicy(table.limit(0))).filter("rule is not null").count() == 0


def test_equally_long_rules(spark):
    df = spark.createDataFrame([("http://a.bc/x",)], "url string")
    rules = (U.Rule("block", "a.bc", "/"), U.Rule("allow", "a.bc", "/"), U.Rule("block", "bc", "/x"), U.Rule("block", "bc", "/"))
    assert U.judge(df, "url", U.UrlPolicy(rules)).first()[:3] == ("http://a.bc/x", "a.bc", "/x")
    r = U.judge(df, "url", U.UrlPolicy(rules)).first()
    assert (r.rule, r.verdict) == ("a.bc/", "allow")


def test_terms_are_data(tmp_path):
    assert len(U.Vocabulary().strict) > 60 and not set(U.Vocabulary().strict) & set(U.Vocabulary().soft)
    (tmp_path / "t").write_text("# words\n[strict]\na b\n[soft]\nc\nc d\n")
    assert U.read_terms(tmp_path / "t") == {"strict": ("a", "b"), "soft": ("c", "d")}
