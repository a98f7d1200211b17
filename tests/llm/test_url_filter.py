import pytest

from regcast.llm.url_filter import url_verdicts

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b.org", "/fr/x"), ("allow", "EXAMPLE.com", "/de/ok/page"), ("block", "example.com", "/de/"), ("block", "bare.io", None), ("allow", None, "/x")]
URLS = [
    None, "", "no scheme", "http://example.net", "http://example.net/", "HTTP://Sub.Example.NET/en/x?y#z", "https://anexample.net/en/", "http://example.com/de", "http://example.com/de/",
    "http://x.example.com/de/ok/page2", "http://example.com/de/ok/pag", "http://org/fr/1", "http://z.a.b.org/fr/xy", "http://a.b.org/fr/", "http://bare.io", "http://www.bare.io?x=/y", "ftp://a://net/",
    "http://ÉXAMPLE.net/q", "http://example.net:80/en/", "http://" + "a." * 3000 + "net/" + "b/" * 3000, "x://net/\n/#",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for action, h, p in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h) + len(p), len(h), action == "block", h + p, action))
    best = max(fits) if fits else (0, 0, 0, None, "allow")
    return host, path, best[3], best[4]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "action string, host string, path string")


def test_equals_brute_force(spark, rules):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] * 2, "page_id long, url string")
    rows = url_verdicts(df, rules).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]]), URLS[r["page_id"]]


def test_shuffled_rules_give_the_same(spark, rules, monkeypatch):
    from regcast.llm import common, url_filter

    monkeypatch.setattr(url_filter, "maybe_broadcast", lambda df: common.maybe_broadcast(df, -1))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]]) for r in url_verdicts(df, rules).collect())


def test_empty_tables_and_clashing_names(spark, rules):
    df = spark.createDataFrame([("x", "http://a.net/", "h")], "rule string, url string, host string")
    out = url_verdicts(df, rules)
    assert out.columns == ["rule", "url", "host", "host_", "path", "rule_", "verdict"]
    assert out.first()["rule_"] == "net/" and out.first()["rule"] == "x"
    assert url_verdicts(df.limit(0), rules).count() == 0
    assert url_verdicts(df, rules.limit(0)).first()["verdict"] == "allow"


def test_no_python_in_the_plan(spark, rules):
    plan = url_verdicts(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
