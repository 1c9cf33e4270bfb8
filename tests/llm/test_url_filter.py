import pytest

from tallyvane.llm import url_filter as u
from tallyvane.llm.queries import URL_RULES


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fitting = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fitting) if fitting else (0, None, "allow")
    return host, path, best[1], best[2]


URLS = [
    "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/1", "http://example.com", "http://example.com/en", "ftp://x.net/es/1", "net/es/", "http://notexample.com/en/",
    "http:///es/", "http://é.net/fr/É", "", None, "://", "http://a.b.c.d.e.f.g.com/" + "p/" * 3000, "http://x.org/#/es/", "http://x.net/de/http://y.net/es/", "http://x.net?/es/",
]


@pytest.mark.parametrize("bound", [0, u.BROADCAST_RULES])
def test_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(u, "BROADCAST_RULES", bound)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    rows = [(i, x, "clash") for i, x in enumerate(URLS)] + [(1, URLS[1], "clash"), (None, URLS[0], "clash")]
    got = u.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string"), rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *brute(x, URL_RULES)) for i, x, _ in rows), key=key)


def test_no_rules_no_pages_and_conflicts(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in u.url_verdicts(pages, none).collect()] == [(1, "a.com", "/x", None, "allow")]
    assert u.url_verdicts(pages.limit(0), none).collect() == []
    both = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block"), (None, "/", "allow")], "host string, path string, verdict string")
    assert u.url_verdicts(pages, both).first().verdict == "block"
