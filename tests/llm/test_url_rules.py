"""URL rules against a direct reading of every rule for every url."""

import random

import pytest

from tessera.llm import common, url_rules
from tessera.llm.url_rules import judged

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b.net", "/es/x", "allow"), ("net", "", "block"), ("org", "/p", "block"),
    ("org", "/p", "allow"), ("x.org", "/", "allow"), (None, "/", "block"), ("com", None, "block"), ("", "/void", "block"), ("Up.Com", "/Case", "block"), ("t.net", "/a/b/c", "block"), ("t.net", "/a/b", "allow"),
]
HOSTS = ["com", "example.com", "WWW.Example.com", "m.www.example.com", "badexample.com", "a.b.net", "b.net", "x.org", "q.x.org", "", ".net", "net.", "a..org", "up.com", "t.net", "z.t.net", "localhost"]
PATHS = ["", "/", "/en", "/en/", "/en/a/b", "/es/x", "/es/xyz/", "/p", "/pq/r", "/Case", "/case", "/a/b", "/a/b/c/d", "//", "/void/1"]


def urls():
    out = [f"{s}{h}{p}{q}" for s in ("http://", "://", "https://u://") for h in HOSTS for p in PATHS for q in ("", "?a=/en/", "#/es/")]
    return [*out, None, "", "example.com/en/", "http:/example.com/", "http://a.com/b://c.net/es/", "http://" + "w." * 3000 + "example.com/en/" + "d/" * 5000]


def direct(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), h.lower() + p, v) for h, p, v in rules if h is not None and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


@pytest.mark.parametrize(("hot", "salts"), [(1 << 14, 16), (50, 3)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_judged(spark, monkeypatch, hot, salts, broadcast):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(url_rules, "SALTS", salts)
    given = urls() + ["http://www.example.com/en/"] * 400
    rows = [(k if k % 7 else None, u, "h", 1, "r") for k, u in enumerate(given)]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, Verdict int, html string").repartition(3)
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = judged(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
        assert got.columns[:2] == ["host", "path"] or {"page_id", "url", "host_in", "Verdict_in", "html", "host", "path", "rule", "verdict"} == set(got.columns)
        out = sorted(((r.page_id, r.url, r.host_in, r.html, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out == sorted(((i, u, "h", "r", *direct(u, RULES)) for i, u, *_ in rows), key=repr)


def test_digests_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SHORT", 1)  # sixteen short prefixes: most expressions that meet are different ones
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls())], "page_id long, url string")
    got = judged(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert {(r.page_id, r.rule, r.verdict) for r in got.collect()} == {(k, *direct(u, RULES)[2:]) for k, u in enumerate(urls())}


def test_edges(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judged(pages.where("false"), rules).count() == 0
    assert [tuple(r) for r in judged(pages, rules.where("false"), otherwise="block").select("page_id", "host", "path", "rule", "verdict").collect()] == [(1, "a.com", "/", None, "block")]
    assert judged(pages.withColumnRenamed("url", "path"), rules, url="path").select("page_id", "path_in", "path", "rule").collect() == [(1, "http://a.com/", "/", "com/")]
