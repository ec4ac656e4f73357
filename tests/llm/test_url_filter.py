import re

import pytest

from corpusguard.llm import url_filter as module
from corpusguard.llm.url_filter import BLOCKED_WORDS, RULES, Rule, url_filter

URLS = [
    None,
    "",
    "no scheme/com/en/1",
    "http://",
    "http://Example.COM/en/742",
    "http://example.com/en/8?x=/en/7",
    "https://a.b.example.com/en/7",
    "http://notexample.com/en/7",
    "http://com/en/",
    "http://com/en",
    "http://x.com/EN/7",
    "http://x.net/de/8#top",
    "http://example.net/de/81",
    "http://x.example.net/de/9",
    "http://x.org/es/",
    "http://x.org?/es/",
    "http://x.org#/es/",
    "http://example.com:8080/en/7",
    "a://b://c.com/en/1",
    "http://cheap-pills.example.com/en/7",
    "http://www.cheap-pills.example.org/de/1",
    "http://pillsbury.example.org/de/1",
    "http://ok.example.org/casino/1",
    "http://casino/",
    "http://Ünï.com/en/é",
    "http://x.com/en/" + "y" * 50_000,
]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if ("." + host).endswith("." + r.name.split("/", 1)[0]) and path.startswith("/" + r.name.split("/", 1)[1])]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.verdict
    return host, path, None, "block" if re.search(rf"(^|[.-])({'|'.join(BLOCKED_WORDS)})([.:-]|$)", host) else "allow"


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_all_rules(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(module, "BROADCAST_RULES", 0)
    data = [(i, u, "x", "kept", 1) for i, u in enumerate(URLS + URLS[4:8])]
    frame = spark.createDataFrame(data, "page_id long, url string, rule string, token string, n int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.token) for r in url_filter(frame).collect())
    assert got == [(i, *expected(u), "kept") for i, u, *_ in data]


def test_no_rows_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(empty).collect() == []
    one = spark.createDataFrame([(1, "http://x.com/en/1")], "page_id long, url string")
    assert [tuple(r) for r in url_filter(one, []).collect()] == [(1, "http://x.com/en/1", "x.com", "/en/1", None, "allow")]
    with pytest.raises(ValueError):
        url_filter(one, [Rule("any", "block", ".*", ())])


def test_no_python_in_the_plan(spark):
    plan = url_filter(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
