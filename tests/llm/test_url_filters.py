from __future__ import annotations

import random

from dropledger.llm import url_filters as U


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h.count("."), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "verdict string, host string, path string")


URLS = [
    None, "", "no scheme", "http://", "://com/x", "HTTP://WWW.Example.COM/en/a?q#f", "http://example.com/en/", "https://example.com/en",
    "http://xexample.com/en/a", "http://a.b.net/es/1", "http://net/fr/", "http://net/ES/", "http://x.net?q=/es/", "http://com",
    "http://com/", "http://a..com/x", "http://example.com:80/en/", "http://x://y/z", "http://www.example.com/fr/\U0010ffff",
    "http://u@www.example.com/en/é#x", "http://x.org/en/\nfr", "http://K.com/",
]


def test_contract_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r[0]: tuple(r[1:]) for r in U.filter_urls(pages, rules_of(spark, list(U.RULES))).collect()}
    assert got == {i: brute(u, U.RULES) for i, u in enumerate(URLS)}


def test_nested_rules_and_split_sweeps(spark, monkeypatch):
    monkeypatch.setattr(U, "PROBES_PER_SWEEP", 50)
    rng = random.Random(2)
    hosts = ["a", "b.a", "c.b.a", "x.c.b.a", "b", "q.b"]
    paths = ["/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(6))) for _ in range(12)] + ["", "/x\U0010ffff"]
    rules = sorted({(rng.choice(("allow", "block")), rng.choice(hosts[:5]), rng.choice(paths)) for _ in range(40)})
    rules = [r for i, r in enumerate(rules) if all(r[1:] != s[1:] for s in rules[:i])]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(('', 'x', 'y/', '?x'))}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r[0]: tuple(r[1:]) for r in U.filter_urls(pages, rules_of(spark, rules), default="none").collect()}
    assert got == {i: brute(u, rules, "none") for i, u in enumerate(urls)}


def test_repeated_and_null_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/x")] * 3 + [(None, None)] * 2, "page_id long, url string")
    rules = rules_of(spark, list(U.RULES) * 2)
    assert sorted(r.verdict for r in U.filter_urls(pages, rules).collect()) == ["allow"] * 2 + ["block"] * 3
    assert U.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.rule for r in U.filter_urls(pages, rules.limit(0)).collect()} == {None}
