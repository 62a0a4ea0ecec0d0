import random
import time

import pytest

from slateql.llm.urlfilter import Rule, UrlTrie, filter_urls

RULES = [Rule.parse(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "bad.net"), ("allow", "bad.net/ok"), ("block", "/ads/"))]


def brute(rules, host, path):
    labels = host.split(".")
    fits = [r for r in rules if (not r.host or host and labels[-len(r.host.split(".")) :] == r.host.split(".")) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host.split(".")) if r.host else 0, len(r.path), r.verdict == "allow"), default=None)
    return (best.name, best.verdict) if best else None


def test_trie_against_brute_force():
    rng = random.Random(1)
    trie = UrlTrie(RULES)
    for _ in range(5000):
        host = ".".join(rng.choice(["a", "example", "bad", "xexample"]) for _ in range(rng.randrange(3))) + rng.choice([".org", "org", ".com", ".net", ""])
        path = "".join(rng.choice(["/", "es", "en", "1", "12", "fr", "de", "ok", "/es/", "/en/", "/ads/"]) for _ in range(rng.randrange(5)))
        assert trie.match(host, path) == brute(RULES, host, path), (host, path)


def rows(spark, urls, **options):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    return sorted(tuple(r) for r in filter_urls(df, RULES, keep=["page_id"], **options).collect())


URLS = [
    None, "", "no scheme", "http://", "HTTP://Www.EXAMPLE.org/es/1?x#y", "http://example.org/en/12", "http://example.org", "http://a.b.com/fr/x", "https://com/de/",
    "ftp://x.bad.net?q", "http://bad.net/okay", "http://notbad.net/", "a://b://c/d", "http://É.ORG/É", "http://example.org/es", "http://example.org/es/1", "http://example.org/es/1", "x" * 50_000 + "://org/",
    "http://any.where/ads/x", "http:///ads/", "http://example.org/ads/", "http://bad.net/ads/",
]


def test_hosts_paths_and_verdicts(spark):
    found = rows(spark, URLS)
    assert [r[0] for r in found] == list(range(len(URLS)))
    assert found[0][1:] == ("", "", None, "allow") == found[1][1:] == found[2][1:] == found[3][1:]
    assert found[4][1:] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert found[5][1:] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[6][1:] == ("example.org", "", None, "allow")
    assert found[9][1:] == ("x.bad.net", "", "bad.net", "block")
    assert found[10][1:] == ("bad.net", "/okay", "bad.net/ok", "allow")
    assert found[12][1:3] == ("b:", "//c/d")
    assert found[13][1:] == ("É.org", "/É", "org/", "allow")


def test_both_ways_agree(spark):
    assert rows(spark, URLS) == rows(spark, URLS, max_broadcast_rules=0)
    assert rows(spark, []) == []


def test_bad_rules():
    for verdict, entry in (("maybe", "org/"), ("block", "")):
        with pytest.raises(ValueError):
            Rule.parse(verdict, entry)


def test_many_rules_of_one_host():
    rng = random.Random(2)
    rules = [Rule.parse("block", "one.example/" + "/".join(rng.choice("abcd") * rng.randrange(1, 4) + str(rng.randrange(1000)) for _ in range(rng.randrange(1, 3)))) for _ in range(100_000)]
    rules += [Rule.parse("allow", "one.example/" + "a" * k) for k in range(50)]
    trie = UrlTrie(rules)
    paths = ["/" + "/".join(rng.choice("abcd") * rng.randrange(1, 4) + str(rng.randrange(10_000)) for _ in range(rng.randrange(1, 4))) for _ in range(20_000)]
    began = time.perf_counter()
    found = [trie.match("one.example", p) for p in paths]
    assert (time.perf_counter() - began) / len(paths) < 20e-6
    by_path = {r.path: r.name for r in rules}
    for p, f in list(zip(paths, found))[:2000]:
        longest = next((p[:n] for n in range(len(p), 0, -1) if p[:n] in by_path), None)
        assert (f and f[0]) == by_path.get(longest)


def test_clashing_names_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "h", 5)], "page_id long, url string, host string, Rule int")
    found = filter_urls(df, RULES, keep=["page_id", "host", "Rule"])
    assert found.columns == ["page_id", "input_host", "input_Rule", "host", "path", "rule", "verdict"]
    assert found.first()[1:] == ("h", 5, "a.org", "/x", "org/", "allow")
    assert filter_urls(df, [], keep=["page_id"]).first()[1:] == ("a.org", "/x", None, "allow")
