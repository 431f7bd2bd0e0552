import re

from conftest import SMALL
from orrery.llm import url_rules
from orrery.llm.catalogue import QUERIES

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.COM/x?y#z", "http://a.com", "http://a.com?q=/en/", "http://example.com/en/1",
    "http://WWW.Example.com/en/", "http://notexample.com/en/1", "http://x.example.com/en", "https://a.net/es/2#f", "https://net/fr/", "http://b.org/fr/://c.com/",
    "http://ÄÖ.com/é", "http://a.b.c.d.example.com/en/" + "x/" * 4000, "x\ny://a.com/\nz",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_given_rules(spark):
    rows = [(i, u, "html", "host") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "", ""), (3, "http://", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, token string")
    out = url_rules.judge(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        url = "http://a.com/" if r.page_id is None else URLS[r.page_id]
        host, path, rule, verdict = brute(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def mined(labelled, support, confidence):
    """Token sets that imply block, by counting every subset."""
    from itertools import combinations

    both, any_ = {}, {}
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                any_[c] = any_.get(c, 0) + 1
                both[c] = both.get(c, 0) + (verdict == "block")
    total = len(labelled)
    return {c for c, n in both.items() if n and n >= support * total and n / any_[c] >= confidence}


def test_mined_rules_against_all_subsets(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    out = QUERIES["op6_url_rules"](spark, SMALL).collect()
    assert len(out) == pages.count()

    def tokens(r):
        return {w for w in re.split(r"[^\w]+|_", f"{r.host}/{r.path}".lower()) if w and not re.fullmatch("[0-9]+", w)}

    rules = mined([(tokens(r), r.verdict) for r in out if r.rule], url_rules.SUPPORT, url_rules.CONFIDENCE)
    assert rules
    for r in out:
        if not r.rule:
            fired = any(set(c) <= tokens(r) for c in rules)
            assert r.verdict == ("block" if fired else "allow")


def test_nothing_to_mine(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_rules.judge(pages).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0)).count() == 0
