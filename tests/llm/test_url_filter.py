"""URL rules and host scores against brute force, on awkward rows and a small link graph."""

import random
import re

import pytest

from dialogweave.llm import queries
from dialogweave.llm.url_filter import LINK, filter_urls, host_edges, propagated

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, verdict string, _row int"
RULES = [(v, r) for v, r in queries.URL_RULES]


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def _rule(host, path, rules):
    fits = []
    for verdict, rule in rules:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def _walk(seeds, edges, damping, steps):
    out = {}
    for (a, b), n in edges.items():
        out.setdefault(a, []).append((b, n))
    front, score = {s: 1 - damping for s in seeds}, {}
    for _ in range(steps + 1):
        for host, m in front.items():
            score[host] = score.get(host, 0) + m
        after = {}
        for host, m in front.items():
            total = sum(n for _, n in out.get(host, []))
            for to, n in out.get(host, []):
                after[to] = after.get(to, 0) + m * damping * n / total
        front = after
    return score


def _brute(rows, rules, share=0.5, damping=0.85, steps=20):
    judged, edges = [], {}
    for page, url, html, *_ in rows:
        host, path = _split(url)
        judged.append((page, host, path, *_rule(host, path, rules)))
        for to in re.findall(LINK, html or ""):
            to = re.sub("[A-Z]", lambda m: m[0].lower(), to)
            if host and to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    seeds = {"allow": [], "block": []}
    for h in {j[1] for j in judged} - {""}:
        of = [j[4] for j in judged if j[1] == h]
        for v in seeds:
            if of.count(v) > share * len(of):
                seeds[v].append(h)
    trust = _walk(seeds["allow"], edges, damping, steps)
    distrust = _walk(seeds["block"], {(b, a): n for (a, b), n in edges.items()}, damping, steps)
    return sorted(
        ((p, h, path, r, v or ("block" if distrust.get(h, 0) > trust.get(h, 0) * (1 + 1e-9) else "allow")) for p, h, path, r, v in judged),
        key=str,
    )


def _page(n, url, links=()):
    html = None if links is None else "".join(f'<a href="http://{h}/x?y">t</a>' for h in links) + "<p>plain //not.a.link</p>"
    return (n, url, html, "c", "c", "c", "c", 1)


ROWS = [
    _page(1, "http://good.com/a"), _page(2, "HTTP://WWW.Example.com/en/1?x#y"), _page(3, "https://example.com/en/2"),
    _page(4, "ftp://m.example.com/en"), _page(5, "http://spam.net/es/1", ["spam.net", "hub.org"]), _page(6, "http://spam.net/fr/"),
    _page(7, "http://friend.org/x", ["spam.net", "SPAM.net", "friend.org"]), _page(8, "http://far.org/", ["friend.org"]),
    _page(9, "http://good.com/", ["fine.org", "friend.org"]), _page(10, "http://fine.org/p"), _page(11, "no scheme/x"),
    _page(None, None, None), _page(12, ""), _page(12, "http://com/"), _page(12, "http://com"), _page(13, "x://a?b://net/es/"),
    _page(14, "http://net/es/?q"), _page(15, "http://notnet/es/"), _page(16, "http://a.b.net:80/es/"), _page(17, "http:///en/"),
    _page(18, "http://É.com/ü\n/z?"), _page(19, "http://" + "a." * 300 + "net/fr/" + "p" * 10_000), _page(None, "http://spam.net/de/1"),
    _page(20, "http://friend.org/x", ["spam.net"]), _page(20, "http://friend.org/x", ["spam.net"]), _page(21, "http://hub.org/", None),
]


def _got(df):
    assert df.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rules_and_scores(spark):
    want = _brute(ROWS, RULES)
    assert _got(filter_urls(spark.createDataFrame(ROWS, SCHEMA), RULES)) == want
    by_method = {w[1]: w[4] for w in want if w[3] is None}
    assert by_method["friend.org"] == "block" and by_method["fine.org"] == "allow" and by_method["hub.org"] == "allow"


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert {r[4] for r in _got(filter_urls(pages, []))} == {"allow"}
    assert _got(filter_urls(pages.limit(0), RULES)) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph(spark, seed):
    r = random.Random(seed)
    hosts = [f"h{i}.{r.choice(['com', 'net', 'org'])}" for i in range(30)]
    rows = []
    for i in range(300):
        host = hosts[0] if i % 3 == 0 else r.choice(hosts)
        path = r.choice(["/es/", "/fr/", "/de/", "/en/"])
        rows.append(_page(i, f"http://{host}{path}{i}", [r.choice(hosts) for _ in range(r.randint(0, 4))]))
    rules = [("allow", "com/de/"), ("block", "net/"), ("allow", "net/en/"), ("block", "h3.com/")]
    assert _got(filter_urls(spark.createDataFrame(rows, SCHEMA), rules)) == _brute(rows, rules)


def test_scores(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "a", 2)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, mass double")
    got = {r.host: r.score for r in propagated(seeds, edges, 0.5, 3).collect()}
    want = _walk(["a"], {("a", "b"): 3, ("a", "c"): 1, ("b", "a"): 2}, 0.5, 3)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-12 for h in got)


def test_links_within_a_host_are_no_edges(spark):
    pages = spark.createDataFrame([("a.com", '<a href=//a.com/x><img SRC="https://B.com"><a href="/c.com">')], "host string, html string")
    assert [tuple(r) for r in host_edges(pages).collect()] == [("a.com", "b.com", 1)]
