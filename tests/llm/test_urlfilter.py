import itertools
import re

from facetry.llm import urlfilter as uf


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def listed(host, path):
    fits = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


URLS = [
    "https://www.example.com/en/1", "http://a.example.com/en/x?u=1", "http://EXAMPLE.com/en/", "http://example.com/en", "http://com/", "http://com", "http://xcom/",
    "http://a.net/es/", "http://net/fr/#f", "http://a.net/de/?q", "http://b.org", "", None, "no scheme", "x://y://z.com/en/", "http://É.com/", "http://a.net?/es/", "http:///en/",
]


def test_list(spark):
    df = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, verdict boolean")
    got = {r.page_id: r for r in uf.judge(df).collect()}
    assert len(got) == len(URLS) + 1
    for i, url in enumerate([*URLS, URLS[0]]):
        host, path = split(url)
        rule, verdict = listed(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        if rule:
            assert got[i].verdict == verdict
        else:
            assert got[i].verdict == ("block" if got[i].fired else "allow")


def test_rules_by_brute_force(spark):
    rows = [(["a", "b"], True)] * 6 + [(["a"], False)] * 6 + [(["b", "c"], False)] * 4 + [(["c", "d"], True)] * 5 + [(["c", "d", "e"], True)] * 3 + [([], True)]
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    got = {tuple(r.tokens): round(r.confidence, 9) for r in uf.mine(df, min_support=0.05, min_confidence=0.7, min_lift=1.0).collect()}
    full = [r for r in rows if r[0]]
    sure = {}
    for n in (1, 2, 3):
        for combo in itertools.combinations("abcde", n):
            met = [b for t, b in full if set(combo) <= set(t)]
            if met and sum(met) / len(full) >= 0.05 and sum(met) / len(met) >= 0.7:
                sure[combo] = sum(met) / len(met)
    kept = {c: round(v, 9) for c, v in sure.items() if not any(set(o) < set(c) and w >= v for o, w in sure.items())}
    assert got == kept == {("d",): 1.0, ("e",): 1.0, ("a", "b"): 1.0}
    urls = spark.createDataFrame([(1, ["a", "b", "z"]), (2, ["a"]), (3, ["d", "c"]), (4, [])], "k long, tokens array<string>")
    assert {r.k: r.fired for r in uf.match(urls, uf.mine(df, min_support=0.05, min_confidence=0.7, min_lift=1.0), "k").collect()} == {1: ["a", "b"], 3: ["d"]}


def test_nothing(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_long_baskets_are_mined_whole(spark):
    """The pair (x, y) is the surest rule, its tokens the least sure of the ten of a url; forty tokens that go together give no powers of two."""
    stem = [f"s{i}" for i in range(8)]
    rows = [([*stem, "x", "y"], True)] * 20 + [([s], False) for s in stem] * 6 + [(stem, False)] * 6 + [(["x", "s0", "s1"], False), (["y", "s2"], False)] * 15
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    got = {tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9)) for r in uf.mine(df, 0.05, 0.6, 1.2).collect()}
    full = {}
    for size in range(1, 11):
        for combo in itertools.combinations([*stem, "x", "y"], size):
            met = [b for t, b in rows if set(combo) <= set(t)]
            if sum(met) >= 0.05 * len(rows) and sum(met) / len(met) >= max(0.6, 1.2 * 20 / len(rows)):
                full[combo] = (sum(met) / len(met), sum(met) / len(rows))
    kept = {c: v for c, v in full.items() if not any(set(o) < set(c) and w[0] >= v[0] for o, w in full.items())}
    assert got == {c: (round(v[0], 9), round(v[1], 9)) for c, v in kept.items()}
    assert ("x", "y") in got
    deep = [f"d{i:02}" for i in range(40)]
    rows = [(deep, True)] * 20 + [([*deep[:39], "e"], False)] * 5 + [(["e"], False)] * 60
    got = {tuple(r.tokens): round(r.confidence, 9) for r in uf.mine(spark.createDataFrame(rows, df.schema), 0.05, 0.6, 1.2).collect()}
    assert got == {**{(d,): 0.8 for d in deep[:39]}, ("d39",): 1.0}
