"""URL rules and the ratio of character models against brute force."""

import math
import random
import re
import time
import zlib
from collections import Counter

from lethe.llm import url_filter as U


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best


def brute(pages):
    k = U.ORDER
    lower = lambda u: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"(?s)^.*?://", "", u, count=1))
    told = {(u or ""): brute_rule(u)[2] for _, u in pages}
    count = {"allow": Counter(), "block": Counter()}
    held = lambda u: zlib.crc32(u.encode()) % U.HELD == 0
    grams = lambda u: [("\x02" * k + lower(u) + "\x03")[i:i + k + 1] for i in range(len(lower(u)) + 1)]
    for u, r in told.items():
        if r and not held(u):
            for g in grams(u):
                for n in range(k + 1):
                    count[r.verdict][g[k - n:]] += 1
    context = {v: Counter() for v in count}
    for v, c in count.items():
        for g, n in c.items():
            context[v][g[:-1], len(g)] += n

    def p(v, g):
        out = 1 / U.CHARACTERS
        for n in range(k + 1):
            s = g[k - n:]
            out = (count[v][s] + U.SMOOTH * out) / (context[v][s[:-1], len(s)] + U.SMOOTH)
        return out

    score = lambda u: sum(math.log(p("allow", g) / p("block", g)) for g in grams(u)) / len(grams(u))
    bins = Counter()
    for u, r in told.items():
        if r and held(u):
            bins[round(score(u), 2), r.verdict] += 1
    cut = U.best_cut([(s, bins[s, "allow"], bins[s, "block"]) for s in {s for s, _ in bins}])
    return {u: (r.verdict if r else "allow" if score(u) >= cut else "block", r.name if r else None,
                None if r else score(u)) for u, r in told.items()}, cut


def pages(n=400, seed=1):
    r = random.Random(seed)
    rows = [(None, None), (1, ""), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/a?x#y"), (4, "x://com/"), (5, "x://com"),
            (6, "x://notcom/"), (7, "http://a.net?u=http://b.com/"), (8, "http://a.net#/es/"), (9, "a://b://net/fr/"),
            (10, "http://é.net/fr/é\n"), (11, "http://a.net/fr"), (12, "http:///path/"), (12, "http:///path/")]
    for i in range(20, n):
        host = r.choice(["", "www.", "blog."]) + r.choice(["example", "spam", "shop"]) + r.choice([".com", ".net", ".org"])
        rows.append((i, f"https://{host}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.randrange(50)}{r.choice(['', '?a=1', '.html'])}"))
    return rows


def test_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, score string")
    got = U.judge_urls(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    want, cut = brute(rows)
    out = got.collect()
    assert len(out) == len(rows)
    by_id = {}
    for i, u in rows:
        by_id.setdefault(i, u)
    for r in out:
        u = by_id[r.page_id] or ""
        host, path, rule = brute_rule(u)
        verdict, name, score = want[u]
        assert (r.host, r.path, r.rule) == (host, path, name), u
        assert (r.score is None) == (score is None) and (score is None or abs(r.score - score) < 1e-9), u
        if score is None or abs(score - cut) > 1e-6:
            assert r.verdict == verdict, u


def test_cut():
    assert U.best_cut([]) == 0 and U.best_cut([(1.0, 3, 0)]) == 0
    assert U.best_cut([(-1.0, 0, 5), (-0.5, 1, 5), (0.5, 5, 1), (1.0, 5, 0)]) == 0.5


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(df).collect() == []
    plan = U.judge_urls(spark.createDataFrame(pages(60), "page_id long, url string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_very_long_url(spark):
    """A URL of a million characters, wide ones among them, takes seconds and changes no other verdict."""
    rows = pages(120)
    long = "http://long.org/" + "aé𝒳/b-c" * 150_000
    start = time.time()
    out = {r.page_id: r for r in U.judge_urls(spark.createDataFrame(rows + [(1000, long)], "page_id long, url string")).collect()}
    assert time.time() - start < 60
    assert out[1000].path == long[len("http://long.org"):] and out[1000].score is not None
    want, _ = brute(rows + [(1000, "http://long.org/" + "aé𝒳/b-c" * 40)])
    assert all(out[i].verdict == want[u or ""][0] for i, u in rows if want[u or ""][1])
