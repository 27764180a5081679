from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.llm import url_filter

URLS = [None, "", "foo", "HTTP://WWW.Example.COM/en/x?y", "a://x.net/fr/é", "a://com", "http://b.com?x=/en/", "http://example.com/en/", "http://xexample.com/en/1", "s://q#f/en",
        "http://m.example.com/en/2#a", "http://notnet/es/", "http://n.net/es", "http://n.net/es/", "http://a://b.com/x", "://com/", "http://ÉX.com/É?"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[at:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), tail[:end]


def rule(host, path):
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_parts_and_rules(spark):
    rows = url_filter.judged(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 as host", "2 as score")).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r.host, r.path) == split(URLS[r.page_id])
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain(urls):
    """Counts of all contexts of 0 to 5 symbols, and the interpolated log-likelihood of a URL under them."""
    table = url_filter.SYMBOL
    coded = lambda u: [0] * 5 + [int(table[b]) for b in (u or "").encode()] + [1]
    seen = defaultdict(Counter)
    for u in urls:
        s = coded(u)
        for i in range(5, len(s)):
            for k in range(6):
                seen[tuple(s[i - k : i])][s[i]] += 1

    def score(u, least):
        s, total = coded(u), 0.0
        for i in range(5, len(s)):
            p = 1 / 64
            for k in range(6):
                c = seen.get(tuple(s[i - k : i]))
                if c and sum(c.values()) >= least:
                    p = (c[s[i]] + len(c) * p) / (sum(c.values()) + len(c))
            total += math.log(p)
        return total / (len(s) - 5)
    return score


def test_scores_agree_with_plain_counts(spark):
    good = [f"http://site{i % 7}.com/en/{i}" for i in range(60)] + ["http://é.com/x"] * 3
    bad = [f"http://spam.net/fr/{i * 7 % 90}?q" for i in range(50)] + ["", None]
    df = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean").repartition(3)
    score = url_filter.trained(df)
    accepted, rejected = plain(good), plain(bad)
    probes = ["http://site3.com/en/5", "http://spam.net/fr/1", "", None, "x" * 3000, "ü://Q"]
    got = {r.url: r.s for r in spark.createDataFrame([(u,) for u in probes], "url string").select("url", score("url").alias("s")).collect()}
    for u in probes:
        assert got[u] == pytest.approx(accepted(u, 2) - rejected(u, 2), abs=1e-9)
    assert url_filter.trained(df.where("accepted")) is None


def test_threshold_balances_both_kinds(spark):
    rows = [(x / 10, True) for x in range(5, 30)] + [(x / 10, False) for x in range(-30, 2)] + [(0.9, False)]
    assert 0.1 < url_filter.calibrated(spark.createDataFrame(rows, "score double, accepted boolean")) <= 0.5
    assert url_filter.calibrated(spark.createDataFrame([(0.3, True)], "score double, accepted boolean")) == 0.0


def test_held_out_urls_are_judged_as_the_rules_do(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    known = pages.select("url", url_filter.listed(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("hit")).where("hit is not null").select(
        "url", (F.col("hit.verdict") == "allow").alias("accepted"), (F.crc32("url") % 5 == 0).alias("out"))
    score = url_filter.trained(known.where("not out"))
    threshold = url_filter.calibrated(known.where("out").select(score("url").alias("score"), "accepted"))
    right = known.where("out").select(F.avg(((score("url") >= threshold) == F.col("accepted")).cast("int"))).first()[0]
    assert right > 0.9


def test_contexts_of_a_slice():
    whole = pa.array(["ab", "c", None, "dé"])
    a, b = url_filter.contexts(whole.slice(1, 2)), url_filter.contexts(pa.array(["c", None], pa.string()))
    assert a[0].tolist() == b[0].tolist() and np.array_equal(a[1][3], b[1][3]) and a[2].tolist() == [2, 1]


def test_every_repeated_context_counts(spark):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12)) for _ in range(3000)]
    good = [f"http://{n}.com/{i}" for n in names for i in range(2)]
    bad = [f"http://spam.net/fr/{i * 7 % 90}?q" for i in range(50)] + ["", None]
    rows = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean").repartition(3)
    accepted, rejected = plain(good), plain(bad)
    probes = [*good[::500], f"http://{names[-1]}.org/", "http://spam.net/fr/1", "", "x" * 3000, "ü://Q"]
    asked = spark.createDataFrame([(u,) for u in [*probes, None, probes[0]]], "url string")
    counts = url_filter.counted(rows)
    got = url_filter.scored(asked, counts).collect()
    assert sorted(r.url for r in got) == sorted(probes)
    score = url_filter.trained(rows)
    whole = {r.url: r.s for r in asked.select("url", score("url").alias("s")).collect()}
    for r in got:
        want = accepted(r.url, 2) - rejected(r.url, 2)
        assert r.score == pytest.approx(want, abs=1e-9) and whole[r.url] == pytest.approx(want, abs=1e-9)
    assert url_filter.counted(rows.where("accepted")) is None
