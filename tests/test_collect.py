from __future__ import annotations

import json

from codestrata.plans import collect

PAGES = "repo string, page int, status int, body string"
ANSWERS = "url string, status int, body string"
WHO = {"name": "n", "email": "e", "date": "2024-01-02T03:04:05Z"}


def commit(n, **other):
    return {"sha": f"s{n}", "commit": {"message": f"m{n}", "author": WHO, "committer": WHO}, "html_url": f"h{n}", "url": f"u{n}", **other}


def pull(n, **other):
    side = {"ref": "r", "sha": "s"}
    return {
        "number": n, "title": f"t{n}", "body": None, "state": "open", "created_at": "c", "updated_at": "u", "closed_at": None, "merged_at": None,
        "user": {"login": "l", "avatar_url": "a"}, "head": side, "base": side, "html_url": "h", "diff_url": "d", "patch_url": f"p{n}", **other,
    }


def commits(spark, pages, details=(), **options):
    pages = spark.createDataFrame([(*p[:3], p[3] if isinstance(p[3], str | None) else json.dumps(p[3])) for p in pages], PAGES)
    details = spark.createDataFrame([(*d[:2], d[2] if isinstance(d[2], str | None) else json.dumps(d[2])) for d in details], ANSWERS)
    return collect.collect_commits(pages, details, **options)


def shas(found):
    return sorted((r.repo, r.sha) for r in found.collect())


def test_pages_end_where_the_listing_does(spark):
    full = lambda repo, page, a: (repo, page, 200, [commit(a), commit(a + 1)])
    found, aside = commits(spark, [
        full("short", 1, 0), ("short", 2, 200, [commit(2)]), full("short", 3, 3),
        full("failed", 1, 0), ("failed", 2, 500, [commit(2), commit(3)]), full("failed", 3, 4),
        full("torn", 1, 0), ("torn", 2, 200, "[{"), full("torn", 3, 4),
        full("object", 1, 0), ("object", 2, 200, {"message": "limit"}), full("object", 3, 4),
        full("gap", 1, 0), full("gap", 3, 4), ("late", 2, 200, [commit(1)]), ("empty", 1, 200, []), ("none", 1, 200, None), ("none", 2, None, "[]"),
        ("retried", 1, 503, "busy"), full("retried", 1, 0), ("retried", 1, 200, [commit(0)]), full("retried", 1, 0), ("retried", 2, 200, [commit(2)]),
    ], page_size=2)
    assert shas(found) == sorted(
        [("short", f"s{n}") for n in range(3)] + [(r, f"s{n}") for r in ("failed", "torn", "object", "gap") for n in range(2)] + [("retried", f"s{n}") for n in range(3)])
    assert aside.count() == 0


def test_cap_and_records_set_aside(spark):
    nobody = commit(1)
    nobody["commit"] = {"message": "m", "author": None, "committer": WHO}
    wordless = commit(2)
    wordless["commit"] = {"message": None, "author": WHO, "committer": WHO}
    found, aside = commits(spark, [("a", 1, 200, [commit(0), nobody, wordless]), ("a", 2, 200, [7, None, commit(5)]), ("a", 3, 200, [commit(6)])], page_size=3, cap=3)
    assert shas(found) == [("a", "s0"), ("a", "s2"), ("a", "s5")]
    assert {r.sha: r.message for r in found.collect()}["s2"] is None
    values = [json.loads(r.value) for r in aside.collect()]
    assert len(values) == 3 and nobody in values and 7 in values and None in values


def test_diffs_of_details(spark):
    file = lambda name, patch: {"filename": name, "patch": patch}
    found, _ = commits(spark, [("a", 1, 200, [commit(n) for n in range(7)] + [commit(7, url=None), commit(8, url=""), {k: v for k, v in commit(9).items() if k != "url"}])], [
        ("u0", 200, {"files": [file("x", "+1"), file("y", ""), {"filename": "z"}, file("w", "-2")]}),
        ("u1", 404, {"files": [file("x", "+1")]}), ("u2", 200, "oops"), ("u3", 200, {"files": [file("x", "+1"), {"patch": "+2"}]}), ("u4", 200, {}),
        ("u5", 500, "busy"), ("u5", 200, {"files": [file("x", "+5")]}), ("u5", 200, {"files": [file("x", "+5")]}),
        (None, 200, {"files": [file("x", "no")]}), ("", 200, {"files": [file("x", "no")]}), ("elsewhere", 200, {"files": [file("x", "no")]}),
    ])
    got = {r.sha: r.code_diff for r in found.collect()}
    assert got == {**{f"s{n}": "" for n in range(10)}, "s0": "--- x\n+1\n--- w\n-2", "s5": "--- x\n+5"}
    assert [r.author.name for r in found.collect()] == ["n"] * 10


def test_pull_requests(spark):
    records = [pull(1, body="b"), pull(2), pull(3, patch_url=None), pull(4, patch_url=""), pull(5, user=None), {k: v for k, v in pull(6).items() if k != "merged_at"}]
    pages = spark.createDataFrame([("a", 1, 200, json.dumps(records))], PAGES)
    patches = spark.createDataFrame([("p1", 200, "diff 1"), ("p2", 301, "moved"), (None, 200, "x"), ("", 200, "y"), ("p5", 200, "z")], ANSWERS)
    found, aside = collect.collect_prs(pages, patches)
    assert {r.number: (r.body, r.code_diff, r.user.login, r.merged_at) for r in found.collect()} == {
        1: ("b", "diff 1", "l", None), 2: ("", "", "l", None), 3: ("", "", "l", None), 4: ("", "", "l", None)}
    assert sorted(json.loads(r.value)["number"] for r in aside.collect()) == [5, 6]


def test_nothing_landed(spark):
    found, aside = commits(spark, [])
    assert found.count() == aside.count() == 0


def test_records_without_an_address_are_spread(spark):
    """A third of all records may lack a URL; they must not meet in one task."""
    pages = spark.createDataFrame([("a", n, 200, json.dumps([commit(n * 100 + k, url=None) for k in range(100)])) for n in range(1, 9)], PAGES)
    found, _ = collect.collect_commits(pages, spark.createDataFrame([("u", 200, "{}")] , ANSWERS))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [len(p) for p in found.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 800 and max(sizes) < 400
