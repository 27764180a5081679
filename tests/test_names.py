from __future__ import annotations

import random
import sqlite3

from codestrata.operators import lookups, names

SYMBOLS = "repo string, file_id bigint, commit_sha string, kind string, name string, start_line int, end_line int"


def test_agrees_with_sqlite_for_many_patterns(spark):
    rng = random.Random(4)
    words = ["load", "Load", "LOADER", "save_all", "x", "xy", "naïve", "NAÏVE", "a%b", "back\\slash", "k_1", "k1", ""]
    rows = [("r", n % 7, "c", "function", rng.choice(words) + rng.choice(["", "_", "9", "Tree"]) + rng.choice(words), n, n + 1) for n in range(400)]
    rows += [("r", 1, "c", "class", None, 5, 6)] + [("r", 2, "c", "function", "hot_name", 1, 2)] * 200
    patterns = ["load", "OAD%T", "a_l", "_", "%", "x", "hot", "ï", "Ïve", "\\s", "k_1", "zzz", "", "ad_%sav", "load"]
    symbols = spark.createDataFrame(rows, SYMBOLS).repartition(4)
    files = spark.createDataFrame([("r", n, f"f{n}.py") for n in range(6)], "repo string, file_id bigint, current_path string")
    con = sqlite3.connect(":memory:")
    con.execute("create table s (file_id int, name text, start_line int)")
    con.executemany("insert into s values (?, ?, ?)", [(r[1], r[4], r[5]) for r in rows])
    want = sorted((p, f"f{f}.py", n, a) for p in set(patterns) for f, n, a in con.execute("select file_id, name, start_line from s where file_id < 6 and name like '%' || ? || '%'", (p,)))
    index = names.name_index(symbols)
    for given in (index, None):
        got = names.search_symbols(symbols, files, patterns, given).collect()
        assert sorted((r.pattern, r.current_path, r.name, r.start_line) for r in got) == want
    assert [r.pattern for r in got] == sorted(r.pattern for r in got)
    one = lookups.symbol_search(symbols, files, "OAD%T").count()
    assert one == sum(p == "OAD%T" for p, *_ in want)
    assert index.names.count() == len({r[4] for r in rows if r[4] is not None})
    assert names.search_symbols(symbols, files, []).count() == 0 and names.search_symbols(symbols.limit(0), files, ["a", "abc"]).count() == 0


def test_wildcards_split_the_pattern():
    assert names.pattern_grams("OADer%T_abcd") == {"oad", "ade", "der", "abc", "bcd"} and names.pattern_grams("a_b%") == set()


def test_one_scan_for_all_patterns(spark, tmp_path):
    spark.createDataFrame([("r", 1, "c", "function", "load", 1, 2)], SYMBOLS).write.parquet(str(tmp_path / "s"))
    symbols = spark.read.parquet(str(tmp_path / "s"))
    files = spark.createDataFrame([("r", 1, "f")], "repo string, file_id bigint, current_path string")
    plan = names.search_symbols(symbols, files, ["load", "x", "oad"], names.name_index(symbols))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("file_id") and plan.count("Relation [repo") == 1
