from __future__ import annotations

import json

from codestrata.operators import context
from codestrata.plans import report

REPOS = "repo string, description string, language string, stars bigint, forks bigint"


def inputs(spark):
    repos = spark.createDataFrame([("o/a", "Tools", "python", 3, 1), ("o/b", None, None, 0, 0)], REPOS)
    commits = spark.sql("""select 'o/a' as repo, concat('sha', id) as commit_sha, if(id = 6, null, concat('n', id)) as author_name, 'e' as author_email,
        concat('message ', id, repeat('x', 90)) as message, timestamp_seconds(id) as committed_at from range(7)""")
    prs = spark.sql("""select 'o/a' as repo, id as number, concat('title ', id) as title, 'open' as state, 'u' as user_login,
        timestamp_seconds(id * 60) as created_at from range(1, 3)""")
    files = spark.createDataFrame([("o/a", 1, "b.py"), ("o/a", 2, "a.py"), ("o/a", 3, "z.py")], "repo string, file_id bigint, current_path string")
    symbols = spark.createDataFrame([
        ("o/a", 1, "h", "function", "f", 1, 2), ("o/a", 1, "h", "function", "g", 3, 4), ("o/a", 2, "h", "class", "C", 1, 9),
    ], "repo string, file_id bigint, commit_sha string, kind string, name string, start_line int, end_line int")
    return repos, commits, prs, files, symbols


def test_repository_context(spark):
    got = {r.repo: r.context for r in report.repo_contexts(report.repo_reports(*inputs(spark))).collect()}
    cut = lambda n: f"message {n}{'x' * 71}"
    assert got["o/a"] == "\n".join([
        "Repository: o/a", "Description: Tools", "", "Codebase Statistics:", "- Files: 3", "- Functions: 2", "- Classes: 1", "- Commits: 7", "- Pull Requests: 2",
        "", "Code Structure:", "", "a.py:", "  Classes: C", "", "b.py:", "  Functions: f, g",
        "", "Recent Commits:", f"- {cut(6)} (by None)", *(f"- {cut(n)} (by n{n})" for n in (5, 4, 3, 2)),
        "", "Recent Pull Requests:", "- PR #2: title 2 (open)", "- PR #1: title 1 (open)",
    ])
    assert got["o/b"] == "\n".join(["Repository: o/b", "", "Codebase Statistics:", "- Files: 0", "- Functions: 0", "- Classes: 0", "- Commits: 0", "- Pull Requests: 0"])


def test_reports(spark):
    reports = report.repo_reports(*inputs(spark))
    got = {r.repo: json.loads(r.report) for r in report.as_json(reports).collect()}
    a, b = got["o/a"], got["o/b"]
    assert a["stats"] == {"commits_count": 7, "prs_count": 2, "functions_count": 2, "classes_count": 1, "files_count": 3}
    assert [c["sha"] for c in a["commits"]] == [f"sha{n}" for n in range(6, -1, -1)]
    assert [s["name"] for s in a["symbols"]] == ["C", "f", "g"]
    assert a["file_stats"] == [{"file": "b.py", "functions": 2, "classes": 0}, {"file": "a.py", "functions": 0, "classes": 1}, {"file": "z.py", "functions": 0, "classes": 0}]
    assert a["details"] == {"description": "Tools", "language": "python", "stars": 3, "forks": 1}
    assert b["commits"] == b["prs"] == b["symbols"] == b["file_stats"] == []


def test_report_without_checkout(spark):
    repos, *rest = inputs(spark)
    reports = report.repo_reports(repos, *rest)
    got = {r.repo: r for r in report.degraded(reports, repos.filter("repo = 'o/b'")).collect()}
    a = got["o/a"]
    assert a.symbols == [] and a.file_stats == [] and len(a.commits) == 7 and len(a.prs) == 2
    assert (a.stats.commits_count, a.stats.functions_count, a.stats.files_count) == (7, 0, 0)
    assert a.warning and got["o/b"].warning is None


def test_fallback_and_templates(spark):
    df = spark.createDataFrame([("",), (None,), ("text",)], "c string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(context.or_fallback(F.col("c"))).collect()] == [context.NO_CONTEXT, context.NO_CONTEXT, "text"]
    prompt = df.filter("c = 'text'").select(context.service_prompt(F.lit("o/r"), F.col("c"), F.lit("why?"))).first()[0]
    assert prompt.index("o/r") < prompt.index("text") < prompt.index("why?")


def test_one_pass_over_every_input(spark, tmp_path):
    """Commits, pull requests and repositories are read once; one ranking and one aggregate serve all lists."""
    names = ("repos", "commits", "prs", "files", "symbols")
    stored = []
    for name, df in zip(names, inputs(spark), strict=True):
        df.write.parquet(str(tmp_path / name))
        stored.append(spark.read.parquet(str(tmp_path / name)))
    reports = report.repo_reports(*stored)
    plan = reports._jdf.queryExecution().executedPlan().toString()
    scans = [line.split("[", 1)[1].split("]")[0] for line in plan.split("\n") if "FileScan" in line]
    assert {c: sum(c in scan for scan in scans) for c in ("description", "committed_at", "created_at", "start_line")} == {
        "description": 1, "committed_at": 1, "created_at": 1, "start_line": 1}
    assert plan.count("Exchange hashpartitioning") <= 5
    contexts = report.repo_contexts(reports)._jdf.queryExecution().executedPlan().toString()
    assert contexts.count("Exchange") == plan.count("Exchange")


def test_context_limits_and_unknown_files(spark):
    repos, commits, prs, files, symbols = inputs(spark)
    many = spark.sql("""select 'o/a' as repo, 10 + id div 12 as file_id, 'h' as commit_sha, if(id % 2 = 0, 'function', 'class') as kind, concat('n', id) as name,
        cast(id as int) as start_line, cast(id as int) as end_line from range(240)""")
    paths = spark.sql("select 'o/a' as repo, 10 + id as file_id, concat('p', 100 + id) as current_path from range(20)")
    lost = spark.createDataFrame([("o/b", 99, "h", "function", "lost", 1, 2)], symbols.schema)
    reports = report.repo_reports(repos, commits, prs, paths, many.unionByName(lost))
    got = {r.repo: r for r in reports.collect()}
    assert len(got["o/a"].symbols) == 200 and got["o/a"].stats.functions_count == 120 and got["o/a"].stats.files_count == 20
    assert (got["o/b"].symbols, got["o/b"].file_stats, got["o/b"].stats.functions_count, got["o/b"].stats.files_count) == ([], [], 1, 0)
    text = {r.repo: r.context for r in report.repo_contexts(reports).collect()}["o/a"]
    # 100 symbols lie in nine files, twelve each, and the last holds four of them.
    assert [line for line in text.split("\n") if line.startswith("p1")] == [f"p{100 + n}:" for n in range(9)]
    assert "  Functions: n96, n98\n  Classes: n97, n99" in text and "n100" not in text
