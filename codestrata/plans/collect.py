"""Commit and pull-request documents from landed responses: pages joined with what they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import records
from codestrata.operators.ranking import top_n
from codestrata.session import broadcast_if_small, stage
from codestrata.sources.landed import stop_pages

_ANSWER = ["repo", "page", "_answer"]


def _answered() -> Column:
    """The body of a response that did not fail."""
    return F.when(F.col("status").between(200, 399), F.col("body"))


def page_records(pages: DataFrame, paths: dict[str, str], types: dict[str, str], page_size: int, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of responses (repo, page, status, body) that each hold a JSON array, in pages from 1 on.

    A repository's pages count up to its first short one, or up to one that is empty, failed, no JSON array or
    not landed. Of several answers for one page the one with most records counts, whole. A record lacking one of
    `paths` is set aside as (repo, page, value); of the others the first `cap` of a repository are kept.

    Bodies are parsed once; which pages count is decided on one narrow row a page.
    """
    v, complete = F.col("_v"), F.col("_complete")
    elements = F.try_variant_get(F.try_parse_json(_answered()), "$", "array<variant>")
    answers = pages.select("repo", "page", F.monotonically_increasing_id().alias("_answer"), F.md5("body").alias("_digest"), elements.alias("_all"))
    single = answers.select(*_ANSWER, "_digest", F.posexplode("_all").alias("place", "_v"))
    flat = [records.leaf(v, path, types.get(name, "string")).alias(name) for name, path in paths.items()]
    whole = F.coalesce(records.all_present(v, {n: p for n, p in paths.items() if n not in records.OPTIONAL}), F.lit(False))
    every = stage(single.select(*_ANSWER, "_digest", "place", whole.alias("_complete"), F.when(~whole, F.to_json(v)).alias("value"), *flat), "page_records")

    sizes = every.groupBy(*_ANSWER).agg(F.count("*").alias("n"), F.first("_digest").alias("_digest"))
    best = sizes.groupBy("repo", "page").agg(F.max(F.struct("n", "_digest", "_answer")).alias("_best"))
    chosen = stage(best.select("repo", "page", "_best.n", "_best._answer"), "pages")
    stops = broadcast_if_small(stop_pages(chosen, page_size, "repo", "page", 1))
    walked = chosen.join(stops, "repo").filter((F.col("page") <= F.col("_stop")) & (F.col("page") >= 1)).select(*_ANSWER)
    found = every.join(broadcast_if_small(stage(walked, "walked")), _ANSWER)

    kept = found.filter(complete).select("repo", "page", "place", *paths)
    if cap is not None:
        kept = top_n(kept, ["repo"], [F.asc("page"), F.asc("place")], cap).drop("rank")
    return kept, found.filter(~complete).select("repo", "page", "value")


def _with_diffs(kept: DataFrame, link: str, diffs: DataFrame) -> DataFrame:
    """`code_diff` of each record by the URL in `link`; '' where there is none.

    Of several answers for one URL the greatest text counts, so any diff goes before none. Records without a
    URL get a key of their own: they meet nothing and lie in no common task.
    """
    nowhere = F.coalesce(link, F.lit("")) == ""
    alone = F.concat(F.lit("\0"), F.coalesce("repo", F.lit("")), F.lit("\0"), F.col("page").cast("string"), F.lit("\0"), F.col("place").cast("string"))
    one = diffs.filter("url <> ''").groupBy(F.col("url").alias("_url")).agg(F.max("code_diff").alias("code_diff"))
    keyed = kept.withColumn("_url", F.when(nowhere, alone).otherwise(F.col(link)))
    return keyed.join(one, "_url", "left").withColumn("code_diff", F.coalesce("code_diff", F.lit("")))


def collect_commits(pages: DataFrame, details: DataFrame, page_size: int = 100, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(commit documents, quarantine) from listing pages and detail responses (url, status, body).

    The diff joins the patches of a detail's files; it is '' where the detail failed, is no JSON object, or holds
    a patch of no named file. Beside the document's columns come `repo`, `page` and `place` on the page.
    """
    kept, quarantine = page_records(pages, records.COMMIT_RECORD, {}, page_size, cap)
    parsed = F.from_json(_answered(), "files array<struct<filename string, patch string>>", {"maxStringLen": str(2**31 - 1)})
    files = parsed["files"]
    unnamed = F.exists(files, lambda f: f["filename"].isNull() & (F.coalesce(f["patch"], F.lit("")) != ""))
    diff = F.when(F.coalesce(unnamed, F.lit(False)), F.lit("")).otherwise(records.commit_diff(files))
    documents = _with_diffs(kept, "api_url", details.select("url", diff.alias("code_diff")))
    people = [F.struct(*(F.col(f"{who}_{part}").alias(part) for part in ("name", "email", "date"))).alias(who) for who in ("author", "committer")]
    return documents.select("repo", "page", "place", "sha", "message", *people, "url", "code_diff"), quarantine


def collect_prs(pages: DataFrame, patches: DataFrame, page_size: int = 100, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pull-request documents, quarantine) from listing pages and patch responses (url, status, body).

    The diff is the text of a patch that was found (200), else ''. A null body becomes ''.
    """
    kept, quarantine = page_records(pages, records.PR_RECORD, records.PR_TYPES, page_size, cap)
    diff = records.patch_or_empty(F.col("url"), F.col("status"), F.col("body"))
    documents = _with_diffs(kept, "patch_url", patches.select("url", diff.alias("code_diff")))
    sides = [F.struct(*(F.col(f"{side}_{part}").alias(part) for part in ("ref", "sha"))).alias(side) for side in ("head", "base")]
    return documents.select(
        "repo", "page", "place", "number", "title", F.coalesce("body", F.lit("")).alias("body"), "state",
        "created_at", "updated_at", "closed_at", "merged_at",
        F.struct(F.col("user_login").alias("login"), F.col("user_avatar_url").alias("avatar_url")).alias("user"),
        *sides, "url", "diff_url", "patch_url", "code_diff",
    ), quarantine
