"""Commit, pull-request and repository records: presence rules and flattening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the flat columns come from in the landed JSON.
COMMIT_PATHS = {
    "sha": "$.sha",
    "message": "$.commit.message",
    "author": "$.commit.author.name",
    "email": "$.commit.author.email",
    "date": "$.commit.author.date",
}
PR_PATHS = {
    "number": "$.number",
    "title": "$.title",
    "state": "$.state",
    "user": "$.user.login",
    "created_at": "$.created_at",
}
PR_TYPES = {"number": "bigint"}

# Where a document's fields come from in the records of a listing page.
COMMIT_RECORD = {
    "sha": "$.sha",
    "message": "$.commit.message",
    "author_name": "$.commit.author.name",
    "author_email": "$.commit.author.email",
    "author_date": "$.commit.author.date",
    "committer_name": "$.commit.committer.name",
    "committer_email": "$.commit.committer.email",
    "committer_date": "$.commit.committer.date",
    "url": "$.html_url",
    "api_url": "$.url",
}
PR_RECORD = {
    "number": "$.number",
    "title": "$.title",
    "body": "$.body",
    "state": "$.state",
    "created_at": "$.created_at",
    "updated_at": "$.updated_at",
    "closed_at": "$.closed_at",
    "merged_at": "$.merged_at",
    "user_login": "$.user.login",
    "user_avatar_url": "$.user.avatar_url",
    "head_ref": "$.head.ref",
    "head_sha": "$.head.sha",
    "base_ref": "$.base.ref",
    "base_sha": "$.base.sha",
    "url": "$.html_url",
    "diff_url": "$.diff_url",
    "patch_url": "$.patch_url",
}
# A commit without the address of its detail has no diff but is a commit.
OPTIONAL = {"api_url"}

# Repository metadata keys and what an absent key gives.
META_FIELDS = {
    "name": ("$.name", "string", ""),
    "description": ("$.description", "string", ""),
    "language": ("$.language", "string", ""),
    "stars": ("$.stargazers_count", "bigint", 0),
    "forks": ("$.forks_count", "bigint", 0),
}


def present(v: Column, path: str) -> Column:
    """The path exists. A JSON null leaf counts as present, an absent key or a null parent does not."""
    return F.variant_get(v, path, "variant").isNotNull()


def all_present(v: Column, paths: dict[str, str]) -> Column:
    test = present(v, next(iter(paths.values())))
    for path in list(paths.values())[1:]:
        test = test & present(v, path)
    return test


def leaf(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def with_default(v: Column, path: str, kind: str, default) -> Column:
    """The default replaces an absent key only; a JSON null stays null."""
    return F.when(present(v, path), leaf(v, path, kind)).otherwise(F.lit(default).cast(kind))


def commit_diff(files: Column) -> Column:
    """One text per commit from its changed files; files without a patch are left out, none give ''."""
    kept = F.filter(files, lambda f: f["patch"] != "")
    parts = F.transform(kept, lambda f: F.concat(F.lit("--- "), f["filename"], F.lit("\n"), f["patch"]))
    return F.coalesce(F.array_join(parts, "\n"), F.lit(""))


def patch_or_empty(url: Column, status: Column, text: Column) -> Column:
    fetched = F.coalesce(url, F.lit("")) != ""
    return F.coalesce(F.when(fetched & (status == 200), text), F.lit(""))


def snippet(lines: Column, start: Column, end: Column) -> Column:
    """Lines `start` to `end` (1-based, inclusive) of a text that is split into `lines`.

    Takes time in proportion to the lines taken, wherever they lie. Lines past the end are not there.
    """
    taken = F.transform(F.sequence(start, end), lambda i: F.get(lines, i - 1))
    return F.when(start <= end, F.array_join(taken, "\n")).otherwise(F.lit(""))
