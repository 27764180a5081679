"""String expressions with the exact meaning the Python and SQLite originals have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python counts as white space. Java's \\s differs in both of its modes.
_SPACES = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACES}]"
NON_SPACE = f"[^{_SPACES}]"

#: The same characters one by one.
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Suffixes per language and per indexing variant.
LANGUAGE_SUFFIXES = {
    "python": (".py",),
    "typescript": (".ts", ".tsx"),
    "javascript": (".js", ".jsx"),
}
SERVICE_SUFFIXES = (".py", ".js", ".ts", ".java", ".go", ".cpp", ".c", ".jsx", ".tsx")
HEAD_SUFFIXES = (".py", ".js", ".ts", ".java", ".go", ".cpp", ".c")
ENTITY_SUFFIXES = tuple(s for suffixes in LANGUAGE_SUFFIXES.values() for s in suffixes)

# Directories left out.
SKIPPED_SEGMENTS = ("node_modules", "__pycache__", "venv")
SKIPPED_WORDS = (".git", "node_modules", "__pycache__", "venv", "dist", "build")


def strip(c: Column) -> Column:
    """Python's str.strip(); Spark's trim removes spaces only."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def is_blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return c.isNull() | ~c.rlike(NON_SPACE)


def preview(c: Column, width: int = 80) -> Column:
    return F.substring(c, 1, width)


def short_sha(c: Column) -> Column:
    return F.substring(c, 1, 8)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def fold(text: str) -> str:
    """A-Z to a-z, as `ascii_lower` does for columns."""
    return "".join(ch.lower() if ch in _UPPER else ch for ch in text)


def contains_like(c: Column, pattern: str) -> Column:
    """`c LIKE '%pattern%'` as SQLite does it.

    Only A-Z fold, `%` and `_` in the pattern stay wildcards and a backslash is a plain character,
    so the escape character is one the pattern does not use.
    """
    folded = fold(pattern)
    unused = next(chr(n) for n in range(1, 0x10000) if chr(n) not in folded + "%_")
    return F.like(ascii_lower(c), F.lit(f"%{folded}%"), F.lit(unused))


def language_of(path: Column) -> Column:
    """Language by case-sensitive suffix, null when unsupported."""
    found = F.lit(None).cast("string")
    for language, suffixes in LANGUAGE_SUFFIXES.items():
        found = F.when(has_suffix(path, suffixes), F.lit(language)).otherwise(found)
    return found


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for suffix in suffixes:
        test = test | path.endswith(suffix)
    return test


def directory_of(path: Column) -> Column:
    """Everything before the last slash, '' for a file at the root."""
    return F.regexp_replace(path, r"(?s)/?[^/]*\z", "")


def excluded_by_segment(path: Column) -> Column:
    """A directory segment that is hidden or a known dependency folder (service rule, the default)."""
    return F.exists(
        F.split(directory_of(path), "/"),
        lambda part: part.startswith(".") | part.isin(*SKIPPED_SEGMENTS),
    )


def excluded_by_word(path: Column) -> Column:
    """One of the words anywhere in the directory, even inside a longer name (offline rule)."""
    directory = directory_of(path)
    test = F.lit(False)
    for word in SKIPPED_WORDS:
        test = test | directory.contains(word)
    return test


def excluded_by_prefix(path: Column) -> Column:
    """A path that starts with the version-control folder's name (head-indexing rule)."""
    return path.startswith(".git")


def repo_url(url: Column, host: str | Column, strict: bool = False) -> Column:
    """Owner, repository and full name of a repository URL on `host`, with `error` instead of a raise.

    Lenient: `https://host/owner/repo[/...]`. Strict: also `git@host:owner/repo.git`, and exactly two
    parts. Only the ssh form loses `.git`, and it loses every occurrence.
    """
    host = F.lit(host) if isinstance(host, str) else host
    https, ssh = F.concat(F.lit("https://"), host, F.lit("/")), F.concat(F.lit("git@"), host, F.lit(":"))
    is_https, is_ssh = url.startswith(https), url.startswith(ssh)
    rest = F.rtrim(F.replace(url, https, F.lit("")), F.lit("/"))
    known = is_https
    if strict:
        ssh_rest = F.replace(F.replace(url, ssh, F.lit("")), F.lit(".git"), F.lit(""))
        rest = F.when(is_https, rest).otherwise(ssh_rest)
        known = is_https | is_ssh
    parts = F.split(rest, "/")
    enough = (F.size(parts) == 2) if strict else (F.size(parts) >= 2)
    ok = F.coalesce(known, F.lit(False)) & enough
    owner, name = F.get(parts, 0), F.get(parts, 1)
    return F.struct(
        F.when(ok, owner).alias("owner"),
        F.when(ok, name).alias("repo"),
        F.when(ok, F.concat(owner, F.lit("/"), name)).alias("full_name"),
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unsupported url"))
        .when(~enough, F.lit("owner and repository expected"))
        .alias("error"),
    )
