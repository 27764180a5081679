"""Indexing of many repositories at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import SERVICE_SUFFIXES, excluded_by_segment, has_suffix
from codestrata.operators.python_source import is_python, parse_python, python_entities
from codestrata.operators.upsert import file_dictionary, first_write, new_files, new_rows
from codestrata.schemas import BLOBS, COMMITS, INDEXED, SYMBOLS
from codestrata.session import broadcast_if_small, dealt, scratch, shuffles_dropped, stage
from codestrata.sources.runs import RunTables
from codestrata.sources.tables import last_indexed, lineage_tables, read_lineage

# Fixed value: the commit of a repository nothing is known about.
UNKNOWN = "unknown"


class Lineage(NamedTuple):
    commits: DataFrame
    files: DataFrame
    symbols: DataFrame


def head_commits(repos: DataFrame, commits: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(repo, commit_sha): the tree's own head, else the newest commit, else 'unknown'."""
    newest = commits.groupBy("repo").agg(
        F.max_by("commit_sha", F.struct("committed_at", "commit_sha")).alias("newest_sha")
    )
    known = repos.select("repo").join(newest, "repo", "left")
    if heads is not None:
        known = known.join(heads.select("repo", "head_sha"), "repo", "left")
    else:
        known = known.withColumn("head_sha", F.lit(None).cast("string"))
    return known.select("repo", F.coalesce("head_sha", "newest_sha", F.lit(UNKNOWN)).alias("commit_sha"))


def index_repositories(
    tree: DataFrame,
    commits: DataFrame,
    heads: DataFrame | None = None,
    suffixes: tuple[str, ...] = SERVICE_SUFFIXES,
    store_empty_files: bool = False,
    arrival: tuple[str, ...] = ("committed_at",),
    **parse_options,
) -> Lineage:
    """Commits, files and symbols of all repositories in `tree` (repo, path, content) at their head.

    Sources are parsed once: the symbol rows are written to the shared folder, and the file table
    is derived from them. `store_empty_files` also keeps matching files that gave no symbol, and
    takes their paths from a second pass over `tree`, which should then be a stored table. Of copies of a
    commit the first by `arrival` wins, and of equal ones the first by all other columns, however they are spread.
    """
    path = F.col("path")
    sources = tree.filter(has_suffix(path, suffixes) & ~excluded_by_segment(path))
    known = commits.select("repo") if heads is None else commits.select("repo").unionByName(heads.select("repo"))
    heads = broadcast_if_small(stage(head_commits(known.distinct(), commits, heads), "heads"))
    found = python_entities(dealt(sources, "repo", "path"), with_text=False, **parse_options).join(heads, "repo", "left")
    symbols = stage(
        found.withColumn("commit_sha", F.coalesce("commit_sha", F.lit(UNKNOWN))).select(
            "repo",
            F.xxhash64("repo", "commit_sha", "path", "type", "name", "start_line", "end_line").alias("symbol_id"),
            "commit_sha",
            F.col("type").alias("kind"),
            "name",
            "start_line",
            "end_line",
            F.col("path").alias("current_path"),
        ),
        "symbols",
    )
    stored = sources.select("repo", F.col("path").alias("current_path")) if store_empty_files else symbols
    files = stage(file_dictionary(stored), "files")
    return Lineage(_first_commits(commits, arrival), files, _with_file_ids(symbols, files).select(*SYMBOLS.fieldNames()))


def _first_commits(commits: DataFrame, arrival: tuple[str, ...]) -> DataFrame:
    return first_write(commits, ["repo", "commit_sha"], _arrival(commits, arrival))


def _arrival(commits: DataFrame, arrival: tuple[str, ...]) -> list[str]:
    return [*arrival, *(c for c in commits.columns if c not in arrival)]


def _with_file_ids(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select("repo", "current_path", "file_id"), ["repo", "current_path"])


class Indexed(NamedTuple):
    """What one run of `index_into` did."""

    parsed: DataFrame
    """The blobs it parsed: blob, parser, symbols, error."""
    repos: DataFrame
    """The repositories whose symbols it wrote: repo, commit_sha."""


def blob_table(spark: SparkSession, root: str) -> RunTables:
    """What each content, known by its hash, holds."""
    return RunTables(spark, f"{root.rstrip('/')}/blobs", {"parsed": BLOBS}, "blob")


def read_index(spark: SparkSession, root: str) -> Lineage:
    """Commits, files and symbols of all that `index_into` has indexed; of a commit indexed again, the last symbols."""
    return Lineage(*(read_lineage(spark, root, name) for name in Lineage._fields))


def compact_index(spark: SparkSession, root: str) -> None:
    """One run of files instead of one per indexing, without the symbols that a later indexing has replaced."""
    store = lineage_tables(spark, root)
    last = last_indexed(store.read("indexed"))

    def kept(symbols: DataFrame) -> DataFrame:
        return symbols.join(broadcast_if_small(last.select("repo", "commit_sha", "number")), ["repo", "commit_sha", "number"], "left_semi")

    store.compact(symbols=kept, indexed=lambda _: last)
    blob_table(spark, root).compact()


def index_into(
    root: str,
    tree: DataFrame,
    commits: DataFrame,
    heads: DataFrame | None = None,
    suffixes: tuple[str, ...] = SERVICE_SUFFIXES,
    store_empty_files: bool = False,
    arrival: tuple[str, ...] = ("committed_at",),
    include_async: bool = False,
    include_decorators: bool = False,
    parses=None,
) -> Indexed:
    """Index `tree` (repo, path, content; a stored table) at its heads into the tables under `root`, which `read_index` reads.

    Contents are known by their hash. A first pass over the tree keeps (repo, path, hash) alone; only hashes that were never
    parsed with these options, in any repository and any run, are parsed, once, and what a blob holds is stored beside its hash. Symbols are
    then assembled by a join: of many paths with one content, the paths are the streamed side and the blob is one row.
    So a tree that changed in one file parses that file, and an unchanged one parses nothing and writes nothing.

    Commits and files that are there keep their rows and ids. Symbols of other commits stay; a commit indexed again from another
    tree has its symbols replaced. The blobs are stored before the tables, each by one run: a job that dies is
    started again, and what it had parsed is not parsed twice. `parses` is an accumulator that counts parsed files.
    """
    spark = tree.sparkSession
    store, blobs = lineage_tables(spark, root), blob_table(spark, root)
    path = F.col("path")
    sources = tree.filter(has_suffix(path, suffixes) & ~excluded_by_segment(path) & F.col("content").isNotNull())
    parser = f"python async={include_async} decorators={include_decorators}"
    parsed, number = spark.createDataFrame([], BLOBS), store.manifest().next_number()
    known = blobs.read("parsed").filter(F.col("parser") == parser).select(F.unhex("blob").alias("blob"))
    last = last_indexed(store.read("indexed")).select("repo", "commit_sha", "tree")

    # What is staged goes with the run, and what only the listing and the parse need with these; hashes are 32 bytes.
    with scratch(spark, "run") as kept:
        with scratch(spark, "listing"):
            manifest = stage(sources.select("repo", "path", _hash("content").alias("blob")).distinct(), "manifest", codec="zstd")
            with scratch(spark, "parse"):
                wanted = manifest.filter(is_python(path, include_decorators))
                unseen = wanted.groupBy("blob").agg(F.min(F.struct("repo", "path")).alias("at"))
                unseen = stage(unseen.join(known, "blob", "left_anti").select("at.*", _mark("blob").alias("mark")), "unseen", codec="zstd")
                if not unseen.isEmpty():
                    rows = _parsed(sources, unseen, parser, include_async, include_decorators, parses)
                    parsed = blobs.read_run("parsed", blobs.append(together=("parsed",), parsed=rows))

            hashed = F.lower(F.hex("blob"))
            entries = manifest.groupBy("repo").agg(
                F.format_string("%d %x %s", F.count("*"), F.bit_xor(F.xxhash64("path", hashed)), F.sum(F.xxhash64(hashed, "path").cast("decimal(38,0)")).cast("string")).alias("tree"))
            at = head_commits(entries.select("repo"), commits, heads)
            due = entries.join(at, "repo").withColumn("tree", F.concat("tree", F.lit(f" {parser} {store_empty_files}"))).join(last, ["repo", "commit_sha", "tree"], "left_anti")
            due = stage(due.withColumn("number", F.lit(number).cast("long")), "due", folder=kept)
            fresh = new_rows(store.read("commits"), commits, ["repo", "commit_sha"], _arrival(commits, arrival)).select(*COMMITS.fieldNames())
            with shuffles_dropped(spark):
                if due.isEmpty() and fresh.isEmpty():
                    return Indexed(parsed, spark.createDataFrame([], INDEXED).select("repo", "commit_sha"))

            # Only the short list of due repositories is broadcast; a blob's symbols meet all paths that hold it, and go as one row a path.
            listed = manifest.join(broadcast_if_small(due.select("repo", "commit_sha", "number")), "repo")
            held = blobs.read("parsed").filter((F.col("parser") == parser) & (F.size("symbols") > 0)).select(F.unhex("blob").alias("blob"), "symbols")
            found = listed.filter(is_python(path, include_decorators)).join(held, "blob").select(
                "repo", "commit_sha", "number", F.col("path").alias("current_path"), "symbols")
            found = stage(found, "symbols", codec="zstd", folder=kept)
            stored = found.select("repo", "current_path")
            if store_empty_files:
                stored = stage(listed.select("repo", F.col("path").alias("current_path")), "stored", codec="zstd", folder=kept)

        # The new files are staged with their places; numbering them again reads no more than these.
        files = new_files(stored, store.read("files"))
        ids = store.read("files").unionByName(files)
        symbol = F.xxhash64("repo", "commit_sha", "current_path", "kind", "name", "start_line", "end_line").alias("symbol_id")
        placed = _with_file_ids(found, ids).hint("rebalance", "repo")
        symbols = placed.select("repo", "commit_sha", "number", "current_path", "file_id", F.inline("symbols")).withColumn("symbol_id", symbol)
        run = store.append(together=("symbols",), commits=fresh, files=files, symbols=symbols, indexed=due)
    return Indexed(parsed, store.read_run("indexed", run).select("repo", "commit_sha"))


def _hash(content: str) -> Column:
    return F.unhex(F.sha2(content, 256))


def _mark(blob: str) -> Column:
    """Half of a hash, enough to tell apart the contents that a tree has at one path."""
    return F.substring(blob, 1, 16)


def _parsed(sources: DataFrame, unseen: DataFrame, parser: str, include_async: bool, include_decorators: bool, parses) -> DataFrame:
    """Each unseen blob with its symbols, from the one file that stands for it; all rows of a blob in one part."""
    where = broadcast_if_small(unseen)
    # A few contents are dealt when they are found; else all sources are, once for both the join and the parse.
    few = where is not unseen
    contents = (sources if few else dealt(sources, "repo", "path")).join(where, ["repo", "path"]).withColumn("blob", _hash("content")).filter(_mark("blob") == F.col("mark"))
    # A path that the tree repeats is parsed again; the number deals its copies.
    copies = contents.select(F.base64("blob").alias("repo"), F.concat(F.monotonically_increasing_id().cast("string"), F.lit(".py")).alias("path"), "content")
    rows = parse_python(dealt(copies, "repo", "path") if few else copies, include_async, include_decorators, with_text=False, parses=parses, with_empty=True)
    # Copies of a content give the same symbols, and no two definitions of one start at the same line: as a set they are one copy's.
    symbol = F.when(F.col("type").isNotNull(), F.struct("start_line", "end_line", F.col("type").alias("kind"), "name"))
    given = rows.select(F.unbase64("repo").alias("blob"), symbol.alias("symbol"), "error")
    one = given.groupBy("blob").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"), F.max("error").alias("error"))
    return one.select(F.lower(F.hex("blob")).alias("blob"), F.lit(parser).alias("parser"), "symbols", "error")
