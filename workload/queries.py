"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import records, text
from codestrata.operators import constraints, context, javascript, lookups, names, pivots, python_source, ranking, upsert, vectors
from codestrata.operators.entities import extract_entities, with_code
from codestrata.plans import collect, index, report, retrieval
from codestrata.schemas import COMMIT_DOCUMENT, ENTITIES, PR_DOCUMENT
from codestrata.session import dealt, scratch, shuffles_dropped, stage, work_dir
from codestrata.sources import arrays, landed, tables, tree
from codestrata.streaming import ingest
from workload.views import table, v_code, v_scripts, view

DIM = 256
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def text_of(*parts: str | Column) -> Column:
    """Concatenation of plain strings and columns as text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- sources -------------------------------------------------------------------------------------


@query
def pr_props_json(spark, sf):
    props = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", props["k"].alias("k"))


def land_arrays(documents: DataFrame, path: str) -> None:
    """Write JSON texts as files that each hold one array."""
    def lines(batches):
        opening = "["
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([("[" if opening == "[" and i == 0 else ",") + t for i, t in enumerate(batch.column(0).to_pylist())])], names=["value"])
            opening = "," if batch.num_rows else opening
        yield pa.RecordBatch.from_arrays([pa.array(["]" if opening == "," else "[]"])], names=["value"])

    documents.mapInArrow(lines, "value string").write.text(path)


@query
def commit_json_source(spark, sf):
    folder = work_dir(spark, "landed")
    land_arrays(commit_documents(spark, sf).select("body"), folder)
    documents, _ = landed.read_json(spark, folder, COMMIT_DOCUMENT)
    return landed.flatten_commits(documents).select(
        "sha", "message", "author_name", "author_email", "committer_name", "url",
        stamp("authored_at").alias("authored_at"), stamp("committed_at").alias("committed_at"),
    )


@query
def commit_array_split(spark, sf):
    """The landed arrays, each read by many tasks."""
    folder = work_dir(spark, "landed")
    land_arrays(commit_documents(spark, sf).select("body"), folder)
    documents, _ = arrays.read_array(spark, folder, COMMIT_DOCUMENT, 1 << 20)
    return landed.flatten_commits(documents).select(
        "sha", "message", "author_name", "author_email", "committer_name", "url",
        stamp("authored_at").alias("authored_at"), stamp("committed_at").alias("committed_at"),
    )


@query
def pr_json_source(spark, sf):
    folder = work_dir(spark, "landed")
    land_arrays(view(spark, sf, "v_prs").select(F.to_json(pr_document(), {"ignoreNullFields": "false"})), folder)
    documents, _ = landed.read_json(spark, folder, PR_DOCUMENT)
    return landed.flatten_prs(documents).select(
        "number", "title", "body", "state", "user_login", "head_ref", "base_sha",
        *(stamp(c).alias(c) for c in ("created_at", "updated_at", "closed_at", "merged_at")),
    )


#: Files that lie checked out at a time. A file takes a block of the disk, however small it is.
CHECKED_OUT = 250_000


@query
def tree_scan(spark, sf):
    """Checked-out trees, written as files by tasks, and walked: a part of all files at a time, over the files of the part before."""
    key = F.regexp_extract("path", "order_([0-9]+)", 1)
    path = text_of("src/", key.cast("bigint") % 7, "/order_", key, ".py").alias("path")
    files = table(spark, sf, "lineitem").agg(F.approx_count_distinct("l_orderkey")).first()[0]
    parts = 1 + files // CHECKED_OUT
    number = F.pmod(F.xxhash64("repo", "path"), F.lit(parts)).cast("int").alias("part")
    sources, found = v_code(spark, sf, "py").select("repo", path, "content"), work_dir(spark, "scanned")
    if parts > 1:
        sources = stage(sources.select("*", number), "sources", "part")
    spent = None
    for part in range(parts):
        folder = work_dir(spark, "checkouts")
        if folder.startswith("file:"):
            folder = "/" + folder[5:].lstrip("/")
        rows = sources.filter(F.col("part") == part) if parts > 1 else sources
        with scratch(spark, "listed"), shuffles_dropped(spark):
            check_out(rows if spent is None else in_place_of(spent, rows, folder), folder)
            scanned = tree.read_tree(spark, folder).select("repo", "path", F.md5("content").alias("content_md5"), "valid_utf8")
            scanned.write.parquet(f"{found}/part={part}")
        spent = folder, spark.read.schema(scanned.schema).parquet(f"{found}/part={part}").select("repo", "path")
        if part == parts - 1 or not is_local(folder):
            remove_folders(spent[1].select("repo", F.regexp_extract("path", "^(.*)/", 1).alias("path")).distinct(), folder)
            spent = None
    return spark.read.schema(scanned.schema).parquet(*(f"{found}/part={part}" for part in range(parts)))


def is_local(folder: str) -> bool:
    return fs.FileSystem.from_uri(folder)[0].type_name == "local"


def in_place_of(spent: tuple[str, DataFrame], sources: DataFrame, folder: str) -> DataFrame:
    """Move a checked-out folder to `folder`; its (repo, path), marked as spent, before the `sources` that take their places there."""
    old, files = spent
    fs.FileSystem.from_uri(old)[0].move(old, folder)
    rows = sources.select("repo", "path", "content", F.lit(False).alias("spent"))
    rows = rows.unionByName(files.select("repo", "path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("spent")))
    return dealt(rows, "repo", "path").sortWithinPartitions(F.desc("spent"))


def check_out(sources: DataFrame, folder: str) -> None:
    """Write (repo, path, content) as files under `folder`.

    Rows of `in_place_of` that are spent are local files which go. They are renamed and written over rather than removed: a file
    system may look at every inode freed in the last minutes before it makes a file, which takes ten times as long as the file.
    """
    def write(batches):
        (system, base), made, spent = fs.FileSystem.from_uri(folder), set(), {}
        for batch in batches:
            marks = batch.column("spent").to_pylist() if "spent" in batch.schema.names else [False] * batch.num_rows
            for repo, name, content, gone in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "content")), marks, strict=True):
                path = f"{base}/{repo}/{name}"
                inside = path.rsplit("/", 1)[0]
                if gone:
                    spent.setdefault(inside, set()).add(path)
                    continue
                if inside not in made:
                    system.create_dir(inside, recursive=True)
                    made.add(inside)
                if not _written_over(_taken(spent, inside, path), path, content.encode()):
                    with system.open_output_stream(path) as out:
                        out.write(content.encode())
        for path in (p for paths in spent.values() for p in paths):
            if system.get_file_info(path).type == fs.FileType.File:
                system.delete_file(path)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["done"])

    columns = [c for c in ("repo", "path", "content", "spent") if c in sources.columns]
    sources.select(*columns).mapInArrow(write, "done string").write.format("noop").mode("overwrite").save()


def _taken(spent: dict[str, set[str]], inside: str, path: str) -> str | None:
    """A spent file, no longer listed: that of the path itself, else one of its folder, else any."""
    if not spent:
        return None
    place = inside if inside in spent else next(iter(spent))
    paths = spent[place]
    if path in paths:
        paths.remove(path)
        old = path
    else:
        old = paths.pop()
    if not paths:
        del spent[place]
    return old


def _written_over(old: str | None, path: str, raw: bytes) -> bool:
    """Whether the old file could be taken; one may have gone in an attempt that failed."""
    if old is None:
        return False
    try:
        if old != path:
            os.rename(old, path)
        with open(path, "r+b") as out:
            out.write(raw)
            out.truncate()
    except FileNotFoundError:
        return False
    return True


def remove_folders(folders: DataFrame, root: str) -> None:
    """Remove (repo, path) folders under `root` by tasks, then `root` itself."""
    def remove(batches):
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for repo, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if system.get_file_info(f"{base}/{repo}/{path}").type == fs.FileType.Directory:
                    system.delete_dir(f"{base}/{repo}/{path}")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["done"])

    dealt(folders).mapInArrow(remove, "done string").write.format("noop").mode("overwrite").save()
    system, base = fs.FileSystem.from_uri(root)
    system.delete_dir(base)


@query
def tolerant_load(spark, sf):
    # Beside whole arrays, every benchmark text as a file of its own that is not JSON.
    folder = work_dir(spark, "landed")
    land_arrays(commit_documents(spark, sf).select("body"), f"{folder}/good")
    texts = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("["), F.coalesce("text", F.lit(""))).alias("value"))
    texts.write.partitionBy("item_id").option("maxRecordsPerFile", 1).text(f"{folder}/bad")
    found = []
    for part in ("good", "bad"):
        documents, quarantine = landed.read_json(spark, f"{folder}/{part}", COMMIT_DOCUMENT)
        item = F.regexp_extract("file", "item_id=(-?[0-9]+)", 1)
        found.append(documents.select(F.lit("document").alias("kind"), F.col("sha").alias("name")))
        found.append(quarantine.select(F.lit("quarantine").alias("kind"), F.when(item != "", item).alias("name")))
    return reduce(DataFrame.unionByName, found)


@query
def lineage_round_trip(spark, sf):
    folder = work_dir(spark, "lineage")
    tables.write_lineage(folder, commits=view(spark, sf, "v_commits"), files=view(spark, sf, "v_files"))
    return tables.read_lineage(spark, folder, "commits").select("repo", F.lit("commit").alias("kind"), F.col("commit_sha").alias("name")).unionByName(
        tables.read_lineage(spark, folder, "files").select("repo", F.lit("file").alias("kind"), F.col("current_path").alias("name")))


@query
def entity_sink(spark, sf):
    folder = work_dir(spark, "entities")
    tables.write_entities(python_source.python_entities(v_code(spark, sf, "py")), folder)
    stored = spark.read.schema(ENTITIES).json(folder)
    return stored.select("repo", "path", "type", "name", "start_line", "end_line", "code")


@query
def index_search(spark, sf):
    folder = work_dir(spark, "index")
    tables.write_vectors(vector_table(spark, sf), f"{folder}/vectors")
    stored = tables.load_pivot_index(spark, f"{folder}/index", f"{folder}/vectors", 64)
    return pivots.search(stored, label_probes(spark, sf), 5).select("query_id", "rank", "item_id", F.round("distance", 6).alias("distance"))


@query
def vector_profile(spark, sf):
    size = F.size("embedding").cast("int")
    return (
        table(spark, sf, "embeddings")
        .groupBy(size.alias("dim"))
        .agg(F.count("*").alias("vectors"), F.count_if(F.col("vec_id").isNull()).alias("null_ids"))
    )


@query
def paged_union(spark, sf):
    pages = table(spark, sf, "events").select(
        text_of("repo", F.col("user_id") % 10).alias("source"),
        F.expr("event_id div 100").alias("page"),
        "event_id",
    )
    return landed.read_pages(pages, page_size=4, first_page=0).select("source", "page", "event_id")


def landed_pages(rows: DataFrame, record: Column) -> DataFrame:
    """Rows by their number `at` as responses: ten pages of a hundred a repository, in order.

    One page in seven is short by its last record; one in nine failed, and half of those were asked for again.
    """
    block = F.expr("at div 100")
    full = rows.filter(~((block % 7 == 6) & (F.col("at") % 100 == 99)))
    bodies = full.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", record.alias("record")))).alias("all"))
    body = F.to_json(F.transform("all", lambda s: s["record"]), {"ignoreNullFields": "false"})
    good = bodies.select(text_of("repo", F.expr("block div 10")).alias("repo"), (F.col("block") % 10 + 1).alias("page"), "block", F.lit(200).alias("status"), body.alias("body"))
    lost = F.col("block") % 9 == 4
    failed = good.filter(lost).withColumn("status", F.lit(502))
    again = good.filter(F.col("block") % 18 == 4)
    return good.filter(~lost).unionByName(failed).unionByName(again).drop("block")


@query
def collected_commits(spark, sf):
    """Commit documents from listing pages and detail responses."""
    sha = F.md5(F.col("at").cast("string"))
    person = F.struct(text_of("customer", F.col("o_custkey")).alias("name"), F.lit("c@example.com").alias("email"), iso(F.col("o_orderdate").cast("timestamp")).alias("date"))
    record = F.struct(
        sha.alias("sha"),
        F.struct(F.col("o_orderpriority").alias("message"), F.when(F.col("at") % 97 != 5, person).alias("author"), person.alias("committer")).alias("commit"),
        text_of("https://host.example/commit/", sha).alias("html_url"),
        F.when(F.col("at") % 11 != 3, text_of("https://api.example/", sha)).alias("url"),
    )
    pages = landed_pages(table(spark, sf, "orders").withColumn("at", F.col("o_orderkey")), record)
    patch = F.when(F.col("l_returnflag") != "N", F.when(F.col("l_linestatus") == "F", text_of("+", F.col("l_quantity").cast("int"))).otherwise(F.lit("")))
    name = F.when(F.col("l_orderkey") % 17 != 0, text_of("part_", F.col("l_partkey"), ".py"))
    files = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("filename"), patch.alias("patch")))).alias("files"))
    details = files.select(
        text_of("https://api.example/", F.md5(F.col("l_orderkey").cast("string"))).alias("url"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.to_json(F.struct("files")).alias("body"),
    )
    documents, quarantine = collect.collect_commits(pages, details, cap=450)
    shown = landed.flatten_commits(documents).select("repo", "page", "place", "sha", "message", "author_name", stamp("committed_at").alias("committed_at"), "url", "code_diff")
    none = F.lit(None).cast("string")
    aside = quarantine.select(
        "repo", "page", F.lit(-1).alias("place"), F.get_json_object("value", "$.sha").alias("sha"),
        *(none.alias(c) for c in ("message", "author_name", "committed_at", "url", "code_diff")))
    return shown.unionByName(aside)


@query
def collected_prs(spark, sf):
    """Pull-request documents from listing pages and patch responses."""
    kind = F.col("number") % 5
    link = F.when(kind == 1, F.lit("")).when(kind != 0, text_of("https://host.example/", F.col("number"), ".patch"))
    document = pr_document()
    prs = view(spark, sf, "v_prs").withColumn("at", F.col("number")).withColumn("d", document)
    user = F.when(F.col("number") % 53 != 0, F.col("d.user"))
    record = F.struct(
        *(F.col(f"d.{c}").alias(c) for c in ("number", "title", "body", "state", "created_at", "updated_at", "closed_at", "merged_at", "head", "base")),
        user.alias("user"), F.lit("h").alias("html_url"), F.lit("d").alias("diff_url"), link.alias("patch_url"),
    )
    patches = prs.filter(kind != 4).select(
        link.alias("url"), F.when(F.col("title").startswith("error"), F.lit(404)).otherwise(F.lit(200)).alias("status"), F.col("props").alias("body"))
    documents, _ = collect.collect_prs(landed_pages(prs, record), patches)
    return landed.flatten_prs(documents).select("repo", "page", "place", "number", "title", "body", "state", "user_login", "head_ref", stamp("closed_at").alias("closed_at"), "code_diff")


# ---- projections ---------------------------------------------------------------------------------


@query
def url_parts(spark, sf):
    host = F.split("url", "/")[2]
    pages = table(spark, sf, "pages").withColumn("host", host)
    return pages.withColumn("lenient", text.repo_url(F.col("url"), F.col("host"))).withColumn(
        "strict", text.repo_url(F.col("url"), F.col("host"), strict=True)
    ).select(
        "page_id",
        "host",
        F.col("lenient.owner").alias("owner"),
        F.col("lenient.repo").alias("repo"),
        F.col("lenient.full_name").alias("full_name"),
        F.col("lenient.error").alias("error"),
        F.col("strict.error").alias("strict_error"),
    )


def commit_documents(spark, sf) -> DataFrame:
    """The commits as landed JSON text."""
    person = F.struct(
        F.col("author_name").alias("name"), F.col("author_email").alias("email"), iso("committed_at").alias("date")
    )
    document = F.struct(
        F.col("commit_sha").alias("sha"),
        "message",
        person.alias("author"),
        person.alias("committer"),
        text_of("https://host.example/", F.col("repo"), "/commit/", F.col("commit_sha")).alias("url"),
        F.lit("").alias("code_diff"),
    )
    return view(spark, sf, "v_commits").select("repo", F.to_json(document).alias("body"))


@query
def commit_flatten(spark, sf):
    documents = commit_documents(spark, sf).select("repo", F.from_json("body", COMMIT_DOCUMENT).alias("d"))
    flat = landed.flatten_commits(documents.select("repo", "d.*"))
    return flat.select(
        "repo", "sha", "message", "author_name", "author_email", "committer_name", "url",
        stamp("authored_at").alias("authored_at"), stamp("committed_at").alias("committed_at"),
    )


def pr_document() -> Column:
    """A pull request as its landed document."""
    ref = F.struct(F.col("state").alias("ref"), F.md5("title").alias("sha"))
    created = iso("created_at")
    return F.struct(
        "number",
        "title",
        F.when(F.col("state") == "open", F.col("props")).alias("body"),
        "state",
        created.alias("created_at"),
        created.alias("updated_at"),
        F.when(F.col("state") == "closed", created).alias("closed_at"),
        F.lit(None).cast("string").alias("merged_at"),
        F.struct(F.col("user_login").alias("login"), F.lit("").alias("avatar_url")).alias("user"),
        ref.alias("head"),
        ref.alias("base"),
    )


@query
def pr_flatten(spark, sf):
    prs, document = view(spark, sf, "v_prs"), pr_document()
    documents = prs.select("repo", F.from_json(F.to_json(document), PR_DOCUMENT).alias("d")).select("repo", "d.*")
    return landed.flatten_prs(documents).select(
        "repo", "number", "title", "body", "state", "user_login", "head_ref", "base_sha",
        stamp("created_at").alias("created_at"), stamp("closed_at").alias("closed_at"), stamp("merged_at").alias("merged_at"),
    )


@query
def repo_meta_defaults(spark, sf):
    k = F.get_json_object("props", "$.k")
    body = (
        F.when(F.col("event_id") % 3 == 0, text_of('{"name":"user', F.col("user_id"), '","description":null,"stargazers_count":', k, "}"))
        .when(F.col("event_id") % 3 == 1, text_of('{"language":"', F.col("event_type"), '","forks_count":null}'))
        .otherwise(F.lit("{}"))
    )
    events = table(spark, sf, "events").select("event_id", body.alias("body"))
    meta, _ = landed.read_metadata(events, "body", keep=("event_id",))
    return meta.withColumn("stars", F.col("stars").cast("string")).withColumn("forks", F.col("forks").cast("string"))


@query
def malformed_skip(spark, sf):
    kind = F.col("event_id") % 5
    author = text_of('{"name":"user', F.col("user_id"), '","email":"u@example.com","date":"2024-01-01"}')
    body = (
        F.when(kind == 0, text_of('{"sha":"', F.md5("props"), '","commit":{"message":"', F.col("event_type"), '","author":', author, "}}"))
        .when(kind == 1, text_of('{"sha":"', F.md5("props"), '","commit":{"message":null,"author":', author, "}}"))
        .when(kind == 2, text_of('{"sha":"', F.md5("props"), '","commit":{"message":"m","author":null}}'))
        .when(kind == 3, text_of('{"sha":"', F.md5("props"), '","commit":{"message":"m","author":{"name":"n","date":"d"}}}'))
        .otherwise(F.lit('{"sha":'))
    )
    bodies = table(spark, sf, "events").select("event_id", body.alias("body"))
    kept, _ = landed.flatten(bodies, "body", records.COMMIT_PATHS, keep=("event_id",))
    return kept


@query
def language_counts(spark, sf):
    language = F.coalesce(text.language_of(F.col("current_path")), F.lit("none"))
    return view(spark, sf, "v_files").groupBy(language.alias("language")).agg(F.count("*").alias("files"))


@query
def commit_diff(spark, sf):
    patch = F.when(
        F.col("l_returnflag") != "N",
        F.when(F.col("l_linestatus") == "F", text_of("+", F.col("l_quantity").cast("int"))).otherwise(F.lit("")),
    )
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text_of("part_", F.col("l_partkey"), ".py").alias("filename"), patch.alias("patch")
    )
    files = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "filename", "patch"))).alias("files")
    )
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", records.commit_diff(F.col("files")).alias("code_diff")
    )


@query
def pr_patch_fallback(spark, sf):
    kind = F.col("event_type")
    url = F.when(kind == "view", F.lit("")).when(kind != "signup", text_of("/pull/", F.col("event_id"), ".patch"))
    status = F.when(kind == "error", F.lit(404)).otherwise(F.lit(200))
    body = F.when(F.col("value") >= 10, F.col("props"))
    return table(spark, sf, "events").select("event_id", records.patch_or_empty(url, status, body).alias("code_diff"))


@query
def commit_normalize(spark, sf):
    padded = F.concat(F.lit(" \n\t "), F.col("text"), F.lit(" \r\n\x1f "))
    epoch = F.col("conv_id") * 3600 + F.col("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.strip(padded).alias("message"), stamp(text.from_epoch(epoch)).alias("committed_at")
    )


@query
def message_preview(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.preview(F.col("text")).alias("preview"), text.short_sha(F.md5("text")).alias("short_sha")
    )


# ---- filters -------------------------------------------------------------------------------------


@query
def ext_filter(spark, sf):
    path = F.col("current_path")
    return view(spark, sf, "v_files").select(
        "repo",
        "current_path",
        text.has_suffix(path, text.SERVICE_SUFFIXES).alias("service"),
        text.has_suffix(path, text.HEAD_SUFFIXES).alias("head"),
        text.has_suffix(path, text.ENTITY_SUFFIXES).alias("entity"),
    )


@query
def dir_exclusion(spark, sf):
    path = F.when(F.col("file_id") % 11 == 0, F.concat(F.lit(".github/"), "current_path")).otherwise(F.col("current_path"))
    return view(spark, sf, "v_files").withColumn("current_path", path).select(
        "repo",
        "current_path",
        text.excluded_by_segment(F.col("current_path")).alias("by_segment"),
        text.excluded_by_word(F.col("current_path")).alias("by_word"),
        text.excluded_by_prefix(F.col("current_path")).alias("by_prefix"),
    )


@query
def blank_filter(spark, sf):
    kind = F.col("conv_id") % 4
    body = F.when(kind == 0, F.col("text")).when(kind == 1, F.lit(" \n\t")).when(kind == 2, F.lit("  \x1c"))
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "text", body.alias("body"))
    return talks.select(
        "conv_id", "turn", text.is_blank(F.col("text")).alias("text_blank"), text.is_blank(F.col("body")).alias("body_blank")
    )


PATTERNS = ["load_1", "D_2_", "OAD%9"]


@query
def symbol_search(spark, sf):
    return names.search_symbols(view(spark, sf, "v_symbols"), view(spark, sf, "v_files"), PATTERNS)


@query
def symbol_search_indexed(spark, sf):
    """The same search by way of trigram postings."""
    symbols = view(spark, sf, "v_symbols")
    return names.search_symbols(symbols, view(spark, sf, "v_files"), PATTERNS, names.name_index(symbols))


@query
def top_function_files(spark, sf):
    return lookups.top_function_files(view(spark, sf, "v_symbols"), view(spark, sf, "v_files"), 10)


# ---- upserts and constraints ---------------------------------------------------------------------


@query
def upsert_commits(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    keys, arrival = ["user_id"], ["ts", "event_id"]
    existing = upsert.first_write(events.filter("event_type = 'signup'"), keys, arrival)
    after = upsert.insert_or_ignore(existing, events.filter("event_type <> 'signup'"), keys, arrival)
    return after.withColumn("ts", stamp("ts"))


@query
def file_dictionary(spark, sf):
    paths = view(spark, sf, "v_files").select("repo", "current_path")
    existing = upsert.file_dictionary(paths.filter(F.col("current_path").endswith(".py")))
    incoming = paths.unionByName(paths.withColumn("current_path", F.lit(None).cast("string")))
    return (
        upsert.file_dictionary(incoming, existing)
        .groupBy("repo", "current_path")
        .agg(F.count_distinct("file_id").alias("ids"), F.count("*").alias("entries"))
    )


@query
def symbols_append(spark, sf):
    symbols = view(spark, sf, "v_symbols")
    again = symbols.filter("kind = 'class'").withColumn("name", F.concat(F.lit("again_"), "name"))
    return upsert.replace_symbols(symbols, again)


@query
def constraint_violations(spark, sf):
    line = table(spark, sf, "lineitem")
    kind = (
        F.when(F.col("l_returnflag") == "R", F.lit("class"))
        .when(F.col("l_returnflag") == "A", F.lit("function"))
        .when(F.col("l_linestatus") == "O", F.lit("method"))
    )
    symbols = line.select(
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("file_id"),
        F.when(F.col("l_linenumber") != 6, F.md5(F.col("l_orderkey").cast("string"))).alias("commit_sha"),
        kind.alias("kind"),
        F.when(F.col("l_discount") > 0.0, F.col("l_suppkey").cast("string")).alias("name"),
        "l_orderkey",
        "l_linenumber",
    )
    _, rejected = constraints.split_valid(symbols)
    return rejected.groupBy("violation", "kind", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("order_sum"))


@query
def orphan_symbols(spark, sf):
    files = view(spark, sf, "v_files").filter(~F.col("current_path").endswith(".go"))
    commits = view(spark, sf, "v_commits").filter(~F.col("message").startswith("1-"))
    # A commit belongs to its customer's repository, a symbol to its part's; one repository name joins both.
    symbols = view(spark, sf, "v_symbols").withColumn("repo", F.lit("repo"))
    broken = constraints.orphans(
        symbols, files.withColumn("repo", F.lit("repo")), commits.withColumn("repo", F.lit("repo"))
    )
    return broken


@query
def head_fallback(spark, sf):
    repos = table(spark, sf, "part").select(text_of("repo", F.col("p_partkey") % 13).alias("repo")).distinct()
    heads = (
        view(spark, sf, "v_repos")
        .filter("description <> ''")
        .select("repo", F.when(F.col("repo") != "repo1", F.md5("description")).alias("head_sha"))
    )
    return index.head_commits(repos, view(spark, sf, "v_commits"), heads)


# ---- lookups and statistics ----------------------------------------------------------------------


@query
def all_symbols(spark, sf):
    return lookups.all_symbols(view(spark, sf, "v_symbols"), view(spark, sf, "v_files"))


@query
def file_statistics(spark, sf):
    return lookups.file_statistics(view(spark, sf, "v_symbols"), view(spark, sf, "v_files"))


@query
def recent_commits(spark, sf):
    return ranking.recent_commits(view(spark, sf, "v_commits")).select(
        "repo", "rank", "commit_sha", "message", stamp("committed_at").alias("committed_at")
    )


@query
def recent_prs(spark, sf):
    return ranking.recent_prs(view(spark, sf, "v_prs")).select("repo", "rank", "number", "title", "state")


@query
def updated_prs(spark, sf):
    """Pull requests by their last update, which for every third one is after its creation."""
    later = F.when(F.col("number") % 3 == 0, F.expr("created_at + make_dt_interval(number % 400)")).otherwise(F.col("created_at"))
    prs = view(spark, sf, "v_prs").withColumn("updated_at", later)
    return ranking.recent_prs(prs, by="updated_at").select("repo", "rank", "number", "title", stamp("updated_at").alias("updated_at"))


@query
def report_caps(spark, sf):
    symbols, files = view(spark, sf, "v_symbols"), view(spark, sf, "v_files")
    listed = lookups.report_symbols(symbols, files).select(
        "repo", F.lit("symbols").alias("section"), "rank", text_of(F.col("current_path"), ":", F.col("start_line"), ":", F.col("name")).alias("item")
    )
    busy = lookups.report_files(lookups.file_counts(symbols, files)).select(
        "repo", F.lit("files").alias("section"), "rank", text_of(F.col("current_path"), ":", F.col("functions"), ":", F.col("classes")).alias("item")
    )
    return listed.unionByName(busy)


@query
def entity_type_counts(spark, sf):
    spans = javascript.script_entities(v_code(spark, sf, "js")).select("type")
    return lookups.entity_type_counts(spans.unionByName(python_source.python_entities(v_code(spark, sf, "py"), with_text=False).select("type")))


@query
def repo_stats(spark, sf):
    return lookups.repo_stats(
        view(spark, sf, "v_repos"), view(spark, sf, "v_commits"), view(spark, sf, "v_prs"),
        view(spark, sf, "v_files"), view(spark, sf, "v_symbols"),
    )


@query
def names_by_file(spark, sf):
    ranked = lookups.report_symbols(view(spark, sf, "v_symbols"), view(spark, sf, "v_files"))
    return lookups.names_by_file(ranked)


# ---- code entities -------------------------------------------------------------------------------


@query
def code_lines(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("lang").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")
    )
    return javascript.code_lines(files)


@query
def js_functions(spark, sf):
    found = javascript.definitions(v_code(spark, sf, "js")).filter("function_name is not null")
    language = text.language_of(F.col("path"))
    return found.select("repo", "path", language.alias("language"), F.col("function_name").alias("name"), "line_no")


@query
def js_classes(spark, sf):
    found = javascript.definitions(v_code(spark, sf, "js")).filter("class_name is not null")
    return found.select("repo", "path", F.col("class_type").alias("type"), F.col("class_name").alias("name"), "line_no")


@query
def js_block_end(spark, sf):
    return javascript.script_entities(v_code(spark, sf, "js")).select("repo", "path", "type", "name", "start_line", "end_line")


@query
def js_forms(spark, sf):
    """Every definition pattern and label, in files with blocks left open, closed too often, or absent."""
    return javascript.script_entities(v_scripts(spark, sf)).select("repo", "path", "language", "type", "name", "start_line", "end_line", "node_type")


@query
def code_snippet(spark, sf):
    files = stage(v_code(spark, sf, "js"), "code")
    return with_code(javascript.script_entities(files), files).select("path", "name", "start_line", "end_line", "code")


@query
def py_entities(spark, sf):
    return python_source.python_entities(v_code(spark, sf, "py")).select(
        "repo", "path", "type", "name", "start_line", "end_line", "code"
    )


@query
def py_docstrings(spark, sf):
    return python_source.python_entities(v_code(spark, sf, "py", decorated=True)).select(
        "path", "type", "name", "docstring", "start_line", "end_line"
    )


@query
def py_entities_decorated(spark, sf):
    found = python_source.python_entities(
        v_code(spark, sf, "py", decorated=True), include_async=True, include_decorators=True, with_text=False
    )
    return found.select("path", "type", "name", "start_line", "end_line")


@query
def entity_union(spark, sf):
    files = stage(v_code(spark, sf, "js").unionByName(v_code(spark, sf, "py")), "code")
    return extract_entities(files).select(
        "repo", "type", "name", "language", "path", "class_context", "docstring", F.md5("code").alias("code_md5"),
        "start_line", "end_line", "node_type",
    )


@query
def index_pipeline(spark, sf):
    tree = stage(v_code(spark, sf, "js").unionByName(v_code(spark, sf, "py")), "code")
    built = index.index_repositories(tree, view(spark, sf, "v_commits"))
    stamps = built.symbols.select("repo", "commit_sha").distinct()
    return lookups.all_symbols(built.symbols, built.files).join(stamps, "repo")


@query
def index_twice(spark, sf):
    """Three runs into one store: the tree, the same tree again, and a tree with some files changed at other heads."""
    folder = work_dir(spark, "index")
    with scratch(spark, "given"):
        commits, tree = stage(view(spark, sf, "v_commits"), "commits", codec="zstd"), stage(v_code(spark, sf, "py"), "code", codec="zstd")
        changed = F.regexp_extract("path", "order_([0-9]+)", 1).cast("bigint") % 7 == 0
        grown = tree.withColumn("content", F.when(changed, F.concat("content", F.lit("\n    def added(self):\n        return 0"))).otherwise(F.col("content")))
        heads = view(spark, sf, "v_repos").select("repo", F.md5("repo").alias("head_sha"))
        runs = [index.index_into(folder, tree, commits), index.index_into(folder, tree, commits), index.index_into(folder, grown, commits, heads)]
    found = index.read_index(spark, folder)
    symbols = lookups.symbols_with_paths(found.symbols, found.files).select("repo", "commit_sha", "current_path", "kind", "name", "start_line", "end_line")
    for number, run in enumerate(runs, 1):
        done = run.parsed.agg(F.count("*").alias("n")).select(
            F.lit("").alias("repo"), F.lit("").alias("commit_sha"), F.lit("").alias("current_path"), F.lit(f"blobs parsed by run {number}").alias("kind"),
            F.col("n").cast("string").alias("name"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
        symbols = symbols.unionByName(done)
    return symbols


# ---- embeddings and search -----------------------------------------------------------------------


def document_vectors(spark, sf) -> DataFrame:
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return vectors.embed(documents, "text", vectors.hashing_embedder(DIM), DIM)


@query
def embed_documents(spark, sf):
    return (
        document_vectors(spark, sf)
        .select("item_id", F.posexplode("embedding").alias("bucket", "value"))
        .filter("value <> 0")
        .select(F.col("item_id").alias("doc_id"), "bucket", F.col("value").cast("bigint").alias("value"))
    )


@query
def embed_zero_fallback(spark, sf):
    embedder = vectors.hashing_embedder(DIM)

    def refusing(c: Column) -> Column:
        """A model that fails on one source in four, whatever the text."""
        return F.when(F.col("doc_id") % 4 != 3, embedder(c))

    documents = table(spark, sf, "documents").select("doc_id", "text")
    out = vectors.embed(documents, "text", refusing)
    zeros = F.size(F.filter("embedding", lambda x: x == 0))
    return out.select(
        "doc_id", "failed", F.size("embedding").alias("width"), (zeros == F.size("embedding")).alias("all_zero")
    )


def three_collections(spark, sf) -> DataFrame:
    entities = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("code"))
    commits = view(spark, sf, "v_commits").select(F.col("commit_sha").alias("item_id"), "message")
    prs = view(spark, sf, "v_prs").select(
        F.col("number").cast("string").alias("item_id"), F.when(F.col("state") == "open", F.col("title")).alias("title")
    )
    return vectors.embed_collections(entities, commits, prs, vectors.hashing_embedder(64), 64)


@query
def embed_collections(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return (
        three_collections(spark, sf)
        .select("collection", total.cast("bigint").alias("total"), vectors.squared_norm(F.col("embedding")).cast("bigint").alias("norm"))
        .groupBy("collection")
        .agg(F.count("*").alias("items"), F.sum("total").alias("total"), F.sum("norm").alias("norm"))
    )


@query
def embed_summary(spark, sf):
    return vectors.embed_summary(three_collections(spark, sf))


def vector_table(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit("vectors").alias("collection"), F.col("vec_id").cast("string").alias("item_id"), "embedding"
    )


def label_probes(spark, sf) -> DataFrame:
    """One query vector per label: that of its lowest vec_id."""
    return table(spark, sf, "embeddings").groupBy(F.col("label").cast("string").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )


@query
def index_build(spark, sf):
    built = vectors.build_index(vector_table(spark, sf), 64)
    return built.groupBy("collection").agg(
        F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("dim"), F.round(F.sum("squared_norm"), 6).alias("norms")
    )


@query
def knn_exact(spark, sf):
    hits = vectors.knn(vector_table(spark, sf), label_probes(spark, sf), 5)
    return hits.select("query_id", "rank", "item_id", F.round("distance", 6).alias("distance"))


@query
def knn_items(spark, sf):
    hits = vectors.knn(vector_table(spark, sf), label_probes(spark, sf), 5)
    items = vector_table(spark, sf).select("collection", "item_id").join(
        table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), "label"), "item_id"
    )
    return vectors.resolve_hits(hits, items).select("query_id", "rank", "label", F.round("distance", 6).alias("distance"))


def questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


@query
def knn_collections(spark, sf):
    hits = retrieval.search_texts(view(spark, sf, "v_items"), questions(spark, sf), vectors.hashing_embedder(DIM), DIM)
    return hits.select("collection", "query_id", "rank", "item_id", F.round("distance", 6).alias("distance"))


# ---- contexts, reports, prompts ------------------------------------------------------------------


def answered(spark, sf) -> DataFrame:
    return retrieval.retrieve(view(spark, sf, "v_items"), questions(spark, sf), vectors.hashing_embedder(DIM), DIM)


@query
def retrieval_context(spark, sf):
    return answered(spark, sf).select("query_id", "context")


@query
def context_fallback(spark, sf):
    # Every question comes twice, as it is and blank. A blank one has no direction to search in and finds nothing.
    asked = questions(spark, sf)
    blank = asked.select(F.concat(F.lit("blank "), "query_id").alias("query_id"), F.lit(" \t").alias("text"))
    found = retrieval.retrieve(view(spark, sf, "v_items"), asked.unionByName(blank), vectors.hashing_embedder(DIM), DIM)
    shown = context.or_fallback(F.col("context"))
    return found.select("query_id", shown.alias("shown"), (F.col("context") == "").alias("empty"))


@query
def prompts(spark, sf):
    return retrieval.prompts(view(spark, sf, "v_items"), questions(spark, sf), vectors.hashing_embedder(DIM), DIM)


@query
def prompts_stored(spark, sf):
    """The same prompts from vectors that an earlier job stored and indexed; only the questions are embedded."""
    folder, embedder = work_dir(spark, "retrieval"), vectors.hashing_embedder(DIM)
    items = view(spark, sf, "v_items")
    retrieval.index_items(folder, items, embedder, f"words {DIM}", DIM)
    return retrieval.indexed_prompts(retrieval.open_index(spark, folder, DIM), items, questions(spark, sf), embedder, DIM)


def reports_of(spark, sf) -> DataFrame:
    return report.repo_reports(*(view(spark, sf, v) for v in ("v_repos", "v_commits", "v_prs", "v_files", "v_symbols")))


@query
def repo_context(spark, sf):
    contexts = report.repo_contexts(reports_of(spark, sf))
    asked = F.lit("Which files matter most?")
    return contexts.select("repo", "context", context.service_prompt(F.col("repo"), F.col("context"), asked).alias("prompt"))


def _leaves(reports: DataFrame) -> DataFrame:
    """Every list item and count of a report as one text row."""
    def rows(section: str, *fields: str) -> Column:
        return F.transform(
            section,
            lambda s, i: F.struct(
                F.lit(section).alias("section"),
                (i + 1).cast("int").alias("position"),
                F.concat_ws("|", *(stamp(s[f]) if f in ("date", "created_at") else s[f].cast("string") for f in fields)).alias("leaf"),
            ),
        )

    counts = ("commits_count", "prs_count", "functions_count", "classes_count", "files_count")
    head = F.array(
        F.struct(
            F.lit("stats").alias("section"), F.lit(1).alias("position"),
            F.concat_ws("|", *(F.col(f"stats.{c}").cast("string") for c in counts)).alias("leaf"),
        ),
        F.struct(
            F.lit("details").alias("section"), F.lit(1).alias("position"),
            F.concat_ws("|", *(F.col(f"details.{c}").cast("string") for c in ("description", "language", "stars", "forks"))).alias("leaf"),
        ),
    )
    every = F.concat(
        head,
        rows("commits", "sha", "message", "author", "email", "date"),
        rows("prs", "number", "title", "state", "user", "created_at"),
        rows("symbols", "file", "kind", "name", "start_line", "end_line"),
        rows("file_stats", "file", "functions", "classes"),
    )
    return reports.select("repo", *(c for c in ("warning",) if c in reports.columns), F.inline(every))


@query
def repo_report(spark, sf):
    reports = reports_of(spark, sf)
    texts = report.as_json(reports)
    return _leaves(texts.select(F.from_json("report", reports.schema).alias("r")).select("r.*"))


@query
def repo_report_degraded(spark, sf):
    reports = reports_of(spark, sf)
    checked_out = view(spark, sf, "v_repos").filter("description <> ''")
    return _leaves(report.degraded(reports, checked_out))


# ---- streaming -----------------------------------------------------------------------------------


@query
def stream_ingest(spark, sf):
    events = table(spark, sf, "events")
    schema, folder, parts, files = events.schema, work_dir(spark, "stream"), 2, 8
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    cuts = events.select(at.alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.01)
    # Rows without a time come with the last arrival, where dated ones go before them, as in SQL.
    number = F.when(at.isNull(), parts - 1).otherwise(reduce(lambda n, cut: n + (at >= cut).cast("int"), cuts, F.lit(0)))
    # A user's events of one arrival lie in one file, so it makes no difference which of its files are read first.
    for arrival in range(parts):
        events.where(number == arrival).repartition(files, "user_id").write.mode("append").parquet(f"{folder}/in")
    stream = ingest.stream_files(spark, f"{folder}/in", schema, files_per_batch=files)
    ingest.ingest(stream, f"{folder}/table", f"{folder}/checkpoint", ["user_id"], ["ts", "event_id"]).awaitTermination()
    stored = ingest.read_ingested(spark, f"{folder}/table", schema)
    return stored.select("user_id", "event_id", "event_type", "value")
