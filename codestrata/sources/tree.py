"""Checked-out source trees as (repo, path, content)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import SKIPPED_SEGMENTS
from codestrata.session import stage

_LISTED = ("repo", "path", "folder", "is_folder", "task")
_KINDS = {"valid_utf8": pa.bool_(), "is_folder": pa.bool_(), "task": pa.int32()}
_BATCH_BYTES = 32 * 1024 * 1024
#: Entries from which on a task that lists folders leaves the folders inside them to other tasks.
_GLANCE = 1_000


def read_tree(
    spark: SparkSession,
    root: str,
    repo: str | None = None,
    wanted: Callable[[Column], Column] | None = None,
    prune: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Every file of the checked-out repositories under `root`: repo, path, content, valid_utf8.

    The first folder level names the repository, unless `root` is itself the tree of `repo`.
    Undecodable bytes are dropped and flagged; line ends become `\\n`. A file that cannot be read has a
    null content and a null flag. Links to folders are not followed. `wanted` tests the relative
    path before anything is read, `prune` leaves out hidden and dependency folders unvisited.

    Spark's own file sources skip names that start with `_` or `.`, and with them every
    `__init__.py`, so the tree is walked in tasks (`list_tree`), and the files are then spread over
    `tasks` tasks by path, so a large repository is read by all of them.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = list_tree(spark, root, repo, prune, tasks).select("repo", "path", "folder")
    if wanted is not None:
        files = files.filter(wanted(F.col("path")))
    return files.repartition(tasks, "repo", "path").mapInArrow(
        _read_files, "repo string, path string, content string, valid_utf8 boolean"
    )


def list_tree(spark: SparkSession, root: str, repo: str | None = None, prune: bool = True, tasks: int | None = None) -> DataFrame:
    """repo, path, folder (the repository's) and task of every file under `root`, without reading any.

    Round by round: the folders found in one are dealt over `tasks` tasks in the next, each round staged, until one finds none. So the
    folders of one large repository are listed by many tasks, and a lost executor costs a part of a round. A task goes on into the
    folders it finds while they are fewer than `tasks` and it has met few entries, so that a small tree does not take a round a level.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "repo string, path string, folder string, is_folder boolean, task int"
    start = spark.createDataFrame([(repo, "", root)], "repo string, path string, folder string")
    levels, frontier = [], start
    while True:
        dealt = frontier.repartition(tasks, "repo", "path") if levels else frontier
        level = stage(dealt.select("repo", "path", "folder").mapInArrow(_lister(prune, tasks), schema), "tree-level")
        levels.append(level.filter("not is_folder"))
        frontier = level.filter("is_folder")
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels).drop("is_folder")


def _lister(prune: bool, tasks: int):
    def list_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found, met, task = [], 0, TaskContext.get().partitionId()
        level, given = _values(batches), True
        while level:
            deeper = []
            for repo, path, folder in level:
                if not given and met >= _GLANCE:
                    found.append((repo, path, folder, True, task))
                    continue
                system, base = fs.FileSystem.from_uri(folder)
                here = f"{base}/{path}" if path else base
                for info in system.get_file_info(fs.FileSelector(here, allow_not_found=bool(path))):
                    met += 1
                    inner, inside = f"{path}/{info.base_name}" if path else info.base_name, None
                    if info.type == fs.FileType.File and repo is not None:
                        found.append((repo, inner, folder, False, task))
                    elif info.type == fs.FileType.Directory and not _is_link(system, info.path):
                        if repo is None:  # the folders of the root are repositories, whatever their names
                            inside = info.base_name, "", f"{folder.rstrip('/')}/{info.base_name}"
                        elif not (prune and (info.base_name.startswith(".") or info.base_name in SKIPPED_SEGMENTS)):
                            inside = repo, inner, folder
                    if inside and met < _GLANCE:
                        deeper.append(inside)
                    elif inside:
                        found.append((*inside, True, task))
                    if len(found) >= 10_000:
                        yield _batch(found, *_LISTED)
                        found = []
            level, given = deeper if len(deeper) < tasks else [], False
            found += [(*inside, True, task) for inside in deeper if not level]
        yield _batch(found, *_LISTED)
    return list_level


def _is_link(system: fs.FileSystem, path: str) -> bool:
    """Links to folders are not followed: they may lead back up, or out of the tree."""
    return system.type_name == "local" and os.path.islink(path)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, read, size = ("repo", "path", "content", "valid_utf8"), [], 0
    for repo, path, folder in _values(batches):
        system, base = fs.FileSystem.from_uri(folder)
        try:
            with system.open_input_stream(f"{base}/{path}") as stream:
                raw = stream.read()
        except OSError:
            read.append((repo, path, None, None))
            continue
        text = raw.decode("utf-8", "ignore")
        # Dropped bytes are missing when the text is encoded again.
        valid = len(text.encode()) == len(raw)
        read.append((repo, path, text.replace("\r\n", "\n").replace("\r", "\n"), valid))
        size += len(raw)
        if size > _BATCH_BYTES:
            yield _batch(read, *names)
            read, size = [], 0
    yield _batch(read, *names)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    kinds = [_KINDS.get(name, pa.string()) for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=list(names))
