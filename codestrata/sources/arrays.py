"""One large JSON array read by several tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.session import broadcast_if_small, stage

_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = 34, 92, 44, 91, 93
_STEP = np.zeros(256, np.int64)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1
_STATES = [(quoted, escaped) for quoted in (0, 1) for escaped in (0, 1)]


def _opened(path: str):
    """An open file of a Hadoop path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(name)


def marks(data: np.ndarray, quoted: int, escaped: int) -> tuple[np.ndarray, int, int]:
    """Places of brackets, braces and commas outside strings, and the state after the bytes.

    `quoted` says whether the bytes begin in a string, `escaped` whether an odd number of backslashes comes right before them.
    """
    n = len(data)
    plain = np.maximum.accumulate(np.where(data == _BACKSLASH, -1, np.arange(n))) if n else np.zeros(0, np.int64)
    quotes = np.flatnonzero(data == _QUOTE)
    last = np.where(quotes > 0, plain[quotes - 1], -1)
    slashes = quotes - 1 - last + np.where(last < 0, escaped, 0)
    quotes = quotes[slashes % 2 == 0]
    signs = np.flatnonzero((_STEP[data] != 0) | (data == _COMMA))
    outside = signs[(np.searchsorted(quotes, signs) + quoted) % 2 == 0]
    trailing = (n - 1 - plain[-1] + (escaped if plain[-1] < 0 else 0)) % 2 if n else escaped
    return outside, (quoted + len(quotes)) % 2, int(trailing)


def _ranges(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for file, start, stop in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            with _opened(file) as source:
                source.seek(start)
                yield file, start, stop, np.frombuffer(source.read(stop - start), np.uint8)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range does to each state it may begin in: (quoted, escaped, change of depth) a state."""
    for file, start, stop, data in _ranges(batches):
        effects = []
        for quoted, escaped in _STATES:
            outside, out_quoted, out_escaped = marks(data, quoted, escaped)
            effects += [out_quoted, out_escaped, int(_STEP[data[outside]].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([stop], pa.int64()), pa.array([effects], pa.list_(pa.int64()))],
                                         names=["file", "start", "stop", "effects"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each range begins in, from its file's ranges in order, and whether the file ends as it began."""
    for batch in batches:
        for file, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            quoted = escaped = depth = 0
            rows = []
            for part in parts:
                rows.append((file, part["start"], part["stop"], quoted, escaped, depth))
                k = 3 * _STATES.index((quoted, escaped))
                quoted, escaped, change = part["effects"][k : k + 3]
                depth += change
            whole = not (quoted or escaped or depth)
            yield pa.RecordBatch.from_arrays([
                *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *[pa.int64()] * 5], strict=True)), pa.array([whole] * len(rows))],
                names=["file", "start", "stop", "quoted", "escaped", "depth", "whole"])


def _records(more: int):
    """The text of every element that begins in a range; one that goes on is read on."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["file"]) as source:
                    size = source.size()
                    source.seek(row["start"])
                    data = np.frombuffer(source.read(row["stop"] - row["start"]), np.uint8)
                    quoted, escaped, depth, at = row["quoted"], row["escaped"], row["depth"], row["stop"]
                    outside, quoted, escaped = marks(data, quoted, escaped)
                    steps = _STEP[data[outside]]
                    after = depth + np.cumsum(steps)
                    depth = int(after[-1]) if len(after) else depth
                    begins = ((data[outside] == _OPEN) & (after == 1)) | ((data[outside] == _COMMA) & (after == 1))
                    ends = ((data[outside] == _COMMA) & (after == 1)) | ((steps < 0) & (after == 0))
                    first, last = outside[begins] + 1, outside[ends]
                    texts = []
                    raw = data.tobytes()
                    stops = np.searchsorted(last, first)
                    for begin, k in zip(first.tolist(), stops.tolist(), strict=True):
                        if k < len(last):
                            texts.append(raw[begin : int(last[k])])
                            continue
                        pieces = [raw[begin:]]
                        while at < size:
                            source.seek(at)
                            data = np.frombuffer(source.read(min(more, size - at)), np.uint8)
                            at += len(data)
                            outside, quoted, escaped = marks(data, quoted, escaped)
                            steps = _STEP[data[outside]]
                            after = depth + np.cumsum(steps)
                            depth = int(after[-1]) if len(after) else depth
                            over = outside[((data[outside] == _COMMA) & (after == 1)) | ((steps < 0) & (after == 0))]
                            if len(over):
                                pieces.append(data[: int(over[0])].tobytes())
                                break
                            pieces.append(data.tobytes())
                        texts.append(b"".join(pieces))
                values = [t.decode("utf-8", "replace").strip() for t in texts]
                values = [v for v in values if v]
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(values), pa.string()), pa.array(values, pa.string())], names=["file", "value"])
    return records


def read_array(spark: SparkSession, path: str, schema: T.StructType, split_bytes: int = 16 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of files that each hold a JSON array, as `landed.read_json`, but a file is read by many tasks.

    Files are dealt in ranges of `split_bytes`. A range says what it does to whatever state it may begin in, inside or outside a
    string, after a backslash or not, and by how much the depth changes; these effects, one small row a range, are
    composed in the order of the file, so each range then knows where it begins and cuts the elements that start in it. An
    element belongs to the range of the comma or bracket before it, and is read beyond the range's end where it goes on.

    A file whose brackets or quotes do not close, or that is no array, goes to the quarantine (file, value null); an element that does not
    parse, or of which no field can be read, goes there with its text. A missing path is an error; empty files give nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").filter("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.select(F.col("path").alias("file"), F.explode(starts).alias("start"), "length")
    ranges = stage(ranges.select("file", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("stop")), "ranges")
    tasks = max(1, ranges.count())
    dealt = ranges.repartition(tasks, "file", "start")
    effects = stage(dealt.mapInArrow(_summarise, "file string, start long, stop long, effects array<long>"), "effects")
    in_order = effects.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "effects"))).alias("parts"))
    begun = stage(in_order.mapInArrow(_compose, "file string, start long, stop long, quoted long, escaped long, depth long, whole boolean"), "begun")
    values = begun.filter("whole").repartition(tasks, "file", "start").mapInArrow(_records(min(split_bytes, 1 << 20)), "file string, value string")
    bad = "_corrupt_record"
    read = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    options = {"columnNameOfCorruptRecord": bad, "maxStringLen": str(2**31 - 1)}
    values = stage(values, "elements").withColumn("d", F.from_json("value", read, options))
    unread = F.col("d").isNull() | F.col(f"d.{bad}").isNotNull()
    nothing = F.lit(True)
    for name in schema.fieldNames():
        nothing = nothing & F.col(f"d.{name}").isNull()
    unread = unread & nothing
    with_rows = values.select("file").distinct()
    broken = begun.filter("not whole").select("file").distinct()
    # A file without elements is an empty array, or text that is none.
    bare = begun.filter("whole").select("file").distinct().join(broadcast_if_small(with_rows), "file", "left_anti")
    bare = bare.mapInArrow(_not_arrays, "file string")
    quarantine = values.filter(unread).select("file", "value").unionByName(
        broken.unionByName(bare).select("file", F.lit(None).cast("string").alias("value")))
    return values.filter(~unread).select("d.*").select(*schema.fieldNames()), quarantine


def _not_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files that do not begin with a bracket; a file of blanks is empty."""
    for batch in batches:
        out = []
        for file in batch.column(0).to_pylist():
            with _opened(file) as source:
                head = source.read(1 << 16).decode("utf-8", "replace").strip()
            if head and not head.startswith("["):
                out.append(file)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["file"])
