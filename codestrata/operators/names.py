"""Substring search over symbol names by trigram postings."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import ascii_lower, contains_like, fold
from codestrata.operators.lookups import SYMBOL_ORDER, symbols_with_paths
from codestrata.session import broadcast_if_small, stage

GRAM = 3


class NameIndex(NamedTuple):
    """The distinct `names` (name), and `postings` (gram, name): which names hold three letters in a row, A-Z folded."""

    names: DataFrame
    postings: DataFrame


def name_index(symbols: DataFrame) -> NameIndex:
    """The index of all names in `symbols`, staged. A name is in it once, however many symbols have it."""
    names = stage(symbols.select("name").filter("name is not null").distinct(), "names")
    folded = ascii_lower(F.col("name"))
    starts = F.when(F.length("name") >= GRAM, F.sequence(F.lit(1), F.length("name") - (GRAM - 1)))
    grams = F.array_distinct(F.transform(starts, lambda at: F.substring(folded, at, F.lit(GRAM))))
    return NameIndex(names, stage(names.select(F.explode(grams).alias("gram"), "name"), "postings"))


def pattern_grams(pattern: str) -> set[str]:
    """The trigrams that every match holds: those of the pieces between wildcards."""
    return {piece[i : i + GRAM] for piece in re.split("[%_]", fold(pattern)) for i in range(len(piece) - GRAM + 1)}


def matching_names(index: NameIndex, patterns: list[str]) -> DataFrame:
    """(pattern, name) of the names that contain a pattern, with the wildcards of `contains_like`.

    A pattern's trigrams meet their postings in one join for all patterns; names that hold all of them are verified. Patterns
    without a trigram are tried on every distinct name, all in one pass. Only the given patterns are broadcast.
    """
    spark = index.names.sparkSession
    patterns = sorted(set(patterns))
    needed = [(p, gram, len(pattern_grams(p))) for p in patterns for gram in sorted(pattern_grams(p))]
    asked = spark.createDataFrame(needed, "pattern string, gram string, needed int")
    held = index.postings.join(F.broadcast(asked), "gram").groupBy("pattern", "needed", "name").agg(F.count("*").alias("held"))
    candidates = held.filter(F.col("held") == F.col("needed")).select("pattern", "name")
    short = [p for p in patterns if not pattern_grams(p)]
    if short:
        every = F.explode(F.array(*map(F.lit, short))).alias("pattern")
        candidates = candidates.unionByName(index.names.select(every, "name"))
    escape = next(chr(n) for n in range(1, 0x10000) if not any(chr(n) in fold(p) + "%_" for p in patterns))
    like = F.concat(F.lit("%"), ascii_lower(F.col("pattern")), F.lit("%"))
    return candidates.filter(F.like(ascii_lower(F.col("name")), like, F.lit(escape)))


def search_symbols(symbols: DataFrame, files: DataFrame, patterns: list[str], index: NameIndex | None = None) -> DataFrame:
    """Symbols whose name contains one of the patterns, once a pattern, by pattern and path.

    With an index the names are searched there, and the symbol table is scanned once for the names found; without one the
    symbol table is scanned once and every row tried against all patterns.
    """
    if index is None:
        tried = F.array(*(F.when(contains_like(F.col("name"), p), F.lit(p)) for p in sorted(set(patterns)))).cast("array<string>")
        hits = symbols.withColumn("pattern", F.explode(F.array_compact(tried)))
    else:
        hits = symbols.join(broadcast_if_small(stage(matching_names(index, patterns), "names-found")), "name")
    listed = symbols_with_paths(hits, files).orderBy("pattern", "repo", *SYMBOL_ORDER)
    return listed.select("repo", "current_path", "kind", "name", "start_line", "end_line", "pattern")
