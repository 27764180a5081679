from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row", "t", "size", "rank", "members", "part", "pos", "tie", "at", "n_words", "kept", "spans", "node", "keys",
            "label", "score", "shard", "copies", "length", "bucket", "base", "g", "u", "of", "h", "id", "n", "comp", "spelling")


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and ids, and columns named like working ones."""
    rng = random.Random(4)
    words = "the of and to in is that for with on river stone cloud paper green walks over under seven lamp".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 120))), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), 3) for i in range(60)]
    rows += [(100, None, "en", "a", None), (101, "", None, "b", 0), (102, " \n\t ", "en", None, 3), (None, None, None, None, None), (None, "no id here", "en", "a", 10),
             (103, "word " * 30_000, "en", "a", 150_000), (104, "x" * 200_000, "en", "b", 200_000), (105, "!!! ???", "en", "b", 7)]
    rows += [rows[3]] * 5 + [(110 + i, rows[4][1], "en", "a", 9) for i in range(6)] + [(3, "another text for the same id", "en", "b", 28)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(-1) for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
