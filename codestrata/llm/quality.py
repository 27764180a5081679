"""Quality rules: a threshold table compiled into one projection of text measures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.ordering import carried

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of the languages the rules are meant for; a parameter of `measured`.
STOP_WORDS = (
    "the of and to in is that for it with as was on are by be this from at or an he not have",
    "le la les de des du et un une est en que qui dans pour pas sur par il elle au",
    "der die das und ist in den von zu mit sich des auf ein eine nicht dem es als auch im",
    "el la los las de del y en un una que es por con para no se al lo su como",
)


@dataclass(frozen=True)
class Rule:
    """`low` <= measure / per <= `high`; an open bound is None, and a share of nothing is 0.

    `grant` occurrences are let pass either way, so that a share of a few words or lines is not held against a text.
    """

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    grant: int = 0

    def passed(self) -> Column:
        def share(granted: int) -> Column:
            value = F.col(self.measure).cast("double") + granted
            return F.when(F.col(self.per) > 0, value / F.col(self.per)).otherwise(0.0) if self.per else value

        checks = [share(self.grant) >= self.low] if self.low is not None else []
        checks += [share(-self.grant) <= self.high] if self.high is not None else []
        return reduce(and_, checks, F.lit(True))


#: Texts that fail one of these are rejected whatever the other rules say.
BASE_RULES = (
    Rule("length", "n_words", low=10),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.2),
)
#: The verdict on the rest.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04, grant=1),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.3, grant=1),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=0.3),
)


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: neighbours in (hash, place) order find them."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s):
        again = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(again, lambda x: x.isNotNull()))

    def union(p):
        steps = F.transform(p, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return _let(placed, lambda s: _let(places(s), union))


def measured(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """`row` (the whole input row) beside the measures of its text; no shuffle, no user functions.

    Words are runs without ASCII white space, lines are cut at line feeds. A null text is empty. Rows are
    independent: repeated rows, ties and an empty table need no care, and columns named like a measure stay
    untouched inside `row`. `n_repeat_words` counts the words covered by five-word windows that occur at
    least twice; windows are compared by a 64-bit hash within one text. It takes time n log n at most, and
    texts without a repeated window, which are most, only a linear pass.
    """
    stops = sorted({w for line in stop_words for w in line.split()})
    blank = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(carried(docs), blank.alias("t"))
    words = texts.select(
        "row", "t",
        F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = words.select(
        "row", "words",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_cut_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stops))).alias("n_stop_words"),
        F.when(F.size("words") >= WINDOW, F.transform(
            F.slice("words", F.lit(1), F.size("words") - (WINDOW - 1)),
            lambda w, i: F.xxhash64(w, *(F.get(F.col("words"), i + k) for k in range(1, WINDOW))),
        )).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    names = [c for c in counted.columns if c not in ("row", "words", "windows")]
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(0)
    # A generated row: filters on the measures stay above it and do not compute them a second time.
    measures = F.struct(*(F.col(c).cast("long").alias(c) for c in names), repeated.cast("long").alias("n_repeat_words"))
    return counted.select("row", F.inline(F.array(measures)))


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, **options) -> DataFrame:
    """`measured` with `base_failed`, `kept`, and `failed`: the names of all rules that the text fails."""
    fails = F.array_compact(F.array(*(F.when(~r.passed(), F.lit(r.name)) for r in (*base, *rules))))
    return measured(docs, text, **options).withColumns({
        "base_failed": ~reduce(and_, (r.passed() for r in base), F.lit(True)),
        "failed": fails,
        "kept": F.size(fails) == 0,
    })


def keep_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose text passes all rules, with their columns as they were."""
    return judged(docs, text, **options).where("kept").select("row.*")
