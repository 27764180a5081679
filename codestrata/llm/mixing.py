"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.ordering import carried, ranked
from codestrata.session import stage

WEIGHTS = (5, 2, 1)
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def _random(seed: int, *of: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the arguments alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and target, staged, from one row (source, source_size) a source.

    Sources by code point, null last, take `weights` in turn. Together they get `share` times all sizes, by
    weight; a target stops at `most` times its source's size, and what is over goes to the others by weight
    until none is above. The sources stay distributed; each round brings back two sums.
    """
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("unnamed"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stage(ranked(named, ["unnamed", "source"]).select(
        "source", "source_size", turn.cast("double").alias("weight"), (F.col("source_size") * most).alias("top")), "weights")
    whole = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    full, level, count = F.lit(False), 0.0, -1
    while True:
        free, held, now = table.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("top"))), F.count_if(full)).first()
        if not free or now == count:
            break
        level, count = max(0.0, whole - (held or 0.0)) / free, now
        full = F.col("weight") * level > F.col("top")
    return stage(table.select("source", "source_size", F.when(full, F.col("top")).otherwise(F.col("weight") * level).alias("target")), "targets")


def log_size(size: Column) -> Column:
    """A weight that grows with the logarithm of a document's words: long documents are favoured, but not in proportion."""
    return F.log1p(size.cast("double")) + 1


def _rates(narrow: DataFrame, aims: DataFrame, most: float) -> DataFrame:
    """of, source_size, target, rate and sure_all, staged: a document's mean copies are its wish times the rate, `most` at most.

    The rate is raised, in rounds of one sum a source, until what documents at the bound leave to the others brings the
    source to its target. Where the target is `most` times the source, or nothing is left, every document is at the bound.
    """
    start = narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("wish")).alias("wished"))
    rates = aims.join(start, F.col("of").eqNullSafe(F.col("source"))).select(
        "of", "source_size", "target", (F.col("target") >= most * F.col("source_size") - 1e-9).alias("full"),
        F.when(F.col("wished") > 0, F.col("target") / F.col("wished")).otherwise(0.0).alias("rate"))
    rates = stage(rates, "rates")
    while True:
        met = narrow.join(rates.where("not full and rate > 0"), F.col("source").eqNullSafe(F.col("of")))
        at_bound = F.col("rate") * F.col("wish") >= most
        sums = met.groupBy("of").agg(F.sum(F.when(at_bound, F.col("size") * most)).alias("held"), F.sum(F.when(~at_bound, F.col("size") * F.col("wish"))).alias("free"))
        sums = sums.select(F.col("of").alias("s_of"), (F.coalesce("held", F.lit(0.0))).alias("held"), F.coalesce("free", F.lit(0.0)).alias("free"))
        raised = rates.join(sums, F.col("of").eqNullSafe(F.col("s_of")) & ~F.col("full"), "left")
        new = F.when(F.col("free") > 0, F.greatest(F.col("rate"), (F.col("target") - F.col("held")) / F.col("free"))).otherwise(F.col("rate"))
        raised = stage(raised.select("of", "source_size", "target", "full", F.col("rate").alias("was"), new.alias("rate")), "rates")
        if not raised.where("rate > was * (1 + 1e-9)").limit(1).count():
            return raised.drop("was")
        rates = raised.drop("was")


def sampled(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text: str = "text", source: str = "source",
            weight: str | Callable[[Column], Column] | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`row` (the whole input row) with doc_id, source, size, source_size, target, copies and taken.

    A document is to come m = target / source size times on average, or in proportion to its `weight`, a
    column or a function of its size such as `log_size`, at most `most` times (`_rates`). It gets floor(m) copies for certain and one more with probability
    p = m - floor(m), by Pareto order sampling: scores u / (1 - u) * (1 - p) / p are sorted within the source
    and the lowest are taken, as many as bring the source's words nearest to its target. Only narrow rows
    are sorted, and only each source's last taken score comes back, so no source is gathered anywhere and
    the texts move nowhere. u depends on `seed`, id and text alone: reruns agree.

    A null text has size 0 and is never short of words; null sources are one source; a null or not positive
    weight counts as 0. Rows equal in id, source and text are taken or left together. An empty table gives
    no rows. Clashing columns stay inside `row`.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    wish = F.col(f"`{weight}`").cast("double") if isinstance(weight, str) else F.lit(1.0)
    facts = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(body).alias("size"),
             _random(seed, F.col(f"`{id_col}`"), body).alias("u"), F.greatest(F.coalesce(wish, F.lit(0.0)), F.lit(0.0)).alias("wish")]

    def measured(rows: DataFrame, *more: Column) -> DataFrame:
        known = rows.select(*more, *facts)
        return known.withColumn("wish", weight(F.col("size"))) if callable(weight) else known

    narrow = stage(measured(docs), "sizes")
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = _rates(narrow, targets(sums, share, most, weights).withColumnRenamed("source", "of"), most)

    def scored(rows: DataFrame) -> DataFrame:
        mean = F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.col("rate") * F.col("wish"), F.lit(float(most))))
        part = F.col("mean") - F.col("certain")
        return (rows.withColumn("mean", mean).withColumn("certain", F.floor("mean"))
                .withColumn("score", F.when(part > 0, F.col("u") / (1 - F.col("u")) * (1 - part) / part)).drop("mean"))

    known = scored(narrow.join(rates, F.col("source").eqNullSafe(F.col("of"))))
    open_rows = known.where("score is not null").select("source", "score", "u", "doc_id", "size")
    sure = known.groupBy("of").agg(F.first("target").alias("aim"), F.sum(F.col("certain") * F.col("size")).alias("sure"))
    run = ranked(open_rows, ["source", "score", "u", "doc_id", "size"], group="source", value="size")
    cuts = run.join(sure, F.col("source").eqNullSafe(F.col("of"))).where(F.col("before") + F.col("size") / 2 <= F.col("aim") - F.col("sure"))
    cuts = cuts.groupBy("of").agg(F.max("score").alias("cut")).withColumnRenamed("of", "cut_of")
    plan = stage(rates.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of"), "mixture")
    copies = F.col("certain") + F.coalesce((F.col("score") <= F.col("cut")).cast("int"), F.lit(0))
    out = scored(measured(docs, carried(docs)).join(plan, F.col("source").eqNullSafe(F.col("of"))))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"),
                      (copies * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture with their columns as they were, each as often as it was taken."""
    return sampled(docs, **options).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
