"""Personal data and the terms that give it away: patterns, then information-theoretic sanitisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.ordering import carried
from codestrata.session import stage

# Fixed patterns of the kinds. Possessive runs and the look-behinds keep the time linear and the matches as they are:
# a local part or a number is tried once, at its first character or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the kind.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
TERM = "term"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]"}

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"\p{L}[\p{L}\p{M}]*+"
_SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"
_RUN = 256
_CHUNK = 4096


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _top(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0).cast("bigint"))


def _before(values: Column, whole) -> Column:
    """For each element, `whole` (a sum or a maximum) of those before it; runs of fixed length keep it near linear."""
    def runs(v):
        parts = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(_RUN)), lambda at: F.slice(v, at, F.lit(_RUN)))
        return _let(parts, lambda p: _let(F.transform(p, whole), lambda heads: F.flatten(F.transform(p, lambda run, k: _let(
            whole(F.slice(heads, F.lit(1), k)),
            lambda head: F.transform(run, lambda _, i: whole(F.concat(F.array(head), F.slice(run, F.lit(1), i)))))))))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_let(values, runs))


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: Column | str, kind: str, holds=None) -> Column:
    """All matches as kind, start, end (code points, end exclusive) and value, less those that do not hold.

    The pieces between the matches tell their places: each start is the length of all that precedes.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def spans(values):
        def placed(pieces):
            steps = F.transform(values, lambda v, i: (F.length(F.get(pieces, i)) + F.length(v)).cast("bigint"))
            return _let(_before(steps, _sum), lambda at: F.transform(values, lambda v, i: F.struct(
                F.lit(kind).alias("kind"),
                (F.get(at, i) + F.length(F.get(pieces, i))).alias("start"),
                (F.get(at, i) + F.length(F.get(pieces, i)) + F.length(v)).alias("end"),
                v.alias("value"))))
        found = _let(F.split(text, pattern, -1), placed)
        return F.when(F.size(values) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(
            F.filter(found, lambda s: holds(s["value"])) if holds else found)

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)


def base_spans(text: Column) -> Column:
    """E-mail, IP, card and phone spans of a text, by kind, then start."""
    none = F.array().cast(f"array<{_SPAN}>")
    return F.concat(*(
        F.when(text.rlike(NEEDED[kind]), matches(text, PATTERNS[kind], kind, lambda v, k=kind: _holds(k, v))).otherwise(none)
        for kind in KINDS))


def _entity(span: Column) -> Column:
    """The protected value behind a span, however it is written."""
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _masked(text: Column) -> Column:
    """The text with its e-mail addresses blanked, at the same length."""
    def join(values):
        pieces = F.split(text, PATTERNS["email"], -1)
        blanks = F.concat(F.transform(values, lambda v: F.repeat(F.lit(" "), F.length(v))), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, blanks, lambda p, b: F.concat(p, b)), "")
    return F.when(text.contains("@"), _let(F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)), join)).otherwise(text)


def _chunks(text: Column) -> Column:
    """The text in runs of `_CHUNK` code points, from which `_cut` takes parts in near constant time."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of the chunked text."""
    first = F.floor(a / _CHUNK).cast("int")
    count = F.floor((b + _CHUNK - 1) / _CHUNK).cast("int") - first
    return F.when(b > a, F.substring(F.array_join(F.slice(chunks, first + 1, count), ""), (a - first * _CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise("")


def _surrounded(masked: Column, spans: Column, reach: int) -> Column:
    """entity and near of each span: the `reach` words of the masked text that end before it, and those that begin after.

    Neither holds a span a word nor does a word cross its start. So the text is cut at the starts, the words of the
    parts in turn are those of the text, and their number before a start tells the nearest on both sides.
    """
    def build(ordered, chunks):
        starts = F.transform(ordered, lambda s: s["start"])
        edges = F.concat(F.array(F.lit(0).cast("bigint")), starts)
        ends = F.concat(starts, F.array(F.length(masked).cast("bigint")))
        parts = F.zip_with(edges, ends, lambda a, b: F.regexp_extract_all(F.lower(_cut(chunks, a, b)), F.lit(_WORD), F.lit(0)))
        return _let(parts, lambda w: _let(_before(F.transform(w, lambda x: F.size(x).cast("bigint")), _sum), lambda passed: _let(
            F.flatten(w), lambda words: F.transform(ordered, lambda s, i: near(F.get(passed, i + 1).cast("int"), words, s)))))

    def near(at, words, s):
        first = F.greatest(at - reach, F.lit(0))
        return F.struct(_entity(s).alias("entity"), F.slice(words, first + 1, at - first + reach).alias("near"))

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return _let(ordered, lambda s: _let(_chunks(masked), lambda chunks: build(s, chunks)))


def _contexts(rows: DataFrame, reach: int) -> DataFrame:
    """doc, entity, terms and context of each span: the nearest words of the whole text on either side, e-mail addresses apart."""
    held = rows.select("doc", "t", F.inline(F.array(F.struct(base_spans(F.col("t")).alias("base"))))).where(F.size("base") > 0)
    each = held.select("doc", F.inline(_let(_masked(F.col("t")), lambda m: _surrounded(m, F.col("base"), reach))))
    return each.select("doc", "entity", F.array_distinct("near").alias("terms"), F.xxhash64("near").alias("context"))


def disclosing(docs: DataFrame, text: str = "text", reach: int = 8, disclosure: float = 0.8, contexts: int = 3) -> DataFrame:
    """entity and term, staged: the terms that reveal a protected value too strongly.

    An entity is one personal value of the base kinds. Over all documents, n(e), n(t) and n(e, t) count those
    that hold the entity, the term, and the term within `reach` words of the entity. With N documents the term's
    information about the entity is PMI = log2(N n(e, t) / (n(e) n(t))); it discloses the entity where PMI is at
    least `disclosure` times the entity's own information log2(N / n(e)). Pairs seen in fewer than `contexts`
    different surroundings are chance, or copies of one text, and do not count. Pairs grow with the
    spans, not with the square of anything; a hot entity is counted by partial aggregates.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.monotonically_increasing_id().alias("doc"), body.alias("t"))
    holding = _contexts(texts, reach)
    spark = docs.sparkSession
    near = stage(holding, "contexts")
    pairs = near.select("entity", "doc", "context", F.explode("terms").alias("term"))
    seen = pairs.groupBy("entity", "term").agg(F.count_distinct("context").alias("n_contexts"), F.count_distinct("doc").alias("both"))
    frequent = stage(seen.where(F.col("n_contexts") >= contexts), "frequent-pairs")
    if frequent.isEmpty():
        return spark.createDataFrame([], "entity string, term string")
    whole = texts.count()
    entities = near.groupBy("entity").agg(F.count_distinct("doc").alias("with_entity"))
    around = pairs.groupBy("term").agg(F.count_distinct("doc").alias("around"))
    information = F.log2(F.lit(float(whole)) / F.col("with_entity"))

    def disclosed(held):
        told = F.log2(F.lit(float(whole)) * F.col("both") / (F.col("with_entity") * F.col(held)))
        return (information > 0) & (told >= disclosure * information)

    # A term is in no fewer documents than it is near some entity in: frequent words fall here and are not looked for.
    rated = stage(frequent.join(entities, "entity").join(around, "term").where(disclosed("around")), "candidates")
    if rated.isEmpty():
        return spark.createDataFrame([], "entity string, term string")
    # Counted for all words: a sum a task and word, instead of a row for each place of a candidate.
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_WORD), F.lit(0)))).alias("term"))
    held = words.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    return stage(rated.join(held, "term").where(disclosed("with_term")).select("entity", "term"), "disclosing")


def found(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """`row` (the whole input row) and `spans`: kind, start, end, value; base kinds first, then terms, each by start.

    A term that discloses an entity is marked wherever it stands in a text that holds the entity, except inside
    an e-mail address. A null text is empty. Rows are independent, equal texts get equal spans; an empty
    table gives no rows. Clashing columns stay inside `row`. Only DataFrame operations are used; without
    disclosing terms the texts are not shuffled.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(carried(docs), body.alias("t")).select("row", "t", F.inline(F.array(F.struct(base_spans(F.col("t")).alias("base")))))
    flagged = disclosing(docs, text, **options)
    if flagged.isEmpty():
        return base.select("row", F.col("base").alias("spans"))
    plain = base.where(F.size("base") == 0).select("row", F.col("base").alias("spans"))
    holding = base.where(F.size("base") > 0).select("row", "t", "base", F.md5("t").alias("key"))
    values = holding.select("key", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")).distinct()
    terms = values.join(flagged, "entity").groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    joined = holding.join(terms.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").select(
        "row", "t", "base", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    either = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{M}])"))
    marked = F.when(F.size("terms") > 0, _let(_masked(F.col("t")), lambda m: matches(m, either, TERM))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return plain.unionByName(joined.select("row", F.concat("base", marked).alias("spans")))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's label; overlapping spans share the first one's."""
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))

    def build(s):
        ends = F.transform(s, lambda x: x["end"])

        def assemble(done, chunks):
            parts = F.transform(s, lambda x, i: F.when(
                x["start"] >= F.get(done, i), F.concat(_cut(chunks, F.get(done, i), x["start"]), label[x["kind"]])).otherwise(""))
            return F.concat(F.array_join(parts, ""), _cut(chunks, _top(ends), F.length(text).cast("bigint")))

        return _let(_before(ends, _top), lambda done: _let(
            _chunks(text), lambda chunks: assemble(done, chunks)))

    by_place = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                            .when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    return F.when(F.size(spans) == 0, text).otherwise(_let(by_place, build))


def sanitise(docs: DataFrame, text: str = "text", length: str | None = None, **options) -> DataFrame:
    """The rows with their columns as they were, but for the sanitised text and, given `length`, its new length.

    A null text stays null; a text without spans stays as it is.
    """
    clean = found(docs, text, **options).select("row", F.when(F.col(f"row.`{text}`").isNotNull(), sanitised(F.col(f"row.`{text}`"), F.col("spans"))).alias("clean"))
    new = {text: F.col("clean")} | ({length: F.length("clean").cast(dict(docs.dtypes)[length])} if length else {})
    return clean.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
