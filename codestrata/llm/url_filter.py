"""URL filter: listed rules, and a ratio of two character language models for the rest."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import stage

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own. Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 5
_START, _END, _OTHER = 0, 1, 2
_KNOWN = string.ascii_lowercase + string.digits + "/.:-_?=&#%+~@,;!$'()*[]"
_SYMBOLS = 64
_BINS = 100
#: Symbols before by which n-grams and counts are grouped; contexts of fewer are few.
_NEAR = 3


def _table() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    for i, c in enumerate(_KNOWN):
        table[ord(c)] = table[ord(c.upper())] = 3 + i
    return table


SYMBOL = _table()


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """verdict and rule of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def contexts(urls: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Symbols of all URLs with their end marks, their contexts of 0 to ORDER symbols, and symbols per URL."""
    urls = urls.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset : urls.offset + len(urls) + 1]
    octets = np.frombuffer(urls.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    padded = size + ORDER + 1
    begin = np.cumsum(padded) - padded
    flat = np.full(int(padded.sum()), _START, np.int64)
    place = np.repeat(begin + ORDER - (offsets[:-1] - offsets[0]), size) + np.arange(len(octets))
    flat[place] = SYMBOL[octets]
    flat[begin + ORDER + size] = _END
    real = np.ones(len(flat), bool)
    for k in range(ORDER):
        real[begin + k] = False
    at = np.flatnonzero(real)
    before, found = np.zeros(len(at), np.int64), []
    for k in range(ORDER + 1):
        found.append(before.copy())
        if k < ORDER:
            before |= flat[at - k - 1] << 6 * k
    return flat[at], found, size + 1


def _count(batches):
    """label, key and uses of every context and symbol; a key is context, symbol (6 bits), order (3 bits)."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for label in (False, True):
            urls = batch.column(0).filter(pa.array(labels == label))
            symbols, before, _ = contexts(urls)
            keys = np.concatenate([(c << 6 | symbols) << 3 | k for k, c in enumerate(before)])
            keys, uses = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), label)), pa.array(keys), pa.array(uses.astype(np.int64))], names=["label", "key", "uses"])


class Model:
    """A variable-order Markov model: Witten-Bell interpolation over the contexts seen `least` times."""

    def __init__(self, keys: np.ndarray, uses: np.ndarray, least: int):
        contexts, where = np.unique(keys >> 9 << 3 | keys & 7, return_inverse=True)
        total = np.bincount(where, weights=uses, minlength=len(contexts))
        held = total >= least
        kept = held[where]
        order = np.argsort(keys[kept])
        self.keys, self.uses = keys[kept][order], uses[kept][order].astype(np.float64)
        self.contexts, self.total = contexts[held], total[held]
        self.kinds = np.bincount(where, minlength=len(contexts))[held].astype(np.float64)

    def interpolated(self, p: np.ndarray | float, symbols: np.ndarray, before: np.ndarray, orders) -> np.ndarray:
        """The symbols' probabilities after the contexts of `orders`, from those of the orders below; `before` has ORDER symbols."""
        p = np.broadcast_to(p, len(symbols)).astype(np.float64)
        for k in orders if len(self.contexts) else ():
            context = before & (1 << 6 * k) - 1
            at = np.minimum(np.searchsorted(self.contexts, context << 3 | k), len(self.contexts) - 1)
            held = self.contexts[at] == (context << 3 | k)
            key = (context << 6 | symbols) << 3 | k
            entry = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            seen = np.where(self.keys[entry] == key, self.uses[entry], 0)
            p = np.where(held, (seen + self.kinds[at] * p) / (self.total[at] + self.kinds[at]), p)
        return p

    def log_likelihood(self, symbols: np.ndarray, before: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        p = self.interpolated(1.0 / _SYMBOLS, symbols, before[ORDER], range(ORDER + 1))
        return np.add.reduceat(np.log(p), np.cumsum(size) - size)


def _scorer(models, min_uses):
    def score(urls: pa.Array) -> pa.Array:
        if not len(urls):
            return pa.array([], pa.float64())
        accepted, rejected = (Model(*held, min_uses) for held in models.value)
        symbols, before, size = contexts(urls)
        ratio = (accepted.log_likelihood(symbols, before, size) - rejected.log_likelihood(symbols, before, size)) / size
        return pa.array(ratio)
    return F.arrow_udf(score, "double")


def counted(urls: DataFrame) -> DataFrame | None:
    """label, key and uses, staged, of all rows (url, accepted); None without rows of both kinds."""
    counts = stage(urls.select("url", "accepted").mapInArrow(_count, "label boolean, key long, uses long").groupBy("label", "key").agg(F.sum("uses").alias("uses")), "counts")
    return counts if counts.select("label").distinct().count() == 2 else None


def _by_label(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    table = counts.select("label", "key", "uses").toArrow()
    label, key, uses = (table.column(i).to_numpy() for i in range(3))
    return [(key[label == kind], uses[label == kind]) for kind in (True, False)]


def trained(urls: DataFrame, min_uses: int = 2):
    """Column to column score of a URL, from all rows (url, accepted); None without rows of both kinds.

    Every context of a kind seen `min_uses` times is held, and all of them go to the tasks: this is for models that fit
    in one. `scored` gives the same scores for models of any size.
    """
    counts = counted(urls)
    return None if counts is None else _scorer(urls.sparkSession.sparkContext.broadcast(_by_label(counts)), min_uses)


def _grams(batches):
    """id, n-gram (ORDER symbols before, and the symbol) and its uses in the URL."""
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols, before, size = contexts(batch.column(1))
        gram, row = before[ORDER] << 6 | symbols, np.repeat(np.arange(len(size)), size)
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])))
        uses = np.diff(np.append(first, len(gram)))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[row[first]]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(gram[first]), pa.array(uses.astype(np.int64))], names=["id", "gram", "n"])


def _rater(low, min_uses):
    """Log-ratio of the n-grams of one group, from the group's counts and those of the low orders."""
    models = []

    def rate(grams: pa.Table, counts: pa.Table) -> pa.Table:
        if not models:
            models.extend(Model(*held, min_uses) for held in low.value)
        gram = grams.column("gram").to_numpy()
        label, key, uses = (counts.column(c).to_numpy() for c in ("label", "key", "uses"))
        logs = []
        for kind, model in zip((True, False), models, strict=True):
            p = model.interpolated(1.0 / _SYMBOLS, gram & 63, gram >> 6, range(_NEAR))
            own = label == kind
            logs.append(np.log(Model(key[own], uses[own], min_uses).interpolated(p, gram & 63, gram >> 6, range(_NEAR, ORDER + 1))))
        return pa.table({"gram": gram, "ratio": logs[0] - logs[1]})
    return rate


def scored(urls: DataFrame, counts: DataFrame, min_uses: int = 2) -> DataFrame:
    """url (null: empty) and score, staged, of each distinct URL under all contexts of `counts` seen `min_uses` times.

    Each distinct n-gram of the URLs is rated once, where the counts of its contexts are: n-grams and counts meet by the
    last `_NEAR` symbols before, so a group has at most 64 ** 3 n-grams, however many contexts there are. The counts of the
    orders below, at most 64 + 64 ** 2 + 64 ** 3 a kind, go to all tasks. Sums are decimal, so equal in any order.
    """
    spark = urls.sparkSession
    distinct = stage(urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct().withColumn("id", F.monotonically_increasing_id()), "urls")
    held = distinct.select("id", "url").mapInArrow(_grams, "id long, gram long, n long")
    order = F.col("key").bitwiseAND(7)
    low = spark.sparkContext.broadcast(_by_label(counts.where(order < _NEAR)))
    near = (1 << 6 * _NEAR) - 1
    grams = held.select("gram").distinct().withColumn("near", F.shiftright("gram", 6).bitwiseAND(near))
    high = counts.where(order >= _NEAR).withColumn("near", F.shiftright("key", 9).bitwiseAND(near))
    rated = grams.groupBy("near").cogroup(high.groupBy("near")).applyInArrow(_rater(low, min_uses), "gram long, ratio double")
    rated = stage(rated, "rated")
    total = held.join(rated, "gram").groupBy("id").agg(
        (F.sum((F.col("n") * F.col("ratio")).cast("decimal(28,12)")).cast("double") / F.sum("n")).alias("score"))
    return stage(distinct.join(total, "id").select("url", "score"), "scores")


def calibrated(scored: DataFrame) -> float:
    """The threshold on score with the best balanced accuracy on rows (score, accepted), the nearest to 0 of equals."""
    bin_of = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * _BINS))).cast("long")
    rows = scored.groupBy(bin_of.alias("bin")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).orderBy("bin").toPandas()
    good, bad = rows["good"].to_numpy(np.float64), rows["bad"].to_numpy(np.float64)
    if not good.sum() or not bad.sum():
        return 0.0
    # A threshold lies before a bin or after the last, anywhere from the end of the bin before it; what is not below is accepted.
    right = np.append(good[::-1].cumsum()[::-1], 0) / good.sum() + np.append(0, bad.cumsum()) / bad.sum()
    bins = rows["bin"].to_numpy(np.float64) / _BINS
    least, most = np.append(-np.inf, bins + 1 / _BINS), np.append(bins, np.inf)
    nearest = np.clip(0.0, least, most)[right >= right.max() - 1e-12]
    return float(nearest[np.argmin(np.abs(nearest))])


def judged(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every URL.

    Where no rule fits, two models judge: one of the URLs that the rules allow, one of those they block, both learnt
    from all of them but a fifth (by the URL's checksum), on which the threshold is calibrated. The score is the difference
    of log-likelihoods per character (end mark included); from the threshold on a URL is allowed. Any text is a URL:
    null and empty ones have only an end mark. Characters that are not ASCII are one symbol a byte. Without URLs of
    both kinds the score is null and the verdict allow. Repeated rows are judged alike; an empty table gives no rows.
    Other columns are not read.
    """
    text = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), text.alias("url"), host(text).alias("host"), path(text).alias("path"))
    rows = rows.withColumn("hit", listed(F.col("host"), F.col("path"), rules))
    known = rows.where("hit is not null").select("url", (F.col("hit.verdict") == "allow").alias("accepted"), (F.crc32("url") % 5 == 0).alias("held_out"))
    counts = counted(known.where("not held_out"))
    if counts is None:
        out = rows.withColumn("score", F.lit(None).cast("double"))
        threshold = 0.0
    else:
        scores = scored(rows.select("url"), counts, **options).withColumnRenamed("url", "of")
        same = F.coalesce("url", F.lit("")) == F.col("of")
        threshold = calibrated(known.where("held_out").join(scores, same).select("score", "accepted"))
        out = rows.join(scores, same, "left")
    guess = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), guess).alias("verdict"), "score")
