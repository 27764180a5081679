"""Language of the words of a text: a linear-chain conditional random field over affixes, n-grams and lexicons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.ordering import carried
from codestrata.operators.ranking import top_n
from codestrata.session import broadcast_if_small, stage

UNKNOWN = "und"
_WIDE = 24
_BITS = 16
_PIECE = 8 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters of all texts, longer ones cut into words of 24, and how many each text has."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    plain = pc.replace_substring_regex(plain, rf"([^ ]{{{_WIDE}}})", r"\1 ")
    split = pc.ascii_split_whitespace(pc.cast(pc.ascii_trim_whitespace(plain), pa.large_string()))
    flat = split.flatten()
    size = np.diff(split.offsets.to_numpy())
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():  # a text without letters splits into one empty word
        first = np.cumsum(size) - size
        size = size - np.add.reduceat(np.append(empty, False).astype(np.int64), first) * (size > 0)
        flat = flat.filter(pa.array(~empty))
    return flat, size


def _hash(codes: np.ndarray, kind: int) -> np.ndarray:
    h = np.full(len(codes), 0x9E3779B97F4A7C15 * (kind + 1) & (2**64 - 1), np.uint64)
    for column in codes.T:
        h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def features(words: list[str], lexicons: list[set[str]]):
    """(rows, feature numbers): n-grams of 1 to 4 letters, prefixes and suffixes of 1 to 3, the word, its lexicons.

    A word has 24 letters at most, as `words_of` cuts them.
    """
    if any(len(w) > _WIDE for w in words):
        raise ValueError(f"a word of more than {_WIDE} letters")
    codes = np.array(words, f"U{_WIDE}").view(np.uint32).reshape(len(words), _WIDE).astype(np.uint64)
    size = (codes > 0).sum(axis=1)
    every = np.arange(len(words))
    yield every, _hash(codes[:, : max(1, int(size.max(initial=1)))] + np.uint64(1), 0)
    for n in range(1, 5):
        for at in range(int(size.max(initial=0)) - n + 1):
            rows = np.flatnonzero(size >= at + n)
            yield rows, _hash(codes[rows, at : at + n], n)
    for n in range(1, 4):
        rows = np.flatnonzero(size >= n)
        yield rows, _hash(codes[rows, :n], 4 + n)
        yield rows, _hash(codes[rows[:, None], size[rows, None] - n + np.arange(n)], 7 + n)
    for k, lexicon in enumerate(lexicons):
        rows = np.array([i for i, w in enumerate(words) if w in lexicon], np.int64)
        yield rows, np.full(len(rows), (1 << _BITS) + k)


class Field:
    """Weights of a field over `labels`, plain arrays and sets so that it travels to tasks as it is."""

    def __init__(self, labels, lexicons, emission, transition, start):
        self.labels, self.lexicons, self.emission, self.transition, self.start = labels, lexicons, emission, transition, start

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        for rows, which in features(words, self.lexicons):
            out[rows] += self.emission[which]
        return out


def forward_backward(scores: np.ndarray, size: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Label probabilities of every word of all sequences, and the expected transitions of all (from, to).

    `scores` has the words of all sequences one after another, `size` the number of each. Sequences go in step,
    longest first, so each step works on those that still have a word.
    """
    order = np.argsort(-size, kind="stable")
    first, long = (np.cumsum(size) - size)[order], size[order]
    most = int(long[0]) if len(long) else 0
    running = np.searchsorted(-long, -np.arange(most), "left")  # sequences with more than t words
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, begin = np.exp(transition - transition.max()), np.exp(start - start.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    for t in range(most):
        at = first[: running[t]] + t
        here = (ahead[at - 1] @ move if t else begin) * local[at]
        ahead[at] = here / here.sum(axis=1, keepdims=True)
    for t in range(most - 2, -1, -1):
        at = first[: running[t + 1]] + t
        there = (back[at + 1] * local[at + 1]) @ move.T
        back[at] = there / there.sum(axis=1, keepdims=True)
    marginal = ahead * back
    marginal /= marginal.sum(axis=1, keepdims=True)
    later = np.ones(len(scores), bool)
    later[(np.cumsum(size) - size)[size > 0]] = False
    at = np.flatnonzero(later)
    left, right = ahead[at - 1], local[at] * back[at]
    both = np.einsum("ni,ij,nj->n", left, move, right, optimize=True)
    moves = (left / both[:, None]).T @ right * move if len(at) else np.zeros_like(move)
    return marginal, moves


def fit(samples: list[tuple[int, list[str]]], labels: list[str], length: int = 40, rounds: int = 50, lexicon: int = 2_000, seed: int = 5) -> Field:
    """A field learnt from (label, words) samples by gradient ascent on the penalised likelihood.

    The samples are cut into runs of 3 to 20 words, shuffled and strung together: that makes code-switched
    training text, from which the transitions are learnt.
    """
    rng = np.random.default_rng(seed)
    counts: list[dict[str, int]] = [{} for _ in labels]
    runs = []
    for label, words in samples:
        for w in words:
            counts[label][w] = counts[label].get(w, 0) + 1
        at = 0
        while at < len(words):
            step = int(rng.integers(3, 21))
            runs.append((label, words[at : at + step]))
            at += step
    lexicons = [set(sorted(c, key=lambda w, c=c: (-c[w], w))[:lexicon]) for c in counts]
    runs = [runs[i] for i in rng.permutation(len(runs))]
    words = [w for _, run in runs for w in run]
    truth = np.array([label for label, run in runs for _ in run])
    size = np.array([min(length, len(words) - a) for a in range(0, len(words), length)], np.int64)
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    which = np.array([known[w] for w in words])
    pairs = list(features(list(known), lexicons))
    row, feature = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    many, width = (1 << _BITS) + len(labels), len(labels)
    weights = [np.zeros((many, width)), np.zeros((width, width)), np.zeros(width)]
    squares = [np.zeros_like(w) for w in weights]
    right = np.eye(width)[truth]
    starts = np.cumsum(size) - size
    inner = np.ones(len(words), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((width, width))
    np.add.at(seen, (truth[at - 1], truth[at]), 1.0)
    for _ in range(rounds):
        emission = np.stack([np.bincount(row, weights[0][feature, k], len(known)) for k in range(width)], axis=1)
        marginal, moves = forward_backward(emission[which], size, weights[1], weights[2])
        error = right - marginal
        by_word = np.stack([np.bincount(which, error[:, k], len(known)) for k in range(width)], axis=1)
        slopes = [np.stack([np.bincount(feature, by_word[row, k], many) for k in range(width)], axis=1), seen - moves, error[starts].sum(axis=0)]
        for w, s, slope in zip(weights, squares, slopes, strict=True):
            slope -= 0.5 * w
            s += slope * slope
            w += 0.3 * slope / np.sqrt(s + 1e-9)
    return Field(labels, lexicons, *weights)


def _sampler(field_words: int):
    def sample(batches):
        for batch in batches:
            flat, size = words_of(batch.column(2))
            end = np.cumsum(size)
            for i, (label, place) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                first = int(end[i] - size[i]) + place % max(1, int(size[i]) - field_words + 1)
                words = flat.slice(first, min(field_words, int(end[i]) - first)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([words], pa.list_(pa.string()))], names=["label", "words"])
    return sample


def trained(docs: DataFrame, text: str = "text", label: str = "lang", sample_docs: int = 300, sample_words: int = 120, sample_total: int = 30_000) -> Field | None:
    """A field from a bounded sample of labelled rows; None without any.

    The bound: of every label `sample_docs` texts, or as many fewer as keep all labels together at `sample_total`, one at least: those
    with the smallest hashes, and `sample_words` words in a row of each text, from a place that the hash chooses. Only labels
    and hashes are sorted; the second scan picks the texts. So a label's rarity does not keep it from being learnt.
    """
    rows = docs.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}")).select(
        F.col(f"`{label}`").alias("label"), F.xxhash64(F.lit(17), F.col(f"`{text}`")).alias("place"), F.col(f"`{text}`").alias("t"))
    narrow = stage(rows.select("label", "place").distinct(), "labelled")
    labels = [r.label for r in narrow.select("label").distinct().orderBy("label").collect()]  # the classes of the model
    if not labels:
        return None
    each = max(1, min(sample_docs, sample_total // len(labels)))
    last = top_n(narrow, ["label"], [F.asc("place")], each).groupBy("label").agg(F.max("place").alias("last"))
    chosen = rows.join(broadcast_if_small(stage(last, "last-places")), "label").where(F.col("place") <= F.col("last"))
    picked = chosen.select("label", "place", "t").dropDuplicates(["label", "place"]).mapInArrow(_sampler(sample_words), "label string, words array<string>")
    number = {name: i for i, name in enumerate(labels)}
    found = sorted((number[r.label], list(r.words)) for r in picked.collect())
    return fit(found, labels)


def _guesser(field):
    def guess(texts: pa.Array) -> pa.Array:
        model = Field(*field.value)
        names, shares = [], []
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // _PIECE
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
        for a, b in zip(edges, edges[1:], strict=False):
            flat, count = words_of(texts.slice(a, b - a))
            coded = flat.dictionary_encode()
            if len(flat):
                scores = model.scores(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                marginal, _ = forward_backward(scores, count, model.transition, model.start)
                total = np.vstack([np.zeros(len(model.labels)), np.cumsum(marginal, axis=0)])
                end = np.cumsum(count)
                share = (total[end] - total[end - count]) / np.maximum(count, 1)[:, None]
            else:
                share = np.zeros((b - a, len(model.labels)))
            top = share.argmax(axis=1)
            names += [model.labels[k] if n else UNKNOWN for k, n in zip(top, count, strict=True)]
            shares.append(np.clip(share.max(axis=1), 0.0, 1.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(shares) if shares else [], pa.float64())], names=["lang", "share"])
    return F.arrow_udf(guess, "lang string, share double")


def predicted(docs: DataFrame, model: Field | None, text: str = "text") -> DataFrame:
    """`row` (the whole input row) with `lang_pred` and `score`: the label with the most expected words, and their share.

    Every word of the whole text gets its label probabilities by forward-backward; their means decide, ties go to
    the first label by name. A null text, or one without a letter, is `und` with score 0, as is every text
    without a model. Rows are independent; an empty table gives no rows; clashing columns stay inside `row`.
    """
    rows = docs.select(carried(docs), F.col(f"`{text}`").alias("t"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    plain = (model.labels, model.lexicons, model.emission, model.transition, model.start)
    guess = _guesser(docs.sparkSession.sparkContext.broadcast(plain))
    return rows.select("row", guess("t").alias("g")).select("row", F.col("g.lang").alias("lang_pred"), F.col("g.share").alias("score"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: the checksum of its id as text (null: empty) is a multiple of five."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0
