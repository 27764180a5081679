"""Ranked lexical search of many items at once: shared term sets are mined, scored once a document, and combined along a DAG."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.ordering import ranked
from codestrata.operators.ranking import top_n
from codestrata.session import stage

#: What separates terms, and the constants of the score.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARE, SATURATION, SCALE = 90, 8, 1000
_PIECE = 8 << 20
_CELLS = 4_000_000


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of the texts, the place there of every term in turn, and how many terms each text has."""
    plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAKS, " ")
    plain = pc.ascii_trim(plain, " ")
    split = pc.split_pattern(pc.cast(plain, pa.large_string()), " ")
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    size = np.diff(split.offsets.to_numpy())
    flat = split.flatten()
    none = pc.equal(plain, "").to_numpy(zero_copy_only=False)
    if none.any():
        flat, size = flat.filter(pc.not_equal(flat, "")), np.where(none, 0, size)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), size


def _pieces(batch: pa.RecordBatch):
    """Slices of a batch of a few megabytes of text (its second column), one text at least."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // _PIECE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _item_terms(batches):
    """item and term, once a text."""
    for batch in batches:
        for piece in _pieces(batch):
            words, codes, size = terms_of(piece.column(1))
            row = np.repeat(np.arange(len(size)), size)
            pairs = np.unique(row * max(1, len(words)) + codes)
            yield pa.RecordBatch.from_arrays([
                piece.column(0).take(pa.array(pairs // max(1, len(words)))), words.take(pa.array(pairs % max(1, len(words)))).cast(pa.string()),
            ], names=["item", "term"])


class SharingPlan:
    """How items are summed up from shared sets of terms.

    Terms that the same items hold form one leaf, a set that is summed once a document. Leaves of several items are put
    in one order, most items first, so that items that share sets have them side by side; neighbours that two or more
    items have become an inner node, until none is left. An item is then a few nodes; a node is added up once,
    whatever number of items lead to it. `leaf[t]` is the leaf of term t, `levels` the inner nodes by their height as
    (node, left, right), `parts` and `starts` the nodes of each item in turn.
    """

    def __init__(self, items: np.ndarray, terms: np.ndarray, n_items: int, n_terms: int):
        holders: list[list[int]] = [[] for _ in range(n_terms)]
        for i, t in sorted(zip(items.tolist(), terms.tolist(), strict=True)):
            holders[t].append(i)
        leaves: dict[tuple[int, ...], int] = {}
        self.leaf = np.array([leaves.setdefault(tuple(h), len(leaves)) for h in holders], np.int64)
        of_item: list[list[int]] = [[] for _ in range(n_items)]
        for held, node in sorted(leaves.items(), key=lambda x: (-len(x[0]), x[1])):
            for i in held:
                of_item[i].append(node)
        height, inner = [0] * len(leaves), []
        while True:
            pairs = Counter(p for nodes in of_item for p in set(zip(nodes, nodes[1:], strict=False)))
            shared = {p: n for p, n in pairs.items() if n > 1}
            if not shared:
                break
            made: dict[tuple[int, int], int] = {}
            for i, nodes in enumerate(of_item):
                out, at = [], 0
                while at < len(nodes):
                    here = shared.get(tuple(nodes[at : at + 2]), 0)
                    # The pair that more items have goes first where two overlap.
                    if here and here >= shared.get(tuple(nodes[at + 1 : at + 3]), 0):
                        pair = (nodes[at], nodes[at + 1])
                        if pair not in made:
                            made[pair] = len(height)
                            height.append(1 + max(height[pair[0]], height[pair[1]]))
                            inner.append((made[pair], *pair))
                        out.append(made[pair])
                        at += 2
                    else:
                        out.append(nodes[at])
                        at += 1
                of_item[i] = out
        self.n_nodes = len(height)
        inner = np.array(inner, np.int64).reshape(-1, 3)
        tall = np.array(height, np.int64)[inner[:, 0]] if len(inner) else np.zeros(0, np.int64)
        self.levels = [inner[tall == h] for h in np.unique(tall)]
        self.parts = np.array([n for nodes in of_item for n in nodes], np.int64)
        sizes = np.array([len(nodes) for nodes in of_item], np.int64)
        self.starts = np.cumsum(sizes) - sizes

    def scores(self, doc: np.ndarray, term: np.ndarray, worth: np.ndarray, n_docs: int) -> np.ndarray:
        """Items × documents: the sums of what each document's terms are worth, as 64-bit integers."""
        sums = np.zeros((self.n_nodes, n_docs), np.int64)
        np.add.at(sums, (self.leaf[term], doc), worth)
        for level in self.levels:
            sums[level[:, 0]] = sums[level[:, 1]] + sums[level[:, 2]]
        return np.add.reduceat(sums[self.parts], self.starts, axis=0)


def _poster(vocabulary):
    """doc_id, n (terms with repeats), and the places in the vocabulary of the terms it holds with their uses."""
    def post(batches):
        asked = pa.array(vocabulary.value, pa.large_string())
        width = max(1, len(asked))
        for batch in batches:
            for piece in _pieces(batch):
                words, codes, size = terms_of(piece.column(1))
                place = pc.fill_null(pc.index_in(words, value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                row = np.repeat(np.arange(len(size)), size)
                pairs, uses = np.unique((row * width + place)[place >= 0], return_counts=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // width, minlength=len(size)))]).astype(np.int32)
                out = pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs % width).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(uses.astype(np.int64))),
                ], names=["doc_id", "n", "terms", "uses"])
                yield out.filter(pa.array(size > 0))
    return post


def _scorer(shared, k: int):
    """item (its place), doc_id and score: the best `k` documents of a task for every item."""
    def score(batches):
        plan, weight, whole, length, n_items = shared.value
        least = np.zeros(n_items, np.int64)  # a document below its item's is not among the k best
        none = np.zeros(0, np.int64)
        held = [none, none, none, np.zeros(0, bool)]
        step = max(1, _CELLS // max(1, plan.n_nodes + len(plan.parts)))

        def best(found):
            item, number, doc, blank = (np.concatenate(x) for x in zip(held, found, strict=True))
            order = np.lexsort((doc, blank, -number, item))
            first = np.flatnonzero(np.append(True, np.diff(item[order]) != 0)) if len(order) else none
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            order = order[place < k]
            full = np.flatnonzero(np.bincount(item[order], minlength=n_items) == k)
            last = np.searchsorted(item[order], full, "right") - 1
            least[full] = number[order][last]
            return [x[order] for x in (item, number, doc, blank)]

        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = batch.column(2).offsets.to_numpy()
            terms, uses = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            terms, uses, ends = terms, uses, ends - ends[0]
            norm = 100 - SHARE + (SHARE * n * whole) // length
            blank = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(n), step):
                b = min(len(n), a + step)
                t, tf = terms[ends[a] : ends[b]], uses[ends[a] : ends[b]]
                doc = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                worth = weight[t] * ((SCALE * 1_000_000 * tf) // (SCALE * tf + SATURATION * norm[a:b][doc]))
                sums = plan.scores(doc, t, worth, b - a)
                item, at = np.nonzero((sums > 0) & (sums >= least[:, None]))
                held[:] = best([item, sums[item, at], ids[a:b][at], blank[a:b][at]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held[0], pa.int64()), pa.array(held[2], pa.int64(), mask=held[3]), pa.array(held[1], pa.int64())], names=["place", "doc_id", "score"])
    return score


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text",
                   item_col: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the `k` documents that score highest for each item, exactly.

    A document's score for an item sums, over the item's distinct terms, w * (10^9 tf div (1000 tf + 8 m)), with
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 10 + (90 n N div L): N documents have a term, L terms in all, n in this one.
    All counts are over all documents. Items are taken in blocks of `block_bytes` of distinct terms, an item at least. For a
    block one pass over the texts keeps each document's uses of the block's terms, staged; df comes from there. Then
    every task adds up its documents along the block's `SharingPlan`, some documents at a time, and returns `k` rows an item.

    Texts that are null or have no term are in no count. A null document id is an id like others, last among equal scores; rows
    that repeat an id are documents of their own. Rows of one item id, null included, are one item with the terms of
    all; an item without terms has no rows, and so has an empty side. Only scores above 0 count. Other columns are not read.
    """
    spark = docs.sparkSession
    item_type = items.select(F.col(f"`{item_col}`")).schema[0].dataType
    schema = T.StructType([T.StructField("item", item_type), T.StructField("term", T.StringType())])
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("t")).mapInArrow(_item_terms, schema).distinct()
    asked = stage(asked, "item-terms")
    numbered = ranked(asked.groupBy("item").agg(F.sum(F.octet_length("term") + 16).alias("held")), ["item"], value="held")
    numbered = stage(numbered.select(F.col("item").alias("of"), "rank", F.floor(F.col("before") / block_bytes).alias("block")), "items")
    blocks = [r["block"] for r in numbered.select("block").distinct().orderBy("block").collect()]
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).where("t is not null")
    parts = []
    for block in blocks:
        chosen = numbered.where(F.col("block") == block)
        rows = asked.join(chosen, F.col("item").eqNullSafe(F.col("of"))).select("rank", "term").toArrow()  # `block_bytes`, or one item's
        vocabulary = rows.column("term").combine_chunks().dictionary_encode()
        places, item = np.unique(rows.column("rank").to_numpy(), return_inverse=True)
        words = vocabulary.dictionary.to_pylist()
        plan = SharingPlan(item, vocabulary.indices.to_numpy(), len(places), len(words))
        postings = texts.mapInArrow(_poster(spark.sparkContext.broadcast(words)), "doc_id long, n long, terms array<int>, uses array<long>")
        postings = stage(postings, "postings")
        whole, length = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not whole:
            break
        df = np.zeros(len(words), np.int64)
        for t, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a word at most
            df[t] = n
        weight = np.floor(SCALE * np.log((2 * whole + 2) / (2 * df + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast((plan, weight, whole, length, len(places)))
        found = postings.mapInArrow(_scorer(shared, k), "place long, doc_id long, score long")
        parts.append(top_n(stage(found, "scored"), ["place"], [F.desc("score"), F.asc_nulls_last("doc_id")], k).withColumn(
            "place", F.col("place") + int(places[0])))
    if not parts:
        return spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(item_type).alias("item_id"), "*")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.withColumnRenamed("rank", "nth").join(numbered, F.col("place") == F.col("rank"))
    return hits.select(F.col("of").alias("item_id"), F.col("nth").cast("int").alias("rank"), "doc_id", "score")
