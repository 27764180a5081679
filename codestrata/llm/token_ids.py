"""Token ids as files: frequency ranks in byte-aligned variable-length code with separate control bytes.

A file holds the documents of one range of ids, ascending:

    8 bytes   magic "FREQIDS1"
    3 x u64   documents n, ids m, distinct ids k (little-endian, like all numbers)
    k x u32   the id of each rank: the id that the file uses most has rank 0
    n x i64   document ids, then n bytes: 1 where the id is null
    n x u64   ids per document
    m/4 bytes control, rounded up: four 2-bit fields a byte, lowest first, each the byte length of a rank less 1
    data      the ranks, 1 to 4 bytes each; the last control byte's unused fields stand for a rank of 0
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.session import stage, work_dir

MAGIC = b"FREQIDS1"
_PIECE = 6 << 20
_CACHE = 400_000
_TOGETHER = 1_000
#: Byte lengths of the four ranks that a control byte describes, and the bits that a rank of each length has.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of the ranks."""
    ranks = np.concatenate([ranks, np.zeros(-len(ranks) % 4, ranks.dtype)]).astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.int64) + (ranks > 0xFFFFFF)
    control = ((size - 1).reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    octets = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) < size[:, None]].tobytes()


def decode(control: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, int]:
    """The ranks of whole control bytes, and the data bytes they take, by table lookup."""
    size = LENGTHS[control].ravel()
    end = np.cumsum(size)
    used = int(end[-1]) if len(end) else 0
    octets = np.concatenate([data[:used], np.zeros(3, np.uint8)])
    at = end - size
    wide = octets[at].astype(np.uint32)
    for k in range(1, 4):
        wide |= octets[at + k].astype(np.uint32) << np.uint32(8 * k)
    return wide & MASKS[size], used


def _filesystem(folder: str):
    """The store and path of a folder that driver and executors share."""
    folder = folder.replace("s3a://", "s3://", 1)
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


class Encoder:
    """Ids of whole texts; each distinct word is encoded once.

    The tokenizer's words never cross white space, nor a letter A-Z or a-z that punctuation follows, so a text's ids are
    those of its pieces in turn. It lowers case, but finds its special tokens first: texts with one in any spelling keep
    their case, the others are lowered, so that fewer words are distinct. `tests/llm` compares with whole texts.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        tokens = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "(?i)" + "|".join(re.escape(t) for t in tokens) if tokens else ""
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self):
        """The known words, the number of ids of each, and all their ids in turn; an unnamed end id leads."""
        self.words, self.size, self.flat = pa.array([], pa.large_string()), np.ones(1, np.int64), np.array([self.end_id], np.uint32)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and the number of ids of each, word by word."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum())), size

    def _encode_letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters only, many in one text: each has an id that ends a word, its last."""
        texts = [" ".join(words.slice(a, _TOGETHER).to_pylist()) for a in range(0, len(words), _TOGETHER)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        last = np.flatnonzero(self.ends_word[ids])
        # A letter whose lower case is no letter alone would end a word more.
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(words) else self._encode(words)

    def _learn(self, words: pa.Array):
        letters = pc.utf8_is_alpha(words)
        for new, encode in ((words.filter(letters), self._encode_letters), (words.filter(pc.invert(letters)), self._encode)):
            ids, size = encode(new)
            self.words = pa.concat_arrays([self.words, new])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with each text's end id, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring_regex(texts, self.special), texts, pc.ascii_lower(texts)) if self.special else pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?])", r"\1 \2")
        words = pc.ascii_split_whitespace(pc.cast(texts, pa.large_string()))
        starts = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        if len(self.words) > _CACHE:
            self._forget()
        self._learn(coded.dictionary.filter(pc.is_null(pc.index_in(coded.dictionary, value_set=self.words))))
        known = pc.index_in(coded.dictionary, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes = np.insert(known[coded.indices.to_numpy()], starts[1:] - starts[0], 0)
        taken, first = self.size[codes], np.cumsum(self.size) - self.size
        ends = np.cumsum(taken)
        out = np.repeat(first[codes] - (ends - taken), taken) + np.arange(int(taken.sum()))
        ends = ends[starts[1:] - starts[0] + np.arange(len(texts))] if len(texts) else np.zeros(0, np.int64)
        return self.flat[out], np.diff(ends, prepend=0)


def _pieces(batch: pa.RecordBatch, text: int):
    """A batch in slices of a few megabytes of text, one text at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // _PIECE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _ranked(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids by falling use, ties to the smaller, and the rank of each id."""
    uses = np.zeros(0, np.int64)
    for piece in ids:
        got = np.bincount(piece)
        uses = np.pad(uses, (0, max(0, len(got) - len(uses))))
        uses[: len(got)] += got
    order = np.argsort(-uses, kind="stable")[: np.count_nonzero(uses)].astype(np.uint32)
    rank_of = np.zeros(len(uses), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    return order, rank_of


def _writer(path: str, end_id: int, folder: str):
    def write(batches):
        from pyspark import TaskContext

        encoder, part = Encoder(path, end_id), TaskContext.get().partitionId()
        doc_ids, nulls, sizes, ids = [], [], [], []
        for batch in batches:
            for piece in _pieces(batch, 1):
                found, size = encoder(piece.column(1))
                ids.append(found)
                sizes.append(size)
                doc_ids.append(pc.fill_null(piece.column(0), 0).to_numpy(zero_copy_only=False))
                nulls.append(pc.is_null(piece.column(0)).to_numpy(zero_copy_only=False).astype(np.uint8))
        if not ids:
            return
        order, rank_of = _ranked(ids)
        control, data, rest = [], [], np.zeros(0, np.uint32)
        for k, piece in enumerate(ids):
            ranks = np.concatenate([rest, rank_of[piece]])
            whole = len(ranks) // 4 * 4
            for out, octets in zip((control, data), encode(ranks[:whole]), strict=True):
                out.append(octets)
            rest, ids[k] = ranks[whole:], None
        for out, octets in zip((control, data), encode(rest), strict=True):
            out.append(octets)
        sizes = np.concatenate(sizes)
        n, m = len(sizes), int(sizes.sum())
        # A task that runs again writes a file of its own; only the name that its row brings back is ever read.
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        store, root = _filesystem(folder)
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC + np.array([n, m, len(order)], "<u8").tobytes() + order.astype("<u4").tobytes())
            for block in (np.concatenate(doc_ids).astype("<i8"), np.concatenate(nulls), sizes.astype("<u8")):
                out.write(block.tobytes())
            for block in (*control, *data):
                out.write(block)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([m], pa.int64())],
            names=["file", "part", "n_docs", "n_ids"])
    return write


def _reader(folder: str, step: int = 1 << 20):
    def read(batches):
        store, root = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    raw = np.frombuffer(f.read_buffer(), np.uint8)
                if raw[:8].tobytes() != MAGIC:
                    raise ValueError(f"{name} is no token file")
                n, m, k = raw[8:32].view("<u8").tolist()
                cuts = np.cumsum([32, 4 * k, 8 * n, n, 8 * n]).tolist()
                id_of, doc_ids, nulls, sizes = (
                    np.frombuffer(raw[x:y].tobytes(), t) for x, y, t in zip(cuts, cuts[1:], ("<u4", "<i8", "u1", "<u8"), strict=False))
                sizes, at = sizes.astype(np.int64), cuts[-1]
                control, data = raw[at : at + -(-m // 4)], raw[at + -(-m // 4) :]
                ends, done, have, first = np.cumsum(sizes), 0, np.zeros(0, np.uint32), 0
                while done < n:
                    # The documents up to `step` further ids, one at least.
                    base = int(ends[done - 1]) if done else 0
                    last = max(done + 1, int(np.searchsorted(ends, base + step, "right")))
                    need = -(-(int(ends[last - 1]) - base - len(have)) // 4)
                    if need > 0:
                        ranks, used = decode(control[first : first + need], data)
                        data, first, have = data[used:], first + need, np.concatenate([have, ranks])
                    count = int(ends[last - 1]) - base
                    blob, have = id_of[have[:count]].astype("<u4").tobytes(), have[count:]
                    offsets = np.concatenate([[0], np.cumsum(sizes[done:last])]) * 4
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids[done:last], pa.int64(), mask=nulls[done:last].astype(bool)),
                        pa.array(start + ends[done:last] - sizes[done:last], pa.int64()),
                        pa.array(sizes[done:last], pa.int64()),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - done, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(blob)]).cast(pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])
                    done = last
    return read


def write_token_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
                    id_col: str = "doc_id", text: str = "text", file_bytes: int = 32 << 20) -> tuple[str, DataFrame]:
    """Write all texts' ids in ascending id order; returns the folder and its manifest (file, part, n_docs, n_ids).

    The texts are range-sorted by id, and each range of about `file_bytes` of text becomes a file that ranks the
    ids by their use in it: one pass, no count of the whole corpus before the first file. A null text is empty
    and has the end id alone. Null ids come first; equal ids stand in the order of their text's hash and may be
    split over files. An empty table gives no files. Other columns are not read.
    """
    folder = folder or work_dir(docs.sparkSession, "token-ids")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), body.alias("t"))
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(max(1, -(-size // file_bytes)), "id", "h").sortWithinPartitions("id", "h")
    manifest = ordered.select("id", "t").mapInArrow(_writer(tokenizer, end_id, folder), "file string, part long, n_docs long, n_ids long")
    return folder, stage(manifest, "token-files")


def _counter(path: str, end_id: int):
    def count(batches):
        encoder = Encoder(path, end_id)
        for batch in batches:
            for piece in _pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(encoder(piece.column(1))[1])], names=["doc_id", "n_tokens"])
    return count


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens, the end id included, of every row; a null text has the end id alone."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    return rows.mapInArrow(_counter(tokenizer, end_id), "doc_id long, n_tokens long")


def read_token_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian u32) of every document."""
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids binary")
