from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codestrata.llm import token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
@settings(max_examples=200, deadline=None)
def test_code_round_trips(ranks):
    want = np.array(ranks, np.uint32)
    control, data = token_ids.encode(want)
    assert len(control) == -(-len(want) // 4)
    got, used = token_ids.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8))
    assert used == len(data) and got[: len(want)].tolist() == want.tolist() and not got[len(want):].any()


def test_encoder_agrees_with_whole_texts():
    tokenizer, encoder = Tokenizer.from_file(PATH), token_ids.Encoder(PATH, 1)
    texts = ["", None, "It's THE end. Isn't it?", "naïve café, e\u0301tude... ΑΣ. İstanbul", "a,b;c 'll've 12.5% <|endoftext|> x<|startoftext|>,y",
             "tab\tline\nform\x0cfeed\x0b \u00a0nbsp\u2003em", "don't,'s 's,'t ...,!? end.'s", "\U0001F600 smile,\u0301 a.\u0301b", "word " * 3000, "q" * 5000]
    ids, size = encoder(pa.array(texts, pa.string()))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@given(st.text(alphabet="aBé'.,!?;: \n\tst1<|>e\u0301ß", max_size=40))
@settings(max_examples=300, deadline=None)
def test_encoder_agrees_on_any_text(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids + [1]
    assert ENCODER(pa.array([text]))[0].tolist() == want


TOKENIZER, ENCODER = Tokenizer.from_file(PATH), token_ids.Encoder(PATH, 1)


def check(spark, docs, **options):
    folder, files = token_ids.write_token_ids(docs, PATH, 1, **options)
    rows = token_ids.read_token_ids(spark, folder, files).withColumn("crc", F.crc32("ids")).collect()
    texts = {}
    for d in docs.select("doc_id", "text").collect():
        texts.setdefault(d.doc_id, []).append(TOKENIZER.encode(d.text or "", add_special_tokens=False).ids + [1])
    rows.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == docs.count()
    at = 0
    for r in rows:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at and r.n_tokens == len(own) and r.crc == zlib.crc32(bytes(r.ids))
        texts[r.doc_id].remove(own)
        at += len(own)
    assert not any(texts.values())
    return files.count()


def test_files_round_trip(spark, awkward, sf):
    assert check(spark, awkward, file_bytes=60_000) > 2
    assert check(spark, spark.read.parquet(f"{sf}/documents.parquet"), file_bytes=100_000) > 2


def test_empty_table_has_no_files(spark, nothing):
    folder, files = token_ids.write_token_ids(nothing, PATH, 1)
    assert files.count() == 0 and token_ids.read_token_ids(spark, folder, files).count() == 0


def test_special_tokens_keep_their_case():
    texts = ["<|ENDOFTEXT|> a", "a<|EndOfText|>.b", "<|endoftext|> a", "X<|StartOfText|>,Y Z.<|startoftext|>!", "A.B,C; 'LL'VE DON'T.", "É.K. İ.A"]
    ids, size = ENCODER(pa.array(texts))
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_encoded_together():
    """Many words in one call, with letters that compose or have other letters as lower case, on a full and a fresh cache."""
    rng = np.random.default_rng(3)
    letters = list("abcxyzßéüñΣςΩжЖ한국語あ") + ["ﬁ", "ǰ", "ŉ"]
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(3500)]
    for extra in ([], ["İstanbul", "aİ"]):
        encoder = token_ids.Encoder(PATH, 1)
        texts = [" ".join(words[a : a + 250]) for a in range(0, len(words), 250)] + extra + ["", None]
        for given_texts in (texts, texts[::-1]):
            ids, size = encoder(pa.array(given_texts, pa.string()))
            want = [TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1] for t in given_texts]
            assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_known_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_ids, "_CACHE", 3)
    encoder = token_ids.Encoder(PATH, 1)
    for text in ("one two three four", "five one", "two, six don't"):
        assert encoder(pa.array([text]))[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [1]
