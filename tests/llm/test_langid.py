from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import langid


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_forward_backward_agrees_with_all_paths(seed):
    rng = np.random.default_rng(seed)
    labels, size = int(rng.integers(1, 4)), rng.integers(0, 5, 4)
    scores, move, start = rng.normal(size=(int(size.sum()), labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)
    marginal, moves = langid.forward_backward(scores, size, move, start)
    at, want_moves = 0, np.zeros_like(move)
    for n in size.tolist():
        if not n:
            continue
        paths = list(itertools.product(range(labels), repeat=n))
        weight = np.array([np.exp(start[p[0]] + sum(scores[at + i, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        weight /= weight.sum()
        for i in range(n):
            want = [sum(w for w, p in zip(weight, paths, strict=True) if p[i] == k) for k in range(labels)]
            assert np.allclose(marginal[at + i], want)
        for w, p in zip(weight, paths, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                want_moves[a, b] += w
        at += n
    assert np.allclose(moves, want_moves)


def test_words_are_runs_of_letters():
    flat, size = langid.words_of(pa.array(["Ça va, l'Été? 12", None, "", "1 2 !", "x9y"]))
    assert flat.to_pylist() == ["ça", "va", "l", "été", "x", "y"] and size.tolist() == [4, 0, 0, 0, 2]


def test_switched_words_get_their_own_language():
    rng = np.random.default_rng(1)
    tongues = ["the of and with thing reading writing".split(), "ñandú cómo está niño mañana señor qué".split()]
    samples = [(k, [str(w) for w in rng.choice(t, 40)]) for k, t in enumerate(tongues) for _ in range(30)]
    model = langid.fit(samples, ["en", "es"])
    assert (np.diag(model.transition) > model.transition[::-1].diagonal()).all()
    text = [str(w) for w in (*rng.choice(tongues[0], 12), "mixed", *rng.choice(tongues[1], 12))]
    marginal, _ = langid.forward_backward(model.scores(text), np.array([len(text)]), model.transition, model.start)
    assert marginal[:12].argmax(axis=1).tolist() == [0] * 12 and marginal[13:].argmax(axis=1).tolist() == [1] * 12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.trained(docs.where(~langid.held_out()).select("text", "lang"))
    rows = langid.predicted(docs.where(langid.held_out()), model)
    assert rows.select(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98
    again = langid.trained(docs.repartition(5).where(~langid.held_out()).select("text", "lang"))
    assert again.labels == model.labels and np.allclose(again.emission, model.emission)


def test_awkward_rows(awkward, nothing):
    model = langid.trained(awkward)
    assert model.labels == ["en", "fr"]
    rows = langid.predicted(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r.row.text is None or not any(c.isalpha() for c in r.row.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.labels and 0 < r.score <= 1
    assert langid.trained(nothing) is None
    assert {r.lang_pred for r in langid.predicted(awkward, None).collect()} == {"und"}
    assert langid.predicted(nothing, model).count() == 0


def test_long_runs_are_cut_into_words_without_loss():
    flat, size = langid.words_of(pa.array(["a" * 24, "b" * 25 + "!", "É" * 48 + " x", "", "y " + "字" * 50]))
    assert flat.to_pylist() == ["a" * 24, "b" * 24, "b", "é" * 24, "é" * 24, "x", "y", "字" * 24, "字" * 24, "字" * 2] and size.tolist() == [1, 2, 3, 0, 4]


def test_letters_inside_long_runs_decide(spark):
    rng = np.random.default_rng(6)
    inner = lambda letters: "".join(rng.choice(list(letters), 60))
    rows = [(i, "q" * 16 + inner(letters) + "z" * 8, lang) for i, (letters, lang) in enumerate([("abcde", "aa"), ("vwxyu", "bb")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(docs.where("doc_id < 60").select("text", "lang"))
    got = langid.predicted(docs.where("doc_id >= 60"), model).collect()
    assert len(got) == 20 and all(r.lang_pred == r.row.lang for r in got)


def test_rare_labels_of_many_are_learnt(spark):
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for k in range(120):
        own = ["".join(rng.choice(letters, 6)) for _ in range(12)]
        # The last label by count and by name has two texts, the others have twelve.
        rows += [(f"{'zz' if k == 119 else 'l'}{k:03d}", " ".join(rng.choice(own, 30))) for _ in range(2 if k == 119 else 12)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    model = langid.trained(docs, sample_words=30, sample_total=700)
    assert len(model.labels) == 120
    rare = langid.predicted(docs.where("lang = 'zz119'"), model).collect()
    assert [r.lang_pred for r in rare] == ["zz119"] * 2
