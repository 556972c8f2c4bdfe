"""Compression distance: windows, gains one by one, held-out rows, odd tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fieldspark.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def _texts(rng, n, *extra):
    letters = random.Random(0)
    plain = ["river", "stone", "window", "music", *("".join(letters.choices("abdeghilmnoprstu", k=letters.randint(3, 8))) for _ in range(400))]
    return [" ".join(rng.choice(extra if extra and k % 8 == 0 else plain) for k in range(rng.randint(8, 60))).encode() for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return toxicity.Model([t + b" blorgface" for t in _texts(rng, 60, "blorgface", "zurkwit")], _texts(rng, 300), 0.2)


def test_windows_cover_texts():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab \n.") for _ in range(rng.choice([0, 1, 63, 64, 65, 200, 1000]))) for _ in range(200)] + [b"x" * 5000, b" " * 300]
    data, start, size, text = toxicity.windows(texts)
    assert (size > 0).all() and (size < toxicity.WINDOW + toxicity.SNAP).all()
    for i, t in enumerate(texts):
        own = text == i
        assert b"".join(data[a : a + n].tobytes() for a, n in zip(start[own], size[own], strict=True)) == t
    alone = [[n for n in toxicity.windows([t])[2]] for t in texts]
    assert [list(size[text == i]) for i in range(len(texts))] == alone  # neighbours in a batch don't matter


def test_segments_are_the_contrast(model):
    assert any(s.strip() in b" blorgface " for s in model.segments) and any(s.strip() in b" zurkwit " for s in model.segments)
    assert not any(w in s for s in model.segments for w in (b"river", b"stone", b"music"))


def test_scores_equal_window_by_window(model):
    texts = [*_texts(random.Random(3), 40, "zurkwit"), b"", b"x", b"River Zurkwit stone"]
    got = model.score(texts)
    made = [tuple(toxicity._compressor(x, *setting) for x in (model.ordinary, model.toxic)) for setting in toxicity.SETTINGS]
    for t, score in zip(texts, got, strict=True):
        if not t:
            assert score == model.prior
            continue
        data, start, size, _ = toxicity.windows([t])
        cut = [data[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
        row = []
        for plain, toxic in made:
            gain = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in cut])
            row += [max(-5, gain.max()), gain.mean()]
            for least in toxicity.THRESHOLDS:
                row += [np.log1p((gain >= least).sum()), (gain >= least).mean()]
        z = np.append((np.array(row) - model.mean) / model.scale, 1) @ model.weights
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_long_texts_take_their_worst_slice(model, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", toxicity.WINDOW * 4)
    text = b"river stone window " * 40
    bad = text + b"blorgface zurkwit " * 20 + text
    parts = [bad[a : a + toxicity.SLICE] for a in range(0, len(bad), toxicity.SLICE)]
    assert model.score([bad])[0] == max(model.score([p])[0] for p in parts)
    assert model.score([bad])[0] > 0.5 > model.score([text])[0]


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    true = sum(r["predicted"] and r["toxic"] for r in got)
    assert true >= 0.7 * sum(r["toxic"] for r in got)
    assert true >= 0.9 * sum(r["predicted"] for r in got)


def test_odd_rows_and_missing_classes(spark):
    shape = "doc_id long, text string, score string"
    rows = [(1, None, "a"), (2, "", "b"), (3, "You idiot", "c"), (3, "You idiot", "c"), (None, "plain words here", None), (4, "w" * 20_000, "d"), (5, " \n\t", "e")]
    docs = spark.createDataFrame(rows, shape)
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.where("toxic > 5")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} in ({1.0}, {0.0})
    assert toxicity.score(spark.createDataFrame([], shape), labels).collect() == []
    assert toxicity.score(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
