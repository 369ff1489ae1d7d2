import random
import zlib

import numpy as np
import pytest

from llm.helpers import docs, rows_of, words
from salesloom.llm import linear, quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        text = words(rng.randrange(5, 80), i, 300)
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            at = rng.randrange(len(text))
            text = f"{text[:at]} {rng.choice(['idiot', 'moron', 'stupid', 'worthless'])} {text[at:]}"
        rows.append((i, text, "s"))
        if i % 5:
            labels.append((i, int(not bad), int(toxic), "x"))
    rows += [(900, None, "s"), (901, "", "s"), (902, words(30_000, 1, 300), "s"), (902, words(30_000, 1, 300), "s"), (None, "some text", None), (10, "second text of ten", "s")]
    labels += [(5000, 1, 1, "x"), (900, None, None, "x"), (3, 7, -1, "x"), (None, 1, 1, "x"), (1, 1, 0, "x")]
    return docs(spark, rows), spark.createDataFrame(labels, LABELS), rows


def test_updates_equal_the_plain_rule():
    rows = [(np.array([0, 2]), np.array([1.0, 0.5])), (np.array([1, 2]), np.array([2.0, 1.0])), (np.array([2]), np.array([1.0]))]
    y, alpha, beta, l1, l2 = np.array([1.0, 0.0, 1.0]), 0.3, 1.0, 0.05, 0.5
    z, n = [0.0] * 3, [0.0] * 3
    rng = np.random.default_rng(1)

    def weight(j):
        return 0.0 if abs(z[j]) <= l1 else -(z[j] - np.sign(z[j]) * l1) / ((beta + n[j] ** 0.5) / alpha + l2)

    for _ in range(3):
        for i in rng.permutation(3):
            at, x = rows[i]
            w = [weight(j) for j in at]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
            for j, v, old in zip(at, x, w):
                g = (p - y[i]) * v
                z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / alpha * old
                n[j] += g * g
    assert linear.fit(rows, y, 3, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=3, seed=1) == pytest.approx([weight(j) for j in range(3)])


def test_quality_of_held_out_rows(corpus):
    table, labels, rows = corpus
    got = quality.quality(table, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(i) for i, _, _ in rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    text = dict((i, t) for i, t, _ in rows[:500])
    own = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert len(own) > 50 and np.mean([r.predicted == int("!!" not in text[r.doc_id]) for r in own]) > 0.95


def test_labels_of_held_out_rows_never_train(corpus):
    table, labels, _ = corpus
    chosen = {r.key for r in quality.sample_of(table, labels, "doc_id", "text", "quality").collect()}
    assert chosen and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in chosen) and 5000 not in chosen
    assert quality.sample_of(table, labels, "doc_id", "text", "quality", sample=20).count() == 20


def test_toxic_words_are_caught(corpus):
    table, labels, rows = corpus
    got = toxicity.toxicity(table, labels)
    assert got.columns == ["doc_id", "p_insult", "p_contempt", "p_toxic", "rejected"]
    bad = {w for terms in toxicity.CATEGORIES.values() for w in terms}
    found = {(r.doc_id, r.rejected) for r in got.collect() if r.doc_id != 10}
    wanted = {(i, bool(bad & set((t or "").lower().split()))) for i, t, _ in rows if i != 10}
    assert len(found - wanted) <= 3 and not any(x for _, x in found - wanted)  # a few misses, no clean text
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == got.where("NOT rejected").count()


def test_later_models_read_earlier_categories(corpus):
    table, labels, _ = corpus
    names = [*toxicity.CATEGORIES, toxicity.LAST]
    models = toxicity.train_chain(toxicity.training_rows(table, labels, "doc_id", "text", "toxic"), names)
    assert [len(m) - (1 << toxicity.BITS) - 1 for m in models] == [0, 1, 2]
    assert models[-1][-2:].max() > 0


def test_without_labels_and_without_rows(spark, corpus):
    table, labels, rows = corpus
    none = labels.limit(0)
    assert {(r.score, r.predicted) for r in quality.quality(table, none).collect()} == {(0.5, 1)}
    assert not any(r.rejected for r in toxicity.toxicity(table, none).collect())
    assert quality.quality(docs(spark, []), labels).collect() == []
    assert toxicity.toxicity(docs(spark, []), labels).collect() == []
