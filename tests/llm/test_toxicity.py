from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dropledger.llm import toxicity as X

BAD = ("blargface", "zornwit", "grubdolt")


def corpus(n, seed, toxic_share=0.3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(10, 150))]
        label = int(rng.random() < toxic_share)
        if label:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words))
        labels.append(label)
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return X.train(*corpus(500, 1))


def test_held_out_accuracy(model):
    texts, labels = corpus(400, 2)
    scores = X.score_texts(pa.array(texts), *model.folded())
    assert ((scores >= X.THRESHOLD) == labels).mean() > 0.97


def test_unseen_misspellings_share_ngrams(model):
    texts, _ = corpus(60, 3, 0)
    bad = [t + " blargfaace zornwwit blargface's" for t in texts]
    weights = model.folded()
    assert (X.score_texts(pa.array(bad), *weights) > X.score_texts(pa.array(texts), *weights)).mean() > 0.95


def test_long_texts_are_not_diluted(model):
    texts, _ = corpus(30, 4, 0)
    long = " ".join(texts)
    weights = model.folded()
    clean, bad = X.score_texts(pa.array([long, long + " zornwit grubdolt " + long]), *weights)
    assert clean < X.THRESHOLD <= bad


def test_windows_and_grams_equal_brute_force():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 6, 7, 60):
        scores = rng.normal(size=n)
        begin, end, mean = X.worst_window(scores)
        spans = [(i, i + X.WINDOW) for i in range(n - X.WINDOW + 1)] or [(0, n)]
        best = max((scores[a:b].mean() if b > a else 0.0) for a, b in spans)
        assert abs(mean - best) < 1e-9 and (begin, end) in spans
    words = [b"", b"a", b"idiot", "é".encode()]
    grams, offsets = X.gram_buckets(words)
    assert np.diff(offsets).tolist() == [sum(max(0, len(w) + 3 - n) for n in X.GRAMS) for w in words]
    alone = [sorted(X.gram_buckets([w])[0]) for w in words]
    assert [sorted(grams[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)] == alone


def test_near_copies_count_once():
    texts, _ = corpus(20, 6)
    assert X.distinct_texts(texts + [t + " x" for t in texts[:5] if len(t.split()) > 80] + texts).tolist() == list(range(20))


def test_documents(spark):
    texts, labels = corpus(300, 7)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (901, "", "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(
        [(i, int(x)) for i, x in enumerate(labels)] + [(7, int(labels[7])), (None, 1), (999, None)], "doc_id long, toxic int")
    sample = X.training_sample(docs, marks).collect()
    assert sample and all(zlib.crc32(str(r[0]).encode()) % 3 != 1 for r in sample)
    got = X.score_documents(docs, X.fit(docs, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(by_id[i] >= X.THRESHOLD) == labels[i] for i in held]) > 0.9
    assert by_id[901] == by_id[None]
    none = X.fit(docs.limit(0), marks.limit(0))
    assert X.score_documents(docs.limit(0), none).count() == 0 and X.score_documents(docs, none).count() == len(rows)


def long_tail(n, seed, n_bad=120):
    """Texts of which a third are toxic by two of ``n_bad`` rare words, with and without punctuation."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    bad = ["".join(rng.choice("bcdfghkmpvwz") + rng.choice("aeiou") for _ in range(3)) for _ in range(n_bad)]
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = [rng.choice(vocab) + rng.choice(("", "", "", ",", ".")) for _ in range(rng.randrange(20, 80))]
        if i % 3 == 0:
            for k in (0, 7):
                words.insert(rng.randrange(len(words)), bad[(i // 3 + k) % n_bad] + rng.choice(("", ",", ".")))
        texts.append(" ".join(words))
    return texts, np.array([int(i % 3 == 0) for i in range(n)])


def test_held_out_recall_with_many_rare_toxic_words():
    model = X.train(*long_tail(1500, 1))
    texts, labels = long_tail(900, 2)
    found = X.score_texts(pa.array(texts), *model.folded()) >= X.THRESHOLD
    assert found[labels == 1].mean() > 0.95 and found[labels == 0].mean() < 0.02


def test_words_are_counted_without_punctuation():
    words = X.word_codes(pa.array(["word Word, (word)", "other word."]))
    assert words.words == [b"word", b"other"] and words.codes.tolist() == [0, 0, 0, 1, 0]
