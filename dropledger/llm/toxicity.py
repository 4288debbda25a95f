"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its character n-grams (3 to 5,
with marks at both ends, hashed to ``BUCKETS`` rows), a window of words the
average of its words, and a linear softmax over two classes scores it.  A
misspelling shares most n-grams with the word it is made from.  Embeddings and
softmax are trained together, in numpy, on a bounded sample of labelled rows.

Few toxic words in a long document would vanish in its average, so a document
scores as its worst window of ``WINDOW`` words (all windows, whole text; a
shorter text is one window).  Training follows the same rule: the first epochs
average whole documents, the later ones the window that scores worst.

For scoring, the softmax's difference of classes is folded into one weight for
each bucket (a table of constant size), and each different word of a batch is
hashed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import prepare, read_table, text_or_empty
from dropledger.llm.simhash import simhash

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
DIM = 8
WINDOW = 6
#: Bounds of the training sample: rows of each label, characters of a text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2500, 4000, 50_000
EPOCHS, WHOLE_EPOCHS, RATE = 60, 15, 0.05
#: Texts that training lays out at once.
DOCS_AT_ONCE = 500
#: Words whose n-grams are laid out at once in training.
FORMS_AT_ONCE = 20_000
#: Texts that a word must occur in to be learnt from; decay of the embeddings; misspellings of a word.
LEAST_TEXTS, DECAY, SPELLINGS = 3, 1e-5, 4
#: Least score that counts as toxic.
THRESHOLD = 0.7
SEED = 9


# ---------------------------------------------------------------- words

@dataclass
class Words:
    """Texts as codes of their different words."""

    codes: np.ndarray
    offsets: np.ndarray
    words: list[bytes]


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word (marked with < and >), and where each word's begin."""
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    places, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(data)) + n <= ends)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + data[at + k]
        value *= np.uint64(0x9E3779B97F4A7C15)
        places.append((value >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owners.append(owner[at])
    bucket, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


def word_codes(texts: pa.Array) -> Words:
    """Words are runs of other than ASCII blanks, in lower case, without punctuation at their ends."""
    lower = pc.utf8_lower(texts)
    lists = pc.split_pattern_regex(pc.utf8_trim(lower, " \t\n\x0b\x0c\r"), r"[ \t\n\x0b\x0c\r]+")
    coded = lists.flatten().dictionary_encode()
    number: dict[str, int] = {}
    bare = [number.setdefault(w.strip(".,;:!?\"'()[]{}"), len(number)) for w in coded.dictionary.to_pylist()]
    codes = np.array(bare, np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
    return Words(codes, lists.offsets.to_numpy().astype(np.int64), [w.encode() for w in number])


def _averages(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of ``values`` in each range of ``offsets``; 0 for an empty range."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    n = np.diff(offsets).astype(np.float64)
    sums = total[offsets[1:]] - total[offsets[:-1]]
    return sums / np.maximum(n, 1).reshape(-1, *[1] * (values.ndim - 1))


def worst_window(scores: np.ndarray, window: int | None = None) -> tuple[int, int, float]:
    """(begin, end, mean) of the window with the greatest mean score."""
    n, window = len(scores), window or WINDOW
    if n <= window:
        return 0, n, float(scores.mean()) if n else 0.0
    total = np.concatenate(([0.0], np.cumsum(scores)))
    means = (total[window:] - total[:-window]) / window
    at = int(means.argmax())
    return at, at + window, float(means[at])


# ---------------------------------------------------------------- model

@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM
    softmax: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def folded(self) -> tuple[np.ndarray, float]:
        """Weight of each bucket, and of none, in the difference of the classes."""
        side = self.softmax[:, 1] - self.softmax[:, 0]
        return (self.embedding @ side).astype(np.float32), float(self.bias[1] - self.bias[0])


class Forms:
    """N-grams of all spellings that training knows; what it lays out of them at once is bounded."""

    def __init__(self, forms: list[bytes]) -> None:
        parts = [gram_buckets(forms[i:i + FORMS_AT_ONCE]) for i in range(0, len(forms), FORMS_AT_ONCE)]
        self.grams = np.concatenate([g.astype(np.uint16) for g, _ in parts])  # BUCKETS is 2^16
        self.sizes = np.concatenate([np.diff(o) for _, o in parts])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _parts(self, forms: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for i in range(0, len(forms), FORMS_AT_ONCE):
            part = slice(i, i + FORMS_AT_ONCE)
            sizes = self.sizes[forms[part]]
            at = np.repeat(self.starts[forms[part]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            yield part, sizes, self.grams[at]

    def means(self, values: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Mean of the buckets' ``values`` over the n-grams of each of ``forms``."""
        out = np.zeros((len(forms), *values.shape[1:]))
        for part, sizes, grams in self._parts(forms):
            some = sizes > 0
            if some.any():
                sums = np.add.reduceat(values[grams], (np.cumsum(sizes) - sizes)[some], axis=0)
                out[part][some] = sums / sizes[some].reshape(-1, *[1] * (values.ndim - 1))
        return out

    def spread(self, values: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Sums by bucket of the ``values`` of ``forms``, each dealt evenly to its n-grams."""
        out = np.zeros((BUCKETS, values.shape[1]))
        for part, sizes, grams in self._parts(forms):
            dealt = values[part] / np.maximum(sizes, 1)[:, None]
            for d in range(values.shape[1]):
                out[:, d] += np.bincount(grams, weights=np.repeat(dealt[:, d], sizes), minlength=BUCKETS)
        return out


def misspelt(word: bytes, rng: np.random.Generator) -> bytes:
    """``word`` with one letter doubled, dropped, swapped with the next or masked."""
    if len(word) < 3:
        return word
    i, mask = int(rng.integers(1, len(word) - 1)), int(rng.integers(5))
    return (
        word[:i] + word[i:i + 1] + word[i:],
        word[:i] + word[i + 1:],
        word[:i] + word[i + 1:i + 2] + word[i:i + 1] + word[i + 2:],
        word[:i] + b"*@01x"[mask:mask + 1] + word[i + 1:],
    )[int(rng.integers(4))]


def distinct_texts(texts: list[str], bits: int = 6) -> np.ndarray:
    """Indices of the texts that aren't near copies (SimHash) of one before."""
    prints = np.array([simhash(t) for t in texts], np.uint64)
    kept: list[int] = []
    for i, p in enumerate(prints):
        if not kept or int(np.bitwise_count(prints[kept] ^ p).min()) > bits:
            kept.append(i)
    return np.array(kept, np.int64)


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Fit embeddings and softmax together by Adam on the mean cross-entropy.

    One text of each group of near copies counts.  Words of less than
    ``LEAST_TEXTS`` texts count in the averages but aren't learnt from, as they
    would only serve to learn single texts by heart; embeddings decay for the
    same reason.  In every epoch part of the words are misspelt, so
    that the weight of a word spreads over its n-grams.
    """
    rng = np.random.default_rng(SEED)
    model = Model(rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2))
    own = distinct_texts(texts)
    texts, labels = [texts[i] for i in own], labels[own]
    if not len(texts):
        return model
    words = word_codes(pa.array(texts, pa.string()))
    n_docs = len(texts)
    seen = np.zeros(len(words.words), np.int64)
    for lo, hi in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        seen[np.unique(words.codes[lo:hi])] += 1
    known = seen >= LEAST_TEXTS
    n_words = int(known.sum()) + 1  # 0 is any other word
    codes = np.where(known, np.cumsum(known), 0).astype(np.int32)[words.codes]
    spelt = [w for w, k in zip(words.words, known, strict=True) if k]
    forms = [b"", *spelt] + [x for _ in range(SPELLINGS) for x in (b"", *[misspelt(w, rng) for w in spelt])]
    table, every = Forms(forms), np.arange(len(forms))
    learnt = np.bincount(table.grams, minlength=BUCKETS) > 0
    model.embedding[~learnt] = 0
    params = [model.embedding, model.softmax, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target = np.eye(2)[labels]
    for epoch in range(EPOCHS):
        if epoch < WHOLE_EPOCHS:
            vectors = table.means(model.embedding, every)
        else:
            vectors, side = None, table.means(model.embedding @ (model.softmax[:, 1] - model.softmax[:, 0]), every)
        to_forms = np.zeros((len(forms), DIM))
        grads = [DECAY * model.embedding, np.zeros_like(model.softmax), np.zeros(2)]
        for first in range(0, n_docs, DOCS_AT_ONCE):
            ends = words.offsets[first:first + DOCS_AT_ONCE + 1]
            part, ends = codes[ends[0]:ends[-1]], ends - ends[0]
            spelling = rng.integers(-SPELLINGS, SPELLINGS + 1, len(part)).clip(0)  # about half as they are
            form = part + n_words * spelling
            begin, end = ends[:-1], ends[1:]
            if epoch >= WHOLE_EPOCHS:
                worst = np.array([worst_window(side[form[a:b]])[:2] for a, b in zip(begin, end, strict=True)])
                begin, end = begin + worst[:, 0], begin + worst[:, 1]
            size = end - begin
            owner = np.repeat(np.arange(len(size)), size)
            used = form[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            own_forms, used = np.unique(used, return_inverse=True)
            bag_vectors = table.means(model.embedding, own_forms) if vectors is None else vectors[own_forms]
            weight = (1 / np.maximum(size, 1))[owner]
            bags = np.column_stack([np.bincount(owner, weights=bag_vectors[used, d] * weight, minlength=len(size))
                                    for d in range(DIM)])
            logits = bags @ model.softmax + model.bias
            share = np.exp(logits - logits.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            slope = (share - target[first:first + DOCS_AT_ONCE]) / n_docs
            grads[1] += bags.T @ slope
            grads[2] += slope.sum(axis=0)
            to_bags = slope @ model.softmax.T
            for d in range(DIM):
                to_forms[own_forms, d] += np.bincount(used, weights=to_bags[owner, d] * weight, minlength=len(own_forms))
        touched = np.flatnonzero(to_forms.any(axis=1))
        grads[0] += table.spread(to_forms[touched], touched)
        grads[0][~learnt] = 0
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            step = RATE * math.sqrt(1 - 0.99 ** (epoch + 1)) / (1 - 0.9 ** (epoch + 1))
            p -= step * m / (np.sqrt(v) + 1e-8)
    return model


def score_texts(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Share of the toxic class in the worst window of each text."""
    words = word_codes(texts)
    grams, gram_offsets = gram_buckets(words.words)
    by_word = _averages(weights[grams].astype(np.float64), gram_offsets)[words.codes]
    logits = np.array([worst_window(by_word[a:b])[2] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)])
    return 1 / (1 + np.exp(-np.clip(logits + bias, -500, 500)))


# ---------------------------------------------------------------- on tables

def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """(text, label): labelled rows that aren't held out, about SAMPLE_TOXIC and SAMPLE_CLEAN by a hash of the id."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in usable.groupBy("_label").count().collect()}
    share = F.when(F.col("_label") == 1, SAMPLE_TOXIC / max(counts.get(1, 0), 1)).otherwise(
        SAMPLE_CLEAN / max(counts.get(0, 0), 1))
    place = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) / 1_000_000
    chosen = usable.where(place < share)
    texts = docs.select(F.col(id_col), text_or_empty(F.col(f"`{text_col}`")).alias("_text")).where(
        F.length("_text") <= SAMPLE_CHARS)
    return texts.join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("_id"), "_text", "_label")


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) learnt from the bounded sample, in one task; only these reach the driver."""
    prepare(docs.sparkSession)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_text"], ignore_index=True)
        weights, bias = train(rows["_text"].tolist(), rows["_label"].to_numpy(np.int64)).folded()
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    sample = training_sample(docs, labels, **columns)
    learnt = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, "weights binary, bias double").collect()
    if not learnt:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(learnt[0].weights, np.float32), learnt[0].bias


def toxicity_score(text: Column, learnt: tuple[np.ndarray, float]) -> Column:
    weights, bias = learnt

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = [score_texts(pa.array(texts.iloc[i:i + 2000], pa.string()), weights, bias)
                   for i in range(0, len(texts), 2000)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
    batches.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "double")(text)


def score_documents(docs: DataFrame, learnt: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row.

    A null or empty text scores as the softmax's bias alone.  Repeated rows
    and null ids stay; other columns aren't read.  Without any label every
    row scores 0.5.
    """
    prepare(docs.sparkSession)
    return docs.select(id_col, toxicity_score(text_or_empty(F.col(f"`{text_col}`")), learnt).alias("score"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_documents(docs, learnt).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
