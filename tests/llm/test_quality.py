from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dropledger.llm import quality as Q


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(covered))


def core_moments(x, weights):
    mean = (weights[:, None] * x).sum(axis=0) / weights.sum()
    d = x - mean
    return mean, (weights[:, None, None] * d[:, :, None] * d[:, None, :]).sum(axis=0) / weights.sum()


def brute_estimate(rows, steps=Q.STEPS):
    """(mean, covariance, determinants of each start) by the same steps in numpy."""
    x, floors, factor = np.array(rows, float), np.diag(np.array(Q.FLOORS, float) ** 2), Q.consistency(Q.CORE)
    n, half = len(x), (len(x) + Q.P + 1) // 2
    middle = lambda v: np.array([sorted(c)[(n - 1) // 2] for c in v.T])
    origin = middle(x)
    whole = core_moments(x, np.ones(n))
    found, falls = [], []
    for mean, cov in ((origin, floors), (origin, floors + np.diag((Q.SPREAD * middle(abs(x - origin))) ** 2)), (whole[0], whole[1] + floors)):
        dets = [np.inf]
        for _ in range(steps):
            d = x - mean
            bins = np.floor(Q.BINS * np.log1p(np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d)))
            weights = np.array([np.clip((half - (bins < b).sum()) / (bins == b).sum(), 0, 1) for b in bins])
            m, c = core_moments(x, weights)
            c = c * factor + floors
            if not np.linalg.det(c) < dets[-1] * (1 - Q.GAIN):
                break
            mean, cov = m, c
            dets.append(np.linalg.det(c))
        found.append((dets[-1], len(found), mean, cov))
        falls.append(dets)
    _, _, mean, cov = min(found, key=lambda f: f[:2])
    return mean, cov, falls


def brute_kept(groups):
    """Verdict of each vector; groups: key -> rows."""
    out = {}
    for key, rows in groups.items():
        mean, cov, _ = brute_estimate(rows)
        d = np.array(rows, float) - mean
        out[key] = np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d) <= Q.chi_square_quantile(Q.QUANTILE, Q.P)
    return out


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l1\nl1\n \nl2\r\nl1\x0b\n\n", "é# $ü\n%%\n%%",
         "a b c d a b c d e a b", "\x1c \x85word　too"]


def test_statistics_equal_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(n)) for n in (10, 60, 300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r._n_words, r._word_chars, r._n_symbols, r._n_lines, r._n_dup_lines, r._n_repeat_words)
           for r in Q.text_statistics(docs).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def make_docs(n=400):
    rng = random.Random(11)
    docs = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(55, 200))]
        if i % 20 == 0:
            words = [w + rng.choice(("###", "$$$")) for w in words]
        if i % 37 == 0:
            words = words[:20]
        lang, source = rng.choice((("en", "s0"), ("en", "s0"), ("de", "s1"), (None, None)))
        docs.append((i, " ".join(words), lang, source))
    docs.append((n, docs[1][1] + "x", "fr", "alone"))
    return docs + [docs[3]] * 2 + [(None, None, "en", "s0")]


def test_verdicts_equal_brute_force(spark):
    docs = make_docs()
    got = Q.judge_quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(docs)
    groups, members = defaultdict(list), defaultdict(list)
    want = {}
    for i, (_, text, lang, source) in enumerate(docs):
        words, chars, symbols, lines, dup, repeat = brute_statistics(text)
        want[i] = False
        if words >= 50 and 100 * repeat <= 50 * words:
            vector = [math.floor(1000 * v + 0.5) for v in (
                math.log(chars / words), math.log1p(symbols / words), math.log1p(dup / lines), math.log1p(repeat / words))]
            groups[lang or "", source or ""].append(vector)
            members[lang or "", source or ""].append(i)
    for key, verdicts in brute_kept(groups).items():
        want.update(zip(members[key], map(bool, verdicts), strict=True))
    assert Counter((r.doc_id, r.text, r._kept) for r in got) == Counter(
        (d[0], d[1], want[i]) for i, d in enumerate(docs))
    junk = {d[0] for d in docs if d[1] and ("###" in d[1] or "$$$" in d[1])}
    long_enough = {r.doc_id for r in got if not r._base_failed}
    assert {r.doc_id for r in got if not r._kept and not r._base_failed} == junk & long_enough


def judged_vectors(spark, rows):
    """Which of the vectors (as thousandths) of one group are kept."""
    df = spark.createDataFrame([("en", "s", *map(int, r)) for r in rows], "_lang string, _source string, _v0 long, _v1 long, _v2 long, _v3 long")
    est = Q.mcd_estimates(df).first()
    mean = np.array([est[f"m{i}"] for i in range(Q.P)])
    low = np.array([[est[f"c{i}{j}"] if j <= i else 0.0 for j in range(Q.P)] for i in range(Q.P)])
    z = np.linalg.solve(low, (np.array(rows, float) - mean).T)
    return (z ** 2).sum(axis=0) <= Q.chi_square_quantile(Q.QUANTILE, Q.P)


def clean_rows(rng, n):
    return np.column_stack([rng.normal(1600, 60, n), np.abs(rng.normal(0, 25, n)), np.zeros(n), np.zeros(n)]).round()


@pytest.mark.parametrize("share", [0.2, 0.34, 0.45])
@pytest.mark.parametrize("junk", [(2100, 900, 0, 0), (1600, 0, 0, 380), (1250, 300, 200, 0)])
def test_copies_of_one_junk_text_are_rejected(spark, share, junk):
    rng = np.random.default_rng(int(100 * share))
    good, bad = clean_rows(rng, int(1000 * (1 - share))), np.tile(junk, (int(1000 * share), 1))
    kept = judged_vectors(spark, np.vstack([good, bad]))
    assert not kept[len(good):].any() and kept[:len(good)].mean() > 0.99


@pytest.mark.parametrize("junk", [(2000, 0, 0, 0), (1600, 500, 0, 0), (1600, 0, 405, 0), (1600, 0, 0, 375)])
def test_each_statistic_rejects_alone(spark, junk):
    """Word length, symbols, half of the lines repeated, 50 of 110 words repeated: all others as usual."""
    good = clean_rows(np.random.default_rng(1), 300)
    kept = judged_vectors(spark, np.vstack([good, [junk]]))
    assert not kept[-1] and kept[:-1].mean() > 0.99


def test_determinants_fall_and_settle():
    rng = np.random.default_rng(5)
    for share in (0, 0.3, 0.45):
        rows = np.vstack([clean_rows(rng, int(400 * (1 - share))), np.tile((2000, 700, 300, 300), (int(400 * share), 1))])
        _, _, falls = brute_estimate(rows, 50)
        assert all(a > b for dets in falls for a, b in zip(dets, dets[1:], strict=False))
        assert max(map(len, falls)) <= Q.STEPS  # all starts end before the steps do


NAMES = ("m0", "c00", "_w", "_t", "_own", "_text", "_lang", "n", "start", "det", "_v0", "a.b")


def test_any_column_name_is_kept(spark):
    docs = make_docs(60)
    rows = [(*d, *[f"{c} {k}" for c in NAMES]) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *NAMES])
    judged = Q.judge_quality(df).collect()
    assert Counter(tuple(r)[:len(df.columns)] for r in judged) == Counter(rows)
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r)[:len(df.columns)] for r in judged if r["_kept"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.judge_quality(docs).count() == 0


def test_quantile_and_consistency():
    assert abs(Q.chi_square_quantile(0.95, 4) - 9.4877) < 1e-3
    draws = np.random.default_rng(0).normal(size=(200_000, 4))
    d2 = (draws ** 2).sum(axis=1)
    core = draws[d2 <= np.quantile(d2, Q.CORE)]
    assert abs(Q.consistency(Q.CORE) * core.var(axis=0).mean() - 1) < 0.02
