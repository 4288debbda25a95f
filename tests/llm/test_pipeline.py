"""The pipeline against a brute-force version of its stages, and the registration of all queries."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from dropledger.llm import catalog, packing
from tests.llm.test_quality import brute_kept, brute_statistics
from tests.llm.test_secrets import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_print

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents():
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs = []
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(rng.randrange(55, 400))]
        if i % 11 == 0:
            words = [w + "$$$" for w in words]
        if i % 13 == 0:
            words = words[:30]
        if i % 9 == 0:
            words.insert(20, "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"")
        docs.append((i, " ".join(words), rng.choice(("en", "de")), rng.choice(("s0", "s0", "s1"))))
    for i in range(0, 40, 4):  # copies, near and exact, with larger and smaller ids
        docs.append((1000 + i, docs[i][1], docs[i][2], docs[i][3]))
        docs.append((-1000 - i, docs[i + 1][1] + " tail", docs[i + 1][2], docs[i + 1][3]))
    docs += [(5, docs[5][1], docs[5][2], docs[5][3]), (None, docs[6][1], "en", "s0"), (3000, None, "en", None), (3001, "", None, "s1"),
             (None, "null id " + docs[7][1][::-1], "de", "s1")]
    rng.shuffle(docs)
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in docs]


def brute(docs):
    groups, members = defaultdict(list), defaultdict(list)
    for d in docs:
        words, chars, symbols, lines, dup, repeat = brute_statistics(d[1])
        if words >= 50 and 100 * repeat <= 50 * words:
            groups[d[2] or "", d[3] or ""].append([math.floor(1000 * v + 0.5) for v in (
                math.log(chars / words), math.log1p(symbols / words), math.log1p(dup / lines), math.log1p(repeat / words))])
            members[d[2] or "", d[3] or ""].append(d)
    good = [d for key, kept in brute_kept(groups).items() for d, k in zip(members[key], kept, strict=True) if k]
    roots = brute_components([brute_print(d[1]) for d in good])
    best = {}
    for d, root in zip(good, roots, strict=True):
        rank = (d[0] is None, d[0] or 0, np.uint64(brute_print(d[1])).astype(np.int64), d[1])
        if root not in best or rank < best[root][0]:
            best[root] = (rank, d)
    kept = [d for _, d in best.values()]
    clean = []
    for d in kept:
        text, at, out = d[1], 0, ""
        for a, _, b in brute_spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        clean.append((d[0], out + text[at:], d[2], d[3]))
    return good, kept, clean


def test_stages_equal_brute_force(spark, tmp_dir):
    docs = make_documents()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    table = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    good, kept, clean = brute(docs)
    assert len(docs) > len(good) > len(kept) > 100
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, tmp_dir).write.parquet(f"{tmp_dir}/{name}")
        table = spark.read.parquet(f"{tmp_dir}/{name}")
        seen.append(table)
    for df, want in zip(seen[:4], (good, kept, clean, clean), strict=True):
        assert df.schema.simpleString() == seen[0].schema.simpleString() and df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect()) == Counter(d[:4] for d in want)
    assert all(r.n_chars == len(r.text) for r in seen[2].collect())
    assert any("[SECRET]" in r.text for r in seen[2].collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, text, *_ in clean:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID], "<u4")
        pieces.update((i, p, s, n, zlib.crc32(ids[s:s + n].tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids))))
    rows = seen[4].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    # Sequences follow the mixed order: their first documents are those of a rising place.
    laid = [(r.doc_id, r.text) for f in sorted(os.listdir(f"{tmp_dir}/source_mixing")) if f.endswith(".parquet")
            for r in spark.read.parquet(f"{tmp_dir}/source_mixing/{f}").collect()]
    place = {}
    for k, (i, _) in enumerate(laid):
        place.setdefault(i, k)
    firsts = defaultdict(list)
    for r in rows:
        if Counter(i for i, _ in laid)[r.doc_id] == 1:
            firsts[r.sequence_id].append(place[r.doc_id])
    order = [min(firsts[q]) for q in sorted(firsts)]
    assert len(order) > 20 and order == sorted(order)
    whole = corpus_pipeline.run(spark, tmp_dir)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_stages_take_an_empty_table(spark, tmp_dir):
    table = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, tmp_dir).write.parquet(f"{tmp_dir}/{name}")
        table = spark.read.parquet(f"{tmp_dir}/{name}")
        assert table.count() == 0


def test_source_shares_follow_the_targets_along_the_sequences(spark, tmp_dir, monkeypatch):
    """Packing runs of few pieces: any first part of the sequences has the shares of the mixed order, not of the table."""
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 60)
    docs = [(i, f"w{i} " * 120, "en", "big" if i < 900 else "small", 0) for i in range(1000)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    table = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    shares = []
    for stage in (corpus_pipeline.source_mixing, lambda spark, docs, sf_dir: docs):
        out = f"{tmp_dir}/mixed{len(shares)}"
        stage(spark, table, tmp_dir).write.parquet(out)
        rows = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(out), tmp_dir).collect()
        begun = sorted(rows, key=lambda r: r.sequence_id)[:len(rows) * 3 // 10]
        shares.append(sum(r.doc_id >= 900 for r in begun) / len(begun))
    # Weights are the roots of 900 and 100: a quarter, until the small source ends with 400 of 1000 documents.
    assert 0.22 < shares[0] < 0.28 and shares[1] < 0.2


def test_all_queries_are_registered():
    queries, sql = catalog.load()
    assert sorted(int(k[2:].split("_")[0]) for k in queries if k.startswith("op")) == list(range(1, 14)) and "pipeline" in queries
    assert {"op2_secret_scans", "op5_url_filters", "op6_warc", "op7_quality_rules"} <= set(sql) <= set(queries)


def test_native_operators_have_no_python(spark):
    for name in ("mixing", "quality", "secrets", "url_filters"):
        with open(os.path.join(os.path.dirname(catalog.__file__), f"{name}.py"), encoding="utf-8") as fh:
            text = fh.read()
        assert not any(x in text for x in ("pandas", "udf", "mapIn", "applyIn", "pyarrow", ".rdd"))
