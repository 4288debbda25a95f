from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from dropledger.llm import simhash as H


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def near_prints(seed, n=300):
    """Random fingerprints with chains and clouds of near ones."""
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(prints) < n:
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.choice((1, 2, 3))):
            p ^= 1 << b
        prints.append(p)
    return sorted(set(prints))


def test_fingerprints_equal_brute_force():
    texts = [None, "", " \t\n", "One", "One two", "one TWO three", "Ä b c D e", "x\x0by\x1cz a\x85b c d",
             "the cat sat " * 40, " ".join(f"w{i}" for i in range(70_000))]
    assert [H.simhash(t) for t in texts[:-1]] == [brute_print(t) for t in texts[:-1]]
    hashes = np.array([xxhash.xxh64_intdigest(f"w{i} w{i + 1} w{i + 2}".encode(), 42) for i in range(69_998)], np.uint64)
    ones = [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert H.simhash(texts[-1]) == sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))


def test_trie_gives_all_links_in_small_slices():
    prints = np.array(near_prints(3), np.uint64)
    nodes = np.array([(0, len(prints), 0, len(prints))])
    got = {tuple(sorted((int(a), int(b)))) for x, y in H.linked_pairs(prints, nodes, top=0, most=16)
           for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))
            if int(np.bitwise_count(prints[i] ^ prints[j])) <= 2}
    assert got == want and len(want) > 50


def check(spark, prints, ids=None):
    ids = ids or list(range(len(prints)))
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in zip(ids, prints, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.fp: r["first"].id for r in H.component_roots(df).collect()}
    roots = brute_components(prints)
    want = {}
    for (_, fp), root in zip(rows, roots, strict=True):
        want[fp] = min(ids[k] for k in range(len(ids)) if roots[k] == root)
    assert got == want


def test_components_equal_brute_force(spark):
    check(spark, near_prints(5))


def test_large_tasks_are_split(spark, monkeypatch):
    monkeypatch.setattr(H, "MOST_ROWS", 40)
    rng = random.Random(7)
    base = rng.getrandbits(64) & ~((1 << 42) - 1)
    cloud = {base | rng.getrandbits(42) for _ in range(60)}
    cloud |= {p ^ (1 << rng.randrange(42)) ^ (1 << rng.randrange(42)) for p in list(cloud)}
    check(spark, sorted(cloud))


def test_documents(spark):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    near = text.replace("w200 ", "w200x ")
    rows = [(5, text, "a"), (3, near, "a"), (9, text.upper(), "b"), (7, "quite different words here", "c"),
            (8, None, None), (None, "", None), (2, "  ", None), (7, "quite different words here", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in H.near_duplicates(docs).collect()]
    prints = [brute_print(t) for _, t, _ in rows]
    roots = brute_components(prints)
    want = []
    for i, (d, _, _) in enumerate(rows):
        want.append((d, min(x[0] for k, x in enumerate(rows) if roots[k] == roots[i] and x[0] is not None)))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = H.drop_near_duplicates(docs).collect()
    assert len(kept) == len(set(roots)) and {r.doc_id for r in kept} == {c for _, c in want}
    assert H.near_duplicates(docs.limit(0)).count() == 0 and H.drop_near_duplicates(docs.limit(0)).count() == 0


def test_any_column_name_is_kept(spark):
    names = ("_key", "_none", "_fp", "_again", "_own", "_id", "fp", "root", "first")
    rows = [(i, f"one two three four five {i // 2 * 2}", *[f"{c} {i}" for c in names]) for i in range(8)]
    out = H.drop_near_duplicates(spark.createDataFrame(rows, ["doc_id", "text", *names]))
    assert out.columns == ["doc_id", "text", *names]
    assert sorted(map(tuple, out.collect())) == [r for r in rows if r[0] % 2 == 0]
