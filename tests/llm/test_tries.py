from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from dropledger.llm import tries as T


def brute(convs):
    """Rows of the trie of {conv_id: [(role, text), …]}."""
    members, out = {}, []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p, own in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in own if len(convs[c]) == len(p))
        childless = [q for q in below if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below)]
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own),
                    sum(len(q) == len(p) + 1 for q in below), len(childless),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def sequences_of(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def some_turns(seed, n=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, None if turn == 0 and rng.random() < 0.2 else turn, rng.choice(["user", None, "bot"]),
                         rng.choice([None, "", "hé", "yes", "tell me more", f"own {c}"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture()
def many_ranges(spark):
    """Shards of few rows each, so that boundaries cut everywhere."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("n", [6, 7, 8, 14, 15])
def test_id_hashes_of_any_number_of_pieces(spark, monkeypatch, n):
    monkeypatch.setattr(T, "PIECE_IDS", 7)
    rows = [(k, i) for k in (b"a", b"b", b"c") for i in range(n)]
    got = T.id_hashes(spark.createDataFrame(rows, "key binary, conv_id long").coalesce(1)).collect()
    want = hashlib.sha256(",".join(map(str, range(n))).encode()).digest()
    assert sorted((bytes(r.key), bytes(r.sha)) for r in got) == [(k, want) for k in (b"a", b"b", b"c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_contract_query(spark, tmp_dir, many_ranges, monkeypatch, seed):
    rows = some_turns(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_dir}/conversations.parquet")
    got = sorted(map(tuple, T.op13_conversation_trie(spark, tmp_dir).collect()), key=str)
    assert got == brute(rebuilt(sequences_of(rows)))


def test_copies_and_prefixes_over_many_shards(spark, many_ranges, monkeypatch):
    """One conversation many times, and others that are its beginnings."""
    monkeypatch.setattr(T, "PIECE_IDS", 7)
    turns = [("u", f"turn {d} " * d) for d in range(12)]
    convs = {c: turns[:(12 if c % 3 else c % 13)] for c in range(1, 160)}
    convs |= {c: [*turns[:c % 11], ("x", str(c % 4))] for c in range(200, 260)}
    rows = [(c, d, *t) for c, own in convs.items() for d, t in enumerate(own)]
    convs = {c: own for c, own in convs.items() if own}
    got = sorted(map(tuple, T.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str)
    assert got == brute(convs)


def test_tree_is_balanced_by_medians():
    assert sorted(T.by_medians(23)) == list(range(23)) and list(T.by_medians(3)) == [1, 0, 2]
    tree = T.TernaryTree()
    for i in T.by_medians(1023):
        tree.insert([i], [1])
    deepest = 0
    for i in range(1023):
        node, steps = tree.first[0], 0
        while tree.turn[node] != i:
            node, steps = (tree.less if i < tree.turn[node] else tree.more)[node], steps + 1
        deepest = max(deepest, steps)
    assert deepest == 9


def test_strange_tables(spark):
    rows = [(None, 1, "u", "lost"), (1, None, None, None), (1, None, None, None), (2, 5, "u", "x" * 300_000),
            (2, 5, "a", "first by role"), (-4, 1, "u", "neg")]
    docs = spark.createDataFrame([(*r, "k", 3, "i") for r in rows], SCHEMA + ", key string, size int, id string")
    got = sorted(map(tuple, T.conversation_trie(docs).collect()), key=str)
    assert got == brute(sequences_of(rows))
    assert T.conversation_trie(docs.limit(0)).collect() == []
    turnless = spark.createDataFrame([(7, [], []), (9, [], [])], "conv_id long, ids array<long>, sizes array<long>")
    assert [tuple(r) for r in T.prefix_trie(turnless).collect()] == [
        (7, 0, None, 2, 0, 1, 0, hashlib.sha256(b"7,9").hexdigest())]
