"""The trie of conversations against plain Python, cut at many splitters."""

import collections
import hashlib
import random
import zlib

import pytest

from graphloom.llm import conversation_trie
from graphloom.llm.conversation_trie import trie

SCHEMA = "conv_id long, turn int, role string, text string, path string, size long"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: (*x[:3], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))] for c, t in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + mine[h:])
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], digest[p]) for p, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def fixture():
    rng, out = random.Random(4), []
    for c in range(330):
        kind = rng.random()
        if kind < 0.35:  # one conversation, again and again
            turns = [("user", "hello"), ("assistant", "good day, what is it?"), ("user", "nothing")]
        elif kind < 0.6:
            turns = [("user", "hello"), *((rng.choice(("user", None)), rng.choice(("a", "b", "", None))) for _ in range(rng.randint(0, 5)))]
        else:
            turns = [("user", f"{rng.randint(0, 9)}"), *(("assistant", rng.choice("abcd🙂")) for _ in range(rng.randint(0, 12)))]
        if c != 200:
            out += [(c, k, *x, "p", 1) for k, x in enumerate(turns)]
    out += [(c, None, "user", "first of all", "p", 1) for c in (3, 3, 7, 150)]  # no number, one of them twice
    out += [(5, 0, "user", "tie"), (5, 0, "user", "another tie"), (-205, 0, "user", "x"), (-200, 0, "user", "y"), (10**12, 0, None, None), (None, 0, "user", "no conversation"), (None, None, None, None)]
    return [(*r[:4], "p", 1) for r in out]


@pytest.mark.parametrize(("shards", "chunk"), [(1, 1 << 20), (2, 40), (13, 40), (60, 1)])
def test_nodes(spark, shards, chunk, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SAMPLED", 8)
    rows = fixture()
    assert got(trie(spark.createDataFrame(rows, SCHEMA).repartition(3), shards, chunk)) == brute(rows)


def test_a_skeleton_keeps_its_bound(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "NODES", 30)
    rows = fixture() + [(900 + k, t, "user", f"{t}", "p", 1) for k in range(3) for t in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    paths = conversation_trie.rebuilt(conversation_trie.turns(df))
    assert len(conversation_trie.Skeleton(conversation_trie.splitters(paths, 50)).parents) <= 31
    assert got(trie(df, 50)) == brute(rows)


def test_a_very_long_conversation(spark):
    rows = [(c, t, "user", "yes" if t % 2 else "no", "p", 1) for c in (100, 106, 107) for t in range(250)]
    assert got(trie(spark.createDataFrame(rows, SCHEMA), 4)) == brute(rows)


def test_conversations_without_turns(spark):
    # Their own turns fall away, and there is no conversation 100 to take others from.
    few = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, 0, "user", "only one", "p", 1) for c in few]
    out = got(trie(spark.createDataFrame(rows, SCHEMA), 3))
    assert out == brute(rows) and len(out) == 1 and out[0][3] == 5


def test_an_empty_table(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
