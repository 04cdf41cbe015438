import hashlib
import random

import numpy as np
import pytest

from millrace.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, n_convs long, at string"


def slow(convs):
    """All nodes of sequences of (role, text) by conversation id."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    rows, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = (0 if p in children else 1), (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in children.get(p, []):
            leaves, saved = leaves + sums[q][0], saved + sums[q][1]
        sums[p] = leaves, saved
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        up = min(members[p[:-1]]) if p else None
        rows.append((min(members[p]), len(p), up, len(members[p]), len(children.get(p, [])), leaves, saved, digest))
    return sorted(rows, key=repr)


def by_conversation(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    return {c: tuple(t[3] for t in sorted(v)) for c, v in out.items()}


def trie(spark, rows, extra=(), **settings):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    turns = C.ranked_turns(table)
    members = table.select("conv_id").where("conv_id IS NOT NULL").distinct()
    if extra:
        members = members.union(spark.createDataFrame([(c,) for c in extra], "conv_id long"))
    return sorted(map(tuple, C.trie_of(turns, members, **settings).collect()), key=repr)


def made(seed, convs=120, deep=9, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, deep)):
            rows.append((c - 20, t, rng.choice(["user", "bot", None]), "é" * rng.randrange(words), 5, "x"))
    return rows


@pytest.mark.parametrize("seed,batch,subtree", [(0, 4096, 1 << 19), (1, 6, 1 << 19), (2, 2, 12), (3, 1, 3)])
def test_against_all_prefixes(spark, seed, batch, subtree):
    rows = made(seed)
    assert trie(spark, rows, batch=batch, subtree_turns=subtree) == slow(by_conversation(rows))


def test_awkward_rows(spark):
    rows = made(4, 30)
    rows += [(None, 0, "user", "lost", 0, None), (50, None, "user", "no turn", 0, None), (50, None, None, None, 0, None), (50, 3, "user", "x", 0, None), (50, 3, "user", "x", 0, None)]
    rows += [(51, 0, "user", "a" * 100_000, 0, None), (51, 1, "us", "era", 0, None), (52, 0, "user", "a" * 100_000, 0, None), (52, 1, "user", "a", 0, None)]
    rows += [(60 + i, t, "user", f"line {t}", 0, None) for i in range(40) for t in range(300 + i)]
    want = by_conversation(rows) | {900: (), 901: ()}
    assert trie(spark, rows, extra=[900, 901], batch=16) == slow(want)


def test_copies(spark):
    """A third of all conversations are one, another third share their first turn only."""
    rows = [(c, t, "user", str(t), 0, None) for c in range(0, 600, 2) for t in range(3)]
    rows += [(c, t, "user", "0" if t == 0 else f"{c} {t}", 0, None) for c in range(1, 600, 2) for t in range(3)]
    assert trie(spark, rows, batch=8) == slow(by_conversation(rows))


def test_no_conversations(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x", 0, None)]) == []


def test_two_fattest():
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    zeros = lambda n: (n & -n).bit_length()
    want = [max(range(a + 1, b + 1), key=zeros) for a, b in pairs]
    assert C.two_fattest(*np.array(pairs, np.int64).T).tolist() == want


def test_exits_against_comparison():
    rng = random.Random(7)
    sample = lambda n: [tuple(rng.randrange(2) for _ in range(rng.randrange(1, 20))) for _ in range(n)]

    def hashed(seqs):
        cuts = np.cumsum([0, *map(len, seqs)])
        letters = np.random.default_rng(1).integers(0, 1 << 63, (2, 2), dtype=np.uint64)
        return *C._prefix_hashes(letters[[x for s in seqs for x in s]], cuts), cuts

    known = sorted(set(sample(60)))
    trie = C.ZFastTrie(*hashed(known))
    asked = sample(400) + known
    at, depth = trie.locate(*hashed(asked))
    prefixes = {s[:d] for s in known for d in range(len(s) + 1)}
    place = {}
    for s, a, d in zip(asked, at.tolist(), depth.tolist()):
        assert d == max(k for k in range(len(s) + 1) if s[:k] in prefixes)
        assert place.setdefault(s[:d], a) == a
    assert len(set(place.values())) == len(place)
