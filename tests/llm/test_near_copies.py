import random

import helpers as H
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import near_copies as N


def shingles(text):
    w = H.blanks(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def slow_kept(rows):
    """Ids that stay, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=str)


def changed(text, times, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), times):
        words[at] = f"new{rng.randrange(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("limit", [N.PAIR_LIMIT, 4])
def test_near_copies_go_in_the_pipeline_stage(spark, monkeypatch, limit):
    """Copies with up to five words of 300 changed, some below and some above the limit of
    similarity; a large group of them."""
    monkeypatch.setattr(N, "PAIR_LIMIT", limit)
    rng = random.Random(3)
    rows = H.rows()
    texts = [H.prose(700 + k, 300) for k in range(20)]
    copies = [changed(t, n, rng) for t in texts for n in (2, 4, 6, 9, 20)] + [changed(texts[0], 3, rng) for _ in range(60)]
    rows += [(1000 + i, t, "s", "en", len(t), 0, 0.0, "", "", "") for i, t in enumerate(texts + copies)]
    docs = H.documents(spark, rows)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(slow_kept(rows), key=str)


def test_empty_tables(spark):
    assert N.keep_one(H.nothing(spark)).collect() == []


def templated(pairs, rng):
    """Texts of one template: 0.815 alike in pairs, 0.78 across them."""
    base = [f"w{i}" for i in range(1004)]  # 1000 shingles

    def with_own(words, n, name):
        out = list(words)
        for k in range(n):  # far apart, so that each takes five shingles
            out[name[1] + 7 * k] = f"{name[0]}{k}"
        return out

    texts = []
    for p in range(pairs):
        pair = with_own(base, 13, (f"p{p}x", 10))
        texts += [" ".join(with_own(pair, 10, (f"p{p}y{k}z", 500))) for k in range(2)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [N.BLOCK, 16])
def test_pairs_in_a_large_group_that_is_alike_are_all_found(spark, monkeypatch, block):
    """Hashes that hundreds share, links only between pairs: none is lost."""
    monkeypatch.setattr(N, "BLOCK", block)
    texts = templated(150, random.Random(8))
    across, within = [], []
    sets = [shingles(t) for t in texts[:40]]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            s = len(a & b) / len(a | b)
            (within if s >= 0.8 else across).append(s)
    assert max(across) < 0.8 and (not within or min(within) > 0.8)
    rows = [(i, t, "s", "en", len(t), 0, 0.0, "", "", "") for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in N.keep_one(H.documents(spark, rows)).select("doc_id").collect()}
    name = [t.split(" ")[10].partition("x")[0] for t in texts]
    want = {min(i for i, x in enumerate(name) if x == p) for p in set(name)}
    assert len(want) == 150 and kept == want


def test_blocks_link_what_all_pairs_link(spark, monkeypatch):
    """Every hash is large, blocks are small; links through the least node, beside it and in chains."""
    monkeypatch.setattr(N, "PAIR_LIMIT", 1)
    monkeypatch.setattr(N, "BLOCK", 5)
    rng = random.Random(9)
    texts = [H.prose(900 + k, 200) for k in range(4)]
    rows = []
    for t in texts:
        now = t
        for k in range(25):  # a chain, each a few words from the one before
            now = changed(now, 3, rng)
            rows.append((rng.randrange(10**6), now, "s", "en", 1, 0, 0.0, "", "", ""))
    docs = H.documents(spark, rows)
    assert sorted((r["doc_id"] for r in N.keep_one(docs).collect()), key=str) == slow_kept(rows)


def test_columns_of_any_name_come_back(spark):
    names = ["row", "node", "fp_", "size", "bands", "ROW_", "_row", "_node", "_bands", "set", "class"]
    docs = H.documents(spark)
    docs = docs.drop("size").select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    out = N.keep_one(docs)
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(slow_kept(H.rows()), key=str)
