import math
import zlib
from collections import Counter, defaultdict

import helpers as H
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_model as L

END = None


def naive(rows, word_share, ngram_share, order=3):
    """(held_out, n_tokens, n_known, train_tokens, base, score) of each row."""
    toks = [[*H.blanks(t), END] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [t for t, h in zip(toks, held) if not h]
    counts = [Counter(tuple(t[k : k + n]) for t in train for k in range(len(t) - n + 1)) for n in range(1, order + 1)]
    total, distinct = sum(counts[0].values()), len(counts[0])
    kept = [{g for g, c in counts[0].items() if c >= word_share * total}]
    for n in range(1, order):
        kept.append({g for g, c in counts[n].items() if c >= ngram_share * total and g[:-1] in kept[-1] and g[1:] in kept[-1]})
    p1 = lambda w: (counts[0][(w,)] + 0.1) / (total + 0.1 * (distinct + 1))
    arcs = defaultdict(list)
    for n in range(1, order):
        for g in kept[n]:
            arcs[g[:-1]].append(g[-1])
    direct = lambda h, w: (counts[len(h)][(*h, w)] - 0.5) / counts[len(h) - 1][h]
    memo = {}

    def p(h, w):
        if not h:
            return p1(w)
        if (*h, w) in kept[len(h)]:
            return direct(h, w)
        if h not in memo:
            known = arcs.get(h, ())
            memo[h] = (1 - sum(direct(h, x) for x in known)) / (1 - sum(p(h[1:], x) for x in known))
        return memo[h] * p(h[1:], w)

    out = []
    for (i, _), t, h in zip(rows, toks, held):
        base = sum(math.log10(p1(w)) for w in t)
        full = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k]), w)) for k, w in enumerate(t))
        out.append((i, h, len(t), sum(counts[0][(w,)] > 0 for w in t), total, base, full))
    return out


@pytest.mark.parametrize("shares", [(1e-9, 1e-9), (2e-3, 2e-4), (2e-3, 1.0)])
def test_against_naive_backoff(spark, shares):
    data = [(i, H.prose(i % 50, 20 + i % 30)) for i in range(120)] + [(r[0], r[1]) for r in H.rows()]
    docs = H.documents(spark, [(i, t, "s", "en", 0, 0, 0.0, "", "", "") for i, t in data])
    got = L.score_corpus(docs, word_share=shares[0], ngram_share=shares[1])
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    rows = sorted((tuple(r) for r in got.collect()), key=order)
    want = sorted(naive(data, *shares), key=order)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    for r, w in zip(rows, want):
        assert r[5] == pytest.approx(w[5], rel=1e-9) and r[6] == pytest.approx(w[6], rel=1e-9)


@pytest.fixture(scope="module")
def whole_head(spark):
    """A model all of which is in its head, and the words it knows."""
    data = [(i, H.prose(i % 12, 30 + i)) for i in range(60)]
    docs = H.documents(spark, [(i, t, "s", "en", 0, 0, 0.0, "", "", "") for i, t in data])
    return L.train(docs.select("text"), head_word_share=0.0, head_share=0.0)


def test_every_context_sums_to_one(whole_head):
    model = whole_head.head
    size = len(model.words)
    unknown = L.ADDED / (model.total + L.ADDED * (size + 1))
    assert len(model.backoff) > 200
    for state in range(len(model.backoff)):
        logp, _ = model.step(np.full(size + 1, state), np.arange(size + 1))
        rest = 10 ** logp[size] * unknown  # an unknown word: the backoff weights down to the root
        assert (10 ** logp[:size]).sum() + rest == pytest.approx(1.0)


def test_stretches_do_not_show(whole_head):
    model = whole_head.head
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice([*H.WORDS, "unheard"], 3000))
    h, bounds = L.tokens(pa.array([text, "", "the of"]))
    ids = L.W.look_up(h, model.words)
    ids = np.where(ids < 0, len(model.words), ids)
    whole = model.walk(ids, bounds)
    state, total = np.zeros(1, np.int64), 0.0
    for w in ids[: bounds[1]]:
        logp, state = model.step(state, np.array([w]))
        total += logp[0]
    assert whole[0] == pytest.approx(total) and len(whole) == 3


def test_other_columns_come_back_as_they_were(spark):
    docs = H.documents(spark).withColumn("row", F.lit("r")).withColumn("doc", F.col("doc_id")).withColumn("keys", F.array(F.lit(1.5)))
    docs = docs.withColumn("when", F.lit("2020-01-02 03:04:05").cast("timestamp")).withColumn("score", F.lit(7))
    model = L.train(docs.select("text"))
    got = L.score(docs, model)
    kept = [c for c in docs.columns if c not in ("text", "score")]
    assert got.columns == [*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda r: repr(r)
    assert sorted(got.select(kept).collect(), key=order) == sorted(docs.select(kept).collect(), key=order)
    only = L.score(docs.select("text"), model)
    assert only.count() == docs.count()


def test_few_runs_and_many_parts(spark, monkeypatch):
    """Runs of texts end often, parts are many, sums are sent on early."""
    data = [(i, H.prose(i % 50, 20 + i % 30)) for i in range(150)]
    docs = H.documents(spark, [(i, t, "s", "en", 0, 0, 0.0, "", "", "") for i, t in data]).repartition(1)
    want = sorted(tuple(r) for r in L.score_corpus(docs, head_word_share=2.0, head_share=2.0).collect())
    model = L.train(docs.where(F.col("doc_id") > 0).select("text"), head_word_share=2.0, head_share=2.0)
    assert model.bits == 5 and len(want) == 150
    assert model.tail.count() <= 32 and len(model.head.words) == 0


def test_ngrams_meet_their_ends_once(spark, monkeypatch):
    """Contexts and weights are both made of the table written after that."""
    read, pin = [], L.pin
    monkeypatch.setattr(L, "pin", lambda df, label: read.extend((label, f) for f in df.inputFiles()) or pin(df, label))
    L.train(H.documents(spark, [(i, H.prose(i, 40), "s", "en", 0, 0, 0.0, "", "", "") for i in range(30)]).select("text"))
    assert {label for label, f in read if "gram-counts" in f} == {"gram-ends"}
    assert {label for label, f in read if "gram-ends" in f} == {"contexts", "grams"}


def test_sieve_has_a_bit_for_every_key(spark):
    keys = L.W.mixed(np.arange(1, 4001, dtype=np.uint64))
    table = spark.createDataFrame([(int(k),) for k in keys[:2000].view(np.int64)], "key long").repartition(5)
    bitmap = L.sieve(table, 2000)
    assert L.passes(keys[:2000], bitmap).all() and L.passes(keys[2000:], bitmap).sum() < 400
    assert int(np.bitwise_count(bitmap).sum()) <= 2000
    assert not L.passes(keys, L.sieve(table.limit(0), 0)).any()


def test_order_and_places_of_hashes():
    rng = np.random.default_rng(5)
    top = rng.integers(0, 6, 3000).astype(np.uint64) << np.uint64(61)
    for keys in (L.W.mixed(rng.integers(0, 900, 3000).astype(np.uint64)), top + rng.integers(0, 9, 3000).astype(np.uint64), top[:0], top[:1]):
        assert L.W.order_of(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    few = L.W.mixed(np.arange(5000, dtype=np.uint64))
    few[[7, 2000]] = few[[2000, 7]] & ~np.uint64(255)
    few[7], few[2000] = few[2000] + np.uint64(9), few[2000]  # alike but for the last bits, in the wrong order
    assert L.W.order_of(few).tolist() == np.argsort(few, kind="stable").tolist()
    ends = np.array([0, 2**64 - 1], np.uint64)
    for table in (few[:0], np.sort(few), np.unique(np.append(few, ends)), np.unique(top)):
        asked = np.concatenate([few, ends, top, few + np.uint64(1)])
        assert L.W.Places(table)(asked).tolist() == L.W.look_up(asked, table).tolist()


def test_no_training_rows_and_empty_tables(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    one = H.documents(spark, [(held, "a b", "s", "en", 0, 0, 0.0, "", "", "")])
    r = L.score_corpus(one).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)
    assert r["base_score"] == pytest.approx(0.0) and r["score"] == pytest.approx(0.0)
    assert L.score_corpus(H.nothing(spark)).collect() == []


def test_ngrams_that_occur_twice_count_in_a_larger_corpus(spark):
    """Over a million tokens, so that the shares lie above the least count; with heads of
    several sizes, the rest of the weights being joined."""
    data = [(i, H.prose(i, 3000)) for i in range(420)] + [(r[0], r[1]) for r in H.rows() if r[0] != 106]
    docs = H.documents(spark, [(i, t, "s", "en", 0, 0, 0.0, "", "", "") for i, t in data])
    total = sum(len(H.blanks(t)) + 1 for i, t in data if i is None or zlib.crc32(str(i).encode()) % 10)
    share = 4e-6
    assert share * total > L.MIN_COUNT + 2
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(naive(data, 0.0, (L.MIN_COUNT - 0.01) / total), key=order)
    for options in ({}, {"head_share": share}, {"head_word_share": 1e-2, "head_share": 1e-3}, {"head_word_share": 2.0, "head_share": 2.0}):
        rows = sorted((tuple(r) for r in L.score_corpus(docs, **options).collect()), key=order)
        assert [r[:5] for r in rows] == [w[:5] for w in want]
        for r, w in zip(rows, want):
            assert r[5] == pytest.approx(w[5], rel=1e-9) and r[6] == pytest.approx(w[6], rel=1e-9)
