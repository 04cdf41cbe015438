import random
from collections import Counter

import helpers as H
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix_dedup as S


def slow(texts, window):
    """(kept, n_bytes, n_removed, n_spans) of each text, from a count of all windows."""
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((kept, len(t), len(t) - len(kept), spans))
    return out


def check(docs, texts, **settings):
    got = S.remove_repeats(docs, **settings).select("doc_id", "cut.*").collect()
    got = sorted((r[0], (bytes(r[1]), *r[2:])) for r in got)
    want = list(enumerate(slow(texts, settings.get("window", S.WINDOW))))
    assert [x for x in zip(got, want) if x[0] != x[1]][:1] == []


def table(spark, texts, parts=5):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def passages(seed, size=40):
    """Texts that share passages of many lengths, copies, runs of one letter, periodic texts."""
    rng = random.Random(seed)
    random_text = lambda n, letters="abcd é\n\x00": "".join(rng.choice(letters) for _ in range(n))
    shared = [random_text(n) for n in (7, 11, 12, 13, 24, 60, 150)]
    texts = []
    for _ in range(size):
        parts = [random_text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            passage = rng.choice(shared)
            a = rng.randrange(0, 4)
            parts += [passage[a : len(passage) - rng.randrange(0, 4)], random_text(rng.randrange(0, 30))]
        texts.append("".join(parts))
    texts += ["a" * 100, "a" * 12, "a" * 11, "ab" * 40, "abcde" * 20, random_text(500, "ab"), random_text(300, "a")]
    texts += texts[3:9] + [None, "", "é" * 30, "x", shared[-1], shared[-1]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,hot", [(0, 2048), (1, 3), (2, 1)])
def test_against_all_windows(spark, seed, hot):
    texts = passages(seed)
    check(table(spark, texts), texts, window=12, gram=8, hot=hot)


def test_common_passage_with_few_contexts_in_a_shard(spark):
    """One passage in all texts, with surroundings of their own, dealt to many shards."""
    rng = random.Random(3)
    letters = "abcdefghij"
    passage = "".join(rng.choice(letters) for _ in range(30))
    edge = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)]
    texts = [rng.choice(edge) + passage + rng.choice(edge) + str(i) for i in range(60)]
    texts += ["only " + passage[:15] + str(i) for i in range(20)]
    check(table(spark, texts), texts, window=16, gram=8, hot=2)


def test_production_lengths(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(n) for n in (30, 36, 40, 60, 200)]
    texts = [" ".join([say(rng.randrange(0, 80)), rng.choice(shared), say(rng.randrange(0, 80))]) for _ in range(60)]
    near = say(400).split(" ")
    for _ in range(20):
        copy = list(near)
        copy[rng.randrange(400)] = "changed"
        texts.append(" ".join(copy))
    texts += [shared[0][:199], shared[0][:199], shared[0][:200], shared[0][:200], "q" * 1000, "", None]
    check(table(spark, texts), texts)
    check(table(spark, texts), texts, hot=4)


def test_awkward_rows_and_clashing_columns(spark):
    docs = H.documents(spark).withColumn("text_key", F.lit(5)).withColumn("marks", F.lit("m")).withColumn("cut", F.lit(0))
    got = S.remove_repeats(docs)
    assert got.columns == [c for c in docs.columns if c != "cut"] + ["cut"]
    want = Counter((r[0], *x) for r, x in zip(H.rows(), slow([r[1] for r in H.rows()], 200)))
    rows = got.collect()
    assert Counter((r["doc_id"], bytes(r["cut"][0]), *r["cut"][1:]) for r in rows) == want
    assert {(r["text_key"], r["marks"]) for r in rows} == {(5, "m")}
    assert S.remove_repeats(H.nothing(spark)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for size in (1, 2, 40):
        texts = [bytes(rng.choice(b"\x00ab") for _ in range(rng.randrange(1, 60))) for _ in range(size)]
        texts += [texts[0], b"a" * 50]
        data = np.frombuffer(b"".join(texts), np.uint8)
        cuts = np.cumsum([0, *map(len, texts)])
        order = S.suffix_array(data, cuts)
        where = [(i, k) for i, t in enumerate(texts) for k in range(len(t))]
        # Texts end with marks less than any byte, earlier texts' being less.
        want = sorted(range(len(data)), key=lambda p: ([b + 1000 for b in texts[where[p][0]][where[p][1] :]] + [where[p][0]]))
        assert order.tolist() == want
        common = S.common_prefixes(data, cuts, order, np.diff(cuts))
        tail = lambda p: texts[where[p][0]][where[p][1] :]
        for x, y in zip(want, want[1:]):
            n = 0
            while n < min(len(tail(x)), len(tail(y))) and tail(x)[n] == tail(y)[n]:
                n += 1
            assert common[y] == n
        assert common[want[0]] == 0


def test_every_window_has_one_anchor_that_its_bytes_choose():
    rng = random.Random(6)
    S_BLOCK, S.BLOCK = S.BLOCK, 64
    try:
        texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 5, 12, 13, 300, 90)] + ["a" * 70]
        data, offsets = S.W.flat(pa.array(texts))
        text, start, n, h, _ = S.anchors(data, offsets, 12, 8)
    finally:
        S.BLOCK = S_BLOCK
    of = {}
    for t, s, k, x in zip(text.tolist(), start.tolist(), n.tolist(), h.tolist()):
        for w in range(s, s + k):
            assert (t, w) not in of
            of[t, w] = x
    assert sorted(of) == [(t, w) for t, x in enumerate(texts) for w in range(len(x) - 11)]
    by_bytes = {}
    for (t, w), x in of.items():
        assert by_bytes.setdefault(texts[t][w : w + 12], x) == x
