import hashlib
import random
import re

import helpers as H
import pytest

from millrace.llm import decontaminate as D

ITEMS = "item_id long, text string, extra string"


def words(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(name)
        joined = ",".join(sorted("" if n is None else str(n) for n in names))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, seed=0):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))  # noqa: E731  many matches of every length
    items = [(k, text(rng.randrange(1, 25)), "e") for k in range(12)]
    items += [(50, None, "e"), (51, "..!", "e"), (None, H.prose(2, 14), "e"), (7, items[7][1], "e"), (60, H.prose(4, 12), "e")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(r[0], r[1]) for r in H.rows()] + [(900, "Zz! " + H.prose(4, 12).upper() + "; zz")]
    frame = [(i, t, "s", "en", 0, 0, 0.0, "", "", "") for i, t in docs]
    return docs, items, H.documents(spark, frame), spark.createDataFrame(items, ITEMS)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_against_brute_force_in_one_block_and_in_many(spark):
    docs, items, df, tests = tables(spark)
    want = brute(docs, [(k, t) for k, t, _ in items])
    for size in (D.BLOCK_WORDS, 60):
        got = D.report(D.scan(df, tests, block_words=size)).select(*COLUMNS).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_removed_passages_are_gone_and_the_rest_stays(spark):
    tests = spark.createDataFrame([(1, H.prose(4, 12), "e"), (2, H.prose(5, 40), "e")], ITEMS)
    clean = H.prose(900, 50)
    data = [
        (1, clean, "s", "en", len(clean), 0, 0.0, "", "", ""),
        (2, clean + " " + H.prose(4, 12) + "\n" + clean, "s", "en", 0, 0, 0.0, "", "", ""),
        (3, H.prose(5, 40), "s", "en", 0, 0, 0.0, "", "", ""),
        (4, None, "s", "en", None, 0, 0.0, "", "", ""),
    ]
    docs = H.documents(spark, data)
    out = D.decontaminate(docs, tests)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and sorted(got) == [1, 2, 4]
    assert got[1] == next(r for r in docs.collect() if r["doc_id"] == 1)
    assert got[1]["text"] == clean and got[4]["text"] is None
    assert words(got[2]["text"]) == words(clean) * 2
    assert got[2]["n_chars"] == len(got[2]["text"])
    assert D.report(D.scan(out, tests)).where("contaminated").count() == 0


def test_empty_tables(spark):
    docs, _, df, tests = tables(spark)
    none = tests.limit(0)
    assert D.report(D.scan(df, none)).where("contaminated").count() == 0
    assert D.scan(H.nothing(spark), tests).collect() == []
    assert D.decontaminate(df, none).count() == len(docs)


def test_many_blocks_remove_what_one_block_removes(spark):
    """Two items of different blocks that together cover a text beyond the limit, that
    overlap, and whose removal joins words into an item of the other block."""
    word = [f"w{k}" for k in range(200)]
    item = lambda a, b: " ".join(word[a:b])
    items = [(1, item(0, 50), "e"), (2, item(45, 95), "e"), (3, item(100, 150), "e")]
    tests = spark.createDataFrame(items, ITEMS).coalesce(1)
    texts = [
        item(0, 42) + " " + item(50, 92) + " " + item(150, 166),  # 42 + 42 of 100 words
        item(150, 200) + " x " + item(30, 60) + " " + item(150, 170),  # overlapping
        item(150, 200) + " " + item(0, 5) + " " + item(100, 115) + " " + item(5, 12) + " y " + item(160, 190),
        item(150, 200) + " " + item(100, 107) + " " + item(0, 15) + " " + item(107, 112) + " y " + item(160, 190),
        item(150, 200),
    ]
    docs = H.documents(spark, [(i, t, "s", "en", len(t), 0, 0.0, "", "", "") for i, t in enumerate(texts)])
    want = sorted(D.decontaminate(docs, tests).collect())
    got = D.decontaminate(docs, tests, block_words=60)
    assert got.columns == docs.columns and sorted(got.collect()) == want
    assert [r["doc_id"] for r in want] == [1, 2, 3, 4]
    assert D.report(D.scan(got, tests)).where("contaminated").count() == 0
    rows, _, df, random_items = tables(spark)
    key = lambda r: repr(tuple(r))
    one = sorted(D.decontaminate(df, random_items).collect(), key=key)
    assert sorted(D.decontaminate(df, random_items, block_words=60).collect(), key=key) == one


@pytest.mark.parametrize("block_words", [12, 40, 500_000])
def test_items_longer_than_a_block_are_cut_into_pieces(spark, block_words):
    """Pieces share all but one word of a window: what is found does not depend on the blocks."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (400, 57, 10, 9, 3, 0)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b c d e f g h i j k"), (7, None)], "item_id long, text string")
    docs = [" ".join([words[3], texts[0][a : a + 300], "zz", texts[k % 3][-200:]]) for k, a in enumerate(range(0, 900, 45))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*docs, "x a b c d e f g h i j k", None, ""])], "doc_id long, text string")
    parts = D.pieces(items, "item_id", "text", 10, block_words)
    sizes = [len(r.words) // 8 for r in parts.collect()]
    assert max(sizes) <= max(10, block_words // 4) and (block_words > 40 or len(sizes) > 8)
    built = D.automata(items, "item_id", "text", 10, block_words)
    assert len(built) == 1 if block_words == 500_000 else len(built) > 3
    want = sorted(map(tuple, D.report(D.scan(docs, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect()))
    got = D.report(D.scan(docs, items, block_words=block_words))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect())) == want
    assert any(w[3] > 0 for w in want)
