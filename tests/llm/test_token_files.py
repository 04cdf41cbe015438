import random
import zlib

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import token_counts as C
from millrace.llm import token_files as TF

ODD = [
    "", "a", " a", "a ", "  a", "a  b", "a \nb", "a\n b", "\n\n a", "\0a b \0a", "x  ", "<|endoftext|> hi", "don't 've it's a",
    "é ü  z", "a b", "a  b", "\x1c a", "a \x1c b", "1 23 a1 !? ?!", "a\tb \t c", "日本 語", None,
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(TF.default_tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces():
    with open(TF.default_tokenizer(), encoding="utf-8") as f:
        return TF.PieceEncoder(f.read(), cache=50)


def test_pieces_encode_like_whole_texts(plain, pieces):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "1", "'s", "! "]) for _ in range(40)) for _ in range(300)]
    for _ in range(2):
        ids, sizes = pieces.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(t) for t in texts]


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes_round_trip(unit):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        planes = TF.to_planes(ids, unit)
        assert len(planes) == (4 if unit == "byte" else 32)
        assert TF.from_planes(planes, n, unit).tolist() == ids.tolist()
    assert len(TF.to_planes(np.arange(60_000, dtype=np.uint32), unit)[-1]) < 40  # a constant plane


@pytest.mark.parametrize("options", [{}, {"unit": "bit", "block": 100, "segment": 500}])
def test_file_against_plain_encoding(spark, tmp_path, plain, options):
    docs = H.documents(spark)
    path = str(tmp_path / "tokens")
    TF.write_tokens(docs, path, **options)
    got = TF.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == len(H.rows())
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    start, texts = 0, {}
    for r in H.rows():
        texts.setdefault(r[0], []).append([*plain(r[1]), 0])
    for r in got:
        assert r["ids"] in texts[r["doc_id"]]
        texts[r["doc_id"]].remove(r["ids"])
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    index = TF.token_index(spark, path).orderBy("start").collect()
    assert [r["start"] for r in index] == np.cumsum([0, *[r["n"] for r in index]])[:-1].tolist()


def test_empty_table_and_other_id_types(spark, plain):
    assert TF.encode_corpus(H.nothing(spark)).collect() == []
    named = H.documents(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = TF.encode_corpus(named).orderBy("start").collect()
    assert [r["doc_id"] for r in got if r["doc_id"]] == sorted(str(r[0]) for r in H.rows() if r[0] is not None)


def test_edits_count_like_encoding_again(plain, pieces, monkeypatch):
    monkeypatch.setattr(C, "LEAF_CHARS", 8)
    monkeypatch.setattr(C, "SPLIT_CHARS", 32)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "1", "'s", " the"]) for _ in range(rng.randrange(60)))
        tree = C.SumTree.of_leaves(*C.leaf_counts(text, pieces))
        assert tree.total() == len(plain(text))
        for _ in range(4):
            pos, gone = rng.randrange(-2, len(text) + 4), rng.randrange(6)
            new = "".join(rng.choice(["x", " ", "y z", "\n"]) for _ in range(rng.randrange(4)))
            a = min(max(pos, 0), len(text))
            want = text[:a] + new + text[min(a + gone, len(text)) :]
            text, tree, _ = C.edit(text, tree, pos, gone, new, pieces)
            assert text == want and tree.total() == len(plain(text)) and tree.chars[1] == len(text)
            half = tree.chars[2 : 2 * tree.width].reshape(-1, 2).sum(axis=1)
            assert (tree.chars[1 : tree.width] == half).all()


def test_recount_reads_little_of_a_long_text(spark, plain):
    edits = "array<struct<pos:int,removed:int,inserted:string>>"
    docs = H.documents(spark).withColumn(
        "edits",
        F.when(F.col("doc_id") % 2 == 0, F.expr("array(named_struct('pos', 30, 'removed', 4, 'inserted', ' new words'), null, named_struct('pos', null, 'removed', 1, 'inserted', 'x'), named_struct('pos', 900000, 'removed', null, 'inserted', ' end'))").cast(edits)),
    )
    out = C.recount(C.count_tokens(docs)).select("doc_id", "text", "n_tokens", "recounted").collect()
    assert len(out) == len(H.rows())
    for r in out:
        text, new = r["text"] or "", r["recounted"]
        assert r["n_tokens"] == len(plain(text))
        if r["doc_id"] is not None and r["doc_id"] % 2 == 0:
            text = text[:30] + " new words" + text[34:] + " end"
        assert new["text"] == text and new["n_tokens"] == len(plain(text))
        assert new["encoded_chars"] <= 4096 or " " not in text
    assert C.recount(C.count_tokens(H.nothing(spark).withColumn("edits", F.lit(None).cast(edits)))).collect() == []
