import hashlib
import random
import re

import helpers as H
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import fill_middle as M

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def slow(doc_id, text, seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, mid, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(head), len(mid), f"<S>{tail}<P>{head}<M>{mid}"
    return n, "psm", len(head), len(mid), f"<P>{head}<S>{tail}<M>{mid}"


def rows():
    rng = random.Random(12)
    letters = ["a", "é", "語", "\U0001f600", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\xa0", "<", "P", "S", ">", "M"]
    made = [(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    made += [(2000 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>", "<", "a<P", "  lead", "trail  ", "\n", "a\x00b c"] * 8)]
    return [(i, t, "s", "en", None, -1, None, "f", "x", "k") for i, t in made] + H.rows()


def test_against_regular_expression(spark):
    docs = H.documents(spark, rows())
    got = M.rearrange(docs).withColumn("back", M.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(rows())
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r["fim"]) == slow(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_columns_that_clash(spark):
    docs = H.documents(spark).withColumn("fim", F.lit(1)).withColumn("draws", F.lit("d")).withColumn("DRAWS_", F.lit("e"))
    got = M.rearrange(docs)
    assert got.columns == [c for c in docs.columns if c != "fim"] + ["fim"]
    assert {(r["draws"], r["DRAWS_"]) for r in got.collect()} == {("d", "e")}


def test_no_rows(spark):
    assert M.rearrange(H.nothing(spark)).count() == 0


def test_rates(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    assert {r[0] for r in M.rearrange(docs, rate=0).select("fim.form").collect()} == {"plain"}
    assert {r[0] for r in M.rearrange(docs, rate=100, spm_rate=0).select("fim.form").collect()} == {"psm"}
    forms = [r[0] for r in M.rearrange(docs).select("fim.form").collect()]
    assert 150 < forms.count("plain") < 250 and forms.count("spm") > 2 * forms.count("psm")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=400))
def test_ranks(symbols):
    symbols = np.array(symbols, np.uint8)
    matrix, at = M.WaveletMatrix(symbols, 3), np.arange(len(symbols) + 1)
    for s in range(8):
        assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]


@pytest.mark.parametrize("text", ["a" * 300_000, "ab " * 100_000, " " * 200_000])
def test_long_texts(spark, text):
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    for r in M.rearrange(docs).collect():
        assert tuple(r["fim"]) == slow(r["doc_id"], text)
