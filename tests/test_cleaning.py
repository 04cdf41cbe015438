import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.cleaning import clean_and_keep, math_clean, web_clean, word_count


def python_web(text):
    text = text or ""
    for pattern in (
        r"https?://[a-zA-Z0-9./?=&_-]+",
        r"s3://commoncrawl/crawl-data/.*\n?",
        r"CC-MAIN-\d{4}-\d{2}",
        r"<urn:uuid:[a-f0-9-]+>",
    ):
        text = re.sub(pattern, "", text)
    return re.sub(r"\s+", " ", text).strip()


def python_math(text):
    steps = (
        (r"https?://\S+", ""),
        (r"\s+", " "),
        (r"www\.\S+\.\w+", ""),
        (r"\s([.,;:!?])", r"\1"),
        (r"[a-zA-Z0-9_\-\.]+\.(pdf|cgi)", ""),
        (r"\(\s*\)", ""),
        (r"\(\s*.\s*\)", ""),
        (r"\s+", " "),
    )
    text = text or ""
    for pattern, new in steps:
        text = re.sub(pattern, new, text)
    return text.strip()


WEB_GOLDEN = [
    (None, ""),
    ("", ""),
    ("a https://m.x.net/en/25#top b", "a #top b"),
    ("a http://h:8080/z%20b", "a :8080/z%20b"),
    ("x s3://commoncrawl/crawl-data/q w\ny", "x y"),
    ("CC-MAIN-2024-10 CC-MAIN-24-1", "CC-MAIN-24-1"),
    ("a <urn:uuid:0af1-22bc> <urn:uuid:0AF1>", "a <urn:uuid:0AF1>"),
]
MATH_GOLDEN = [
    (None, ""),
    ("a https://m.x.net/en/25#top b", "a b"),
    ("a www.q.org/p.html end", "a end"),
    ("a , b ; c  !", "a, b; c!"),
    ("see report-v1.pdf now", "see now"),
    ("f ( ) (x) () (ab)", "f (ab)"),
    ("go (x) .", "go ."),
]


@pytest.mark.parametrize(
    "cleaner,golden", [(web_clean, WEB_GOLDEN), (math_clean, MATH_GOLDEN)], ids=["web", "math"]
)
def test_golden_rows(spark, cleaner, golden):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(golden)], "i int, text string")
    got = {r.i: r.c for r in df.select("i", cleaner(F.col("text")).alias("c")).collect()}
    assert [got[i] for i in range(len(golden))] == [want for _, want in golden]


PIECES = [
    "http://", "https://", "www.", "s3://commoncrawl/crawl-data/", "CC-MAIN-", "2024", "-", "10",
    "<urn:uuid:", "0af", ">", ".pdf", ".cgi", "a", "B", "_", ".", ",", ";", "!", "?", "(", ")",
    "()", "( )", "(x)", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85",
    "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000", "\u200b", "é", "ß", "中", "٣", "²",
    "😀", "$1", "\\", "/", "#", "%", "=", "&", "www.x.org", "a.b-c.pdf", "x .", "( é )", "!-~",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_cleaners_agree_with_python_on_random_text(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(8000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    rows = df.select(
        "i", web_clean(F.col("text")).alias("w"), math_clean(F.col("text")).alias("m")
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.w == python_web(texts[r.i]), repr(texts[r.i])
        assert r.m == python_math(texts[r.i]), repr(texts[r.i])


def test_filter_keeps_more_than_ten_words(spark):
    texts = [" ".join("w" * n) for n in range(14)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    assert sorted(r.ord for r in clean_and_keep(df, web_clean).collect()) == [11, 12, 13]
    assert sorted(r.ord for r in clean_and_keep(df, web_clean, 0).collect()) == list(range(1, 14))
    counts = df.select("ord", word_count(web_clean(F.col("text"))).alias("n")).collect()
    assert all(r.n == (r.ord if r.ord < 14 else 0) for r in counts)


def test_cleaning_chain_is_planned_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = clean_and_keep(df, math_clean)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 8
