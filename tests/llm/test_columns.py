"""Columns of any name come back as they were, also those an operator uses itself."""

import re
from pathlib import Path

import helpers as H
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, fill_middle, line_dedup, mixing, near_copies, quality, suffix_dedup
from millrace.llm import words as W

FOLDER = Path(decontaminate.__file__).parent
#: Every name with an underscore that any module of the subpackage uses.
NAMES = sorted({n.lower() for f in FOLDER.glob("*.py") for n in re.findall(r"[\"'`](_[a-z]\w*)[\"'`]", f.read_text())} - {"_nothing"})


def items(spark):
    return spark.createDataFrame([(1, H.prose(3)[30:200]), (2, "of and river")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(40)], H.LABELS)


OPERATORS = {
    "near_copies": lambda spark, docs: near_copies.keep_one(docs),
    "decontaminate": lambda spark, docs: decontaminate.decontaminate(docs, items(spark)),
    "decontaminate in blocks": lambda spark, docs: decontaminate.decontaminate(docs, items(spark), block_words=5),
    "scan": lambda spark, docs: decontaminate.scan(docs, items(spark), block_words=5),
    "quality": lambda spark, docs: quality.keep_good(docs, labels(spark)),
    "classify": lambda spark, docs: quality.classify(docs, quality.fit(docs, labels(spark))),
    "line_dedup": lambda spark, docs: line_dedup.remove_spread_lines(docs, least_sites=1),
    "mix": lambda spark, docs: mixing.mix(docs),
    "mixed": lambda spark, docs: mixing.mixed_documents(docs),
    "fill_middle": lambda spark, docs: fill_middle.rearrange(docs),
    "suffix_dedup": lambda spark, docs: suffix_dedup.remove_repeats(docs),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_names_an_operator_uses_are_not_taken_from_the_caller(spark, name):
    assert {"_row", "_clean", "_stats", "_same", "_mix_at", "_spans"} <= set(NAMES)
    docs = H.documents(spark).drop("size", "score").withColumns({n: F.lit(f"mine {n}") for n in NAMES} | {"_row_": F.lit("too")})
    out = OPERATORS[name](spark, docs)
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    rows = out.select(kept).collect()
    assert rows and set(rows) <= set(docs.select(kept).collect())
    assert all(r[n] == f"mine {n}" for r in rows for n in NAMES)


def test_aside_and_fresh(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "_a int, _A_ int, b int, _a__ int")
    out, own, restored = W.aside(df, "_a", "_a_")
    assert not {"_a", "_a_"} & {c.lower() for c in out.columns} and len(set(out.columns)) == 4
    assert own("b") == "b" and out.first()[own("_a")] == 1
    assert restored(out).columns == df.columns
