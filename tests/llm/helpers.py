"""Small tables with every awkward row."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, score double, fp string, id string, key string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "the of and river stone cloud paper green walks under seven lamp over window quiet garden".split()


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n)).capitalize() + "."


def rows() -> list[tuple]:
    texts = [(i, prose(i), f"src{i % 3}") for i in range(40)]
    texts += [
        (100, None, "src0"),
        (101, "", "src1"),
        (102, "   \n\t ", None),
        (103, "one", None),
        (104, "Two words", "src1"),
        (105, "x" * 50_000, "src2"),
        (106, prose(7, 30_000), "src2"),
        (107, prose(3), "src0"),
        (107, prose(3), "src0"),
        (108, "é ünïcode — “quotes” 日本語 text\x0bwith\x0cblanks\x1c", "ü"),
        (None, prose(5), "src0"),
        (None, None, None),
    ]
    return [(i, t, s, "en", None if t is None else len(t), -1, None, "f", "x", "k") for i, t, s in texts]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def blanks(text: str | None) -> list[str]:
    import re

    lower = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
