"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Features: how often words, and word beginnings, of learned lexicons occur (as counts,
densities and summed log odds), also after undoing common letter substitutions; how
often such a word stands near a second-person word; shares of capitals, punctuation,
shouting and obfuscated words.

The lexicons are the words (and word beginnings of 4 and 5 bytes) that occur in toxic
labelled documents far more often than in others. So that a lexicon isn't judged on the
documents it was read off, features of a learned-from document use the lexicons of the
other folds, and the calibration uses scores of trees fitted on the other folds.

Fitted on at most ``SAMPLE_ROWS`` labelled documents outside the held-out fifth; word
counts are summed by Spark, and the lexicons hold at most ``LEXICON`` entries of a kind
(the strongest), so what is broadcast is bounded. All documents are scored in place.

Defined results: as for the quality classifier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.llm.quality import SAMPLE_ROWS, held_out, labelled_sample
from millrace.llm.text_stats import NAMES as STAT_NAMES
from millrace.llm.text_stats import text_stats
from millrace.llm.trees import Boosted, fit_boosted, fit_isotonic

FOLDS = 5
LEXICON = 5_000
LEAST_DOCS = 3  # toxic documents a lexicon entry occurs in
LEAST_ODDS = 2.0  # logarithm
THRESHOLD = 0.5
NEAR = 3  # words
KINDS = 3  # whole words, beginnings of 5 and of 4 bytes

# Second-person words of the languages at hand, lower case.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr sie tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tu tus vosotros vuestro"
).split()
# Characters written for letters.
SUBSTITUTES = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

FEATURES = tuple(
    f"{name}{kind}" for kind in ("_word", "_begin5", "_begin4", "_restored") for name in ("hits", "density", "odds", "top")
) + ("near_you", "you", "obfuscated") + tuple(STAT_NAMES)

_RESTORE = W.LOWER.copy()
for _a, _b in SUBSTITUTES.items():
    _RESTORE[ord(_a)] = ord(_b)


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = W.flat(pa.array(words))
    return np.sort(W.hashes(data, offsets[:-1], offsets[1:]))


_YOU = _hash_words(sorted(set(SECOND_PERSON)))


@dataclass
class Text:
    """What the lexicons are looked up in, for a slice of texts."""

    bounds: np.ndarray
    kinds: list[np.ndarray]  # hashes of words and of their beginnings
    restored: np.ndarray
    obfuscated: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the first n bytes; a shorter word has none of its own (0)."""
    long = ends - starts >= n
    out = np.zeros(len(starts), np.uint64)
    if long.any():
        s = starts[long]
        packed = np.zeros(len(s), np.uint64)
        for i in range(n):
            packed = (packed << np.uint64(8)) | data[s + i]
        with np.errstate(over="ignore"):
            out[long] = W.mixed(packed + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
    return out


def _read(texts: pa.Array) -> Text:
    raw, offsets = W.flat(texts)
    lower = W.LOWER[raw]
    starts, ends, bounds = W.places(lower, offsets, W.PLAIN_WORD)
    kinds = [W.hashes(lower, starts, ends)] + [_beginnings(lower, starts, ends, n) for n in (5, 4)]
    # A substitute between letters: the blank-separated word is restored and looked up whole.
    letter = (W.PLAIN_WORD & ~np.isin(np.arange(256), list(b"0123456789")))[lower]
    swapped = _RESTORE[lower] != lower
    odd = np.zeros(len(lower), bool)
    if len(lower) > 2:
        odd[1:-1] = swapped[1:-1] & letter[:-2] & letter[2:]
    s, e, b = W.places(lower, offsets, W.BLANK_WORD)
    marks = np.concatenate(([0], np.cumsum(odd)))
    hit = marks[e] > marks[s]
    owner = np.repeat(np.arange(len(b) - 1), np.diff(b))[hit]
    n = np.bincount(owner, minlength=len(b) - 1)
    back = _RESTORE[lower]
    s2, e2 = s[hit], e[hit]
    strip = len(back) and ~W.PLAIN_WORD[back]
    while len(s2) and (drop := (e2 - s2 > 1) & strip[e2 - 1]).any():
        e2 = e2 - drop
    return Text(bounds, kinds, np.stack([owner.astype(np.uint64), W.hashes(back, s2, e2)]), n)


Lexicons = list[tuple[np.ndarray, np.ndarray]]  # by kind: sorted hashes, log odds


def _features(texts: pa.Array, lexicons: Lexicons) -> np.ndarray:
    t = _read(texts)
    docs = len(texts)
    doc = t.docs
    n = np.maximum(np.diff(t.bounds), 1).astype(float)
    out = []
    toxic = np.zeros(len(doc), bool)
    sets = [(doc, k, lex) for k, lex in zip(t.kinds, lexicons)]
    sets.append((t.restored[0].astype(np.int64), t.restored[1], lexicons[0]))
    for j, (owner, keys, (table, odds)) in enumerate(sets):
        at = W.look_up(keys, table)
        hit = at >= 0
        if j < KINDS:
            toxic |= hit
        hits = np.bincount(owner[hit], minlength=docs).astype(float)
        summed = np.bincount(owner[hit], odds[at[hit]], minlength=docs)
        top = np.zeros(docs)
        np.maximum.at(top, owner[hit], odds[at[hit]])
        out += [hits, hits / n, summed, top]
    you = W.look_up(t.kinds[0], _YOU) >= 0
    before = np.concatenate(([0], np.cumsum(you)))
    spot = np.flatnonzero(toxic)
    low = np.maximum(spot - NEAR, t.bounds[doc[spot]])
    high = np.minimum(spot + NEAR + 1, t.bounds[doc[spot] + 1])
    near = before[high] > before[low]
    out += [
        np.bincount(doc[spot[near]], minlength=docs).astype(float),
        np.bincount(doc[you], minlength=docs) / n,
        t.obfuscated / n,
    ]
    return np.column_stack([*out, text_stats(texts)])


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(_features(texts, self.lexicons)), *self.knots), 0.0, 1.0)


def _fold(id_col: str):
    return F.pmod(F.xxhash64(F.lit(FOLDS), F.col(id_col)), F.lit(FOLDS)).cast("int")


def _word_counts(known: DataFrame, text_col: str) -> DataFrame:
    """Documents by (kind, entry, fold, toxic) that hold the entry."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, text_col):
                t = _read(part.column(part.schema.get_field_index(text_col)))
                doc = t.docs.astype(np.int64)
                fold = part.column(part.schema.get_field_index("fold")).to_numpy()
                y = part.column(part.schema.get_field_index("y")).to_numpy()
                for kind, keys in enumerate(t.kinds):
                    order = np.lexsort((keys, doc))
                    k, d = keys[order], doc[order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                    new &= k != 0
                    k, d = k[new], d[new]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(k), kind, np.int32)),
                            pa.array(k.view(np.int64)),
                            pa.array(fold[d].astype(np.int32)),
                            pa.array((y[d] > 0.5).astype(np.int64)),
                        ],
                        names=["kind", "entry", "fold", "toxic"],
                    )

    one = known.select(text_col, "fold", "y").mapInArrow(run, "kind int, entry long, fold int, toxic long")
    return one.groupBy("kind", "entry", "fold").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def _lexicons(known: DataFrame, text_col: str) -> list[Lexicons]:
    """For each fold the lexicons read off the other folds; last, those of all."""
    sizes = {(r[0], r[1]): r[2] for r in known.groupBy("fold", (F.col("y") > 0.5).cast("int")).count().collect()}
    counts = _word_counts(known, text_col)
    folds = [[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in "tc"] for f in range(FOLDS)]
    wide = (
        counts.groupBy("kind", "entry")
        .agg(*[c for both in folds for c in both], F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where(F.col("t") >= LEAST_DOCS)
    )
    toxic, clean = (sum(n for (_, y), n in sizes.items() if y == v) for v in (1, 0))
    strength = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    # Enough for every fold's own choice: entries strong over all folds, or nearly so.
    ranked = wide.withColumn("s", strength).where(F.col("s") >= LEAST_ODDS - 1)
    best = Window.partitionBy("kind").orderBy(F.desc("s"), "entry")
    table = ranked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= LEXICON).drop("r").toPandas()
    out = []
    for f in [*range(FOLDS), None]:
        t = table["t"] - (0 if f is None else table[f"t{f}"])
        c = table["c"] - (0 if f is None else table[f"c{f}"])
        nt = toxic - (0 if f is None else sizes.get((f, 1), 0))
        nc = clean - (0 if f is None else sizes.get((f, 0), 0))
        odds = np.log((t + 0.5) / (nt + 1.0)) - np.log((c + 0.5) / (nc + 1.0))
        lex = []
        for kind in range(KINDS):
            ok = (table["kind"] == kind) & (t >= LEAST_DOCS) & (odds >= LEAST_ODDS)
            keys = table["entry"][ok].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            lex.append((keys[order], odds[ok].to_numpy()[order]))
        out.append(lex)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    spark = docs.sparkSession
    W.bound_batches(spark)
    sample = labelled_sample(labels, id_col, label_col, sample_rows)
    known = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample), F.col("_id") == F.col("_labelled"))
        .select("text", "y", _fold("_id").alias("fold"), "_id")
    )
    by_fold = _lexicons(known, "text")
    shared = spark.sparkContext.broadcast(by_fold)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts, fold = part.column(0), part.column(2).to_numpy()
                x = np.zeros((len(texts), len(FEATURES)))
                for f in np.unique(fold):
                    at = np.flatnonzero(fold == f)
                    x[at] = _features(texts.take(pa.array(at)), shared.value[f])
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([arrays, part.column(1), part.column(2), part.column(3)], names=["x", "y", "fold", "id"])

    kind = known.schema["_id"].dataType.simpleString()
    rows = known.mapInArrow(run, f"x array<double>, y double, fold int, id {kind}").orderBy("id").limit(2 * sample_rows).drop("id").toArrow()
    x = rows.column(0).combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y, fold = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    return fit_calibrated(x, y, fold, by_fold[-1])


def fit_calibrated(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicons: Lexicons) -> ToxicityModel:
    trees = fit_boosted(x, y)
    raw = np.zeros(len(y))
    for f in np.unique(fold):
        other = fold != f
        raw[~other] = (fit_boosted(x[other], y[other]) if other.any() else trees).raw(x[~other])
    if len(y) and y.min() == y.max():
        knots = (np.array([0.0]), np.array([float(y[0])]))
    else:
        knots = fit_isotonic(raw, y)
    return ToxicityModel(lexicons, trees, knots)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        return lambda texts: [model.score(texts)]

    out = W.with_text_columns(docs.drop("held_out", "predicted"), text_col, [T.StructField("score", T.DoubleType())], make)
    return out.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= threshold).cast("int")})
