import random
import zlib

import helpers as H
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality as Q
from millrace.llm import text_stats as S
from millrace.llm import toxicity as X
from millrace.llm import trees as B


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=900):
    """Good and bad, clean and toxic documents, and labels for three quarters."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        text, bad, toxic = H.prose(i, rng.randrange(20, 200)), i % 6 == 0, i % 5 == 1
        if bad:
            text = [text.upper().replace(" ", "!! "), " ".join(text.split()[:4] * 30), text.replace(" ", "### ")][i % 3]
        if toxic:
            words = text.split()
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["you", "the"]) + " " + rng.choice(["zorgface", "glarnhead", "zorgling"]))
            text = " ".join(words)
        docs.append((i, text, "s", "en", 0, 0, 0.0, "", "", ""))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    extra = [r for r in H.rows()]
    labels = labels + [(3, 1, 0), (5000, None, None), (None, 0, 1), (77777, 1, 1)]
    return H.documents(spark, docs + [(9000 + k, *r[1:]) for k, r in enumerate(extra)]), spark.createDataFrame(labels, H.LABELS), dict((i, (q, t)) for i, q, t in labels)


def accuracy(rows, truth, at):
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in truth and truth[r["doc_id"]][at] is not None]
    assert len(tested) > 80
    return sum(r["predicted"] == truth[r["doc_id"]][at] for r in tested) / len(tested)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels, truth = tables
    model = Q.fit(docs, labels)
    assert 1 <= len(model.rules) <= 60 and str(model)
    out = Q.classify(docs, model).collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert accuracy(out, truth, 0) >= 0.97
    good = Q.keep_good(docs, labels)
    assert good.columns == docs.columns and good.exceptAll(docs).count() == 0
    kept = {r[0] for r in good.select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in out if r["predicted"]}


def test_compiled_rules_equal_their_meaning(spark, tables):
    docs, labels, _ = tables
    model = Q.fit(docs, labels)
    rows = Q.with_stats(docs).withColumn("s", model.column()).select(Q.STATS, "s").collect()
    for x, s in rows[:200]:
        raw = model.intercept + sum(w for c, w in model.rules if all((x[f] > t) == above for f, above, t in c))
        assert s == pytest.approx(1 / (1 + np.exp(-raw)))


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels, truth = tables
    model = X.fit(docs, labels)
    out = X.score(docs, model).collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert accuracy(out, truth, 1) >= 0.97
    again = model.score(pa.array(["Nobody saw a zorgwhat here, you z0rgface glarnhead zorgface.", "The river and the stone.", None]))
    assert again[0] > 0.5 > again[1]


@pytest.mark.parametrize("labels", [[], [(i, 1, 0) for i in range(40)], [(1, None, None)]])
def test_without_two_classes(spark, labels):
    docs = H.documents(spark)
    table = spark.createDataFrame(labels, H.LABELS)
    good, toxic = (1.0, 0.0) if len(labels) == 40 else (0.5, 0.5)
    assert Q.classify(docs, Q.fit(docs, table)).agg(F.min("score"), F.max("score")).first()[:] == pytest.approx((good, good), abs=1e-3)
    assert X.score(docs, X.fit(docs, table)).agg(F.min("score"), F.max("score")).first()[:] == pytest.approx((toxic, toxic), abs=1e-3)


def test_empty_tables(spark, tables):
    _, labels, _ = tables
    none = H.nothing(spark)
    assert Q.classify(none, Q.fit(none, labels)).collect() == []
    assert X.score(none, X.fit(none, labels)).collect() == []


def test_stats_do_not_depend_on_neighbours():
    texts = [r[1] for r in H.rows()]
    whole = S.text_stats(pa.array(texts))
    assert whole.shape == (len(texts), len(S.NAMES)) and np.isfinite(whole).all()
    for k, t in enumerate(texts):
        assert S.text_stats(pa.array([t], pa.string()))[0] == pytest.approx(whole[k])
    x = dict(zip(S.NAMES, S.text_stats(pa.array(["A b b B! 1|"]))[0]))
    assert x["distinct"] == 4 / 5 and x["echo"] == 1 / 5 and x["upper"] == 2 / 11 and x["bar"] == 1 / 11


def test_boosting_isotonic_and_lasso():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = B.fit_boosted(x, y, trees=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.98
    for path in model.paths()[:20]:
        assert 1 <= len(path) <= 3
    at, share = B.fit_isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all() and share[0] == 0 and share[-1] == 1
    z = rng.random((2000, 30)) < 0.5
    target = (z[:, 3] & (rng.random(2000) < 0.95)).astype(float)
    _, w = B.fit_lasso_logistic(z.astype(float), target, 0.02)
    assert np.argmax(np.abs(w)) == 3 and (np.abs(w) > 1e-6).sum() <= 5
