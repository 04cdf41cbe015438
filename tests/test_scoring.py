import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import logits as L
from millrace.functions import vectors as V
from millrace.operators import metrics, sampling
from millrace.plans.evaluate import evaluate


@pytest.fixture(scope="module")
def table(spark):
    """200 rows of 23 logits with ties and large values."""
    rng = np.random.default_rng(1)
    z = np.round(rng.normal(size=(200, 23)) * 3, 1)
    z[7] += 900.0
    rows = [(i, [float(x) for x in z[i]], int(i % 23)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id bigint, logits array<double>, target int")
    return z, df.repartition(4)


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def kept_tokens(z, k, p, t):
    """Survivors as (token, probability), straight from the definitions."""
    z = z / (t if t > 0 else 1.0)
    alive = np.ones(len(z), bool)
    if k > 0:
        alive &= z >= np.sort(z)[::-1][min(k, len(z)) - 1]
    if p > 0:
        order = sorted(np.flatnonzero(alive), key=lambda i: (-z[i], i))
        q = softmax(z[order])
        before = np.concatenate([[0.0], np.cumsum(q)[:-1]])
        alive = np.zeros(len(z), bool)
        alive[[i for i, b in zip(order, before) if b <= p]] = True
    live = np.flatnonzero(alive)
    return dict(zip(live.tolist(), softmax(z[live])))


@pytest.mark.parametrize(
    "k,p,t", [(5, 0.0, 1.0), (0, 0.8, 0.7), (6, 0.6, 0.0), (0, 0.0, 2.0), (100, 0.999, 1.0), (1, 0.5, 1.0)]
)
def test_filters(table, k, p, t):
    z, df = table
    rows = sampling.surviving_tokens(df, "row_id", k, p, t).collect()
    for i in range(200):
        want = kept_tokens(z[i], k, p, t)
        got = {r.tok: r.p for r in rows if r.row_id == i}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)


def test_long_form_agrees_with_array_form(table):
    _, df = table
    tokens = df.select("row_id", F.posexplode("logits").alias("tok", "z"))
    for k, p in ((6, 0.6), (0, 0.8), (4, 0.0)):
        long = sampling.long_top_p(sampling.long_top_k(tokens, k), p)
        flat = sampling.surviving_tokens(df, "row_id", k, p, 1.0)
        assert {(r.row_id, r.tok) for r in long.collect()} == {
            (r.row_id, r.tok) for r in flat.collect()
        }


def test_known_filters(spark):
    ties = spark.createDataFrame([(0, [3.0, 2.0, 2.0, 1.0])], "row_id int, logits array<double>")
    kept = sampling.surviving_tokens(ties, "row_id", 2, 0.0, 1.0).collect()
    assert sorted(r.z for r in kept) == [2.0, 2.0, 3.0]
    probs = [math.log(x) for x in (0.5, 0.3, 0.2)]
    df = spark.createDataFrame([(0, probs)], "row_id int, logits array<double>")
    sizes = [sampling.surviving_tokens(df, "row_id", 0, p, 1.0).count() for p in (0.4, 0.6)]
    assert sizes == [1, 2]


def test_draws_follow_the_probabilities(spark):
    probs = [math.log(x) for x in (0.2, 0.5, 0.3)]
    df = spark.range(6000).select(
        F.col("id").alias("row_id"), F.array(*map(F.lit, probs)).alias("logits")
    )
    def draw(step):
        rows = sampling.sample_next_token(df, "row_id", 1, step, 0, 0.0).collect()
        return [r.token for r in sorted(rows, key=lambda r: r.row_id)]

    first = draw(0)
    shares = [first.count(i) / 6000 for i in range(3)]
    assert all(abs(s - p) < 0.03 for s, p in zip(shares, (0.2, 0.5, 0.3)))
    assert first == draw(0) and first != draw(1)


def test_loss_and_argmax(table):
    z, df = table
    rows = df.select(
        "row_id",
        "target",
        L.smoothed_loss(F.col("logits"), F.col("target"), 0.1).alias("loss"),
        L.argmax_token(F.col("logits")).alias("a"),
    ).collect()
    for r in rows:
        logp = np.log(softmax(z[r.row_id]))
        want = -(0.9 * logp[r.target] + 0.1 * logp.mean())
        assert math.isclose(r.loss, want, rel_tol=1e-9)
        assert r.a == int(z[r.row_id].argmax())


def test_ignored_targets(table):
    _, df = table
    marked = df.withColumn("target", F.when(F.col("row_id") < 50, F.lit(-100)).otherwise(F.col("target")))
    assert metrics.mean_loss(marked).first().n == 150
    assert metrics.mean_loss(marked.limit(0)).first().loss is None


def results(spark, rows):
    return spark.createDataFrame(rows, "domain string, correct bigint, total bigint")


def test_domain_accuracy_and_gap(spark):
    df = results(spark, [("web", 8, 10), ("math", 1, 2), ("math", 2, 4), ("other", 0, 0)])
    assert {r.domain: r.accuracy for r in metrics.domain_accuracy(df).collect()} == {
        "web": 0.8, "math": 0.5,
    }
    assert math.isclose(metrics.domain_gap(df, "web", "math").first().gap, 0.3)
    assert metrics.domain_gap(df, "web", "other").first().gap is None
    assert metrics.domain_gap(df, "web", "absent").first().gap is None


def test_accuracies(spark):
    pad = 0
    rows = [
        # batch, example, domain, pos, predicted, target
        (0, 0, "web", 0, 1, 1), (0, 0, "web", 1, 2, 3), (0, 1, None, 0, 0, 0), (0, 1, None, 1, 5, 5),
        (1, 2, "math", 0, 4, 4), (2, 3, "math", 0, 0, 0),
    ]
    df = spark.createDataFrame(
        rows, "batch_id int, example_id int, domain string, pos int, predicted int, target int"
    )
    batches = metrics.batch_accuracy(df, pad)
    got = {r.batch_id: (r.correct, r.total, r.n_examples, r.accuracy) for r in batches.collect()}
    assert got == {0: (2, 3, 2, 2 / 3), 1: (1, 1, 1, 1.0), 2: (0, 0, 1, None)}
    epoch = metrics.epoch_accuracy(batches).first().accuracy
    assert math.isclose(epoch, (2 / 3 * 2 + 1.0) / 3)
    per_example = {r.example_id: (r.domain, r.correct, r.total) for r in metrics.example_results(df, pad).collect()}
    assert per_example == {0: ("web", 1, 2), 1: ("unknown", 1, 1), 2: ("math", 1, 1), 3: ("math", 0, 0)}


def test_evaluate_limits_batches(table):
    _, df = table
    full = df.selectExpr(
        "row_id div 10 as batch_id", "row_id as example_id",
        "if(row_id % 2 = 0, 'web', 'math') as domain", "0 as pos", "logits", "target",
    )
    few = evaluate(full, -1, ("web", "math"), max_batches=15)
    assert few.loss.first().n == 150
    assert sum(r.total for r in few.by_domain.collect()) == 150
    assert few.gap.first().gap is not None and few.accuracy.first().accuracy is not None


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(50)] + [(50, [0.0] * 8), (51, None)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    gain = [0.5 * j for j in range(8)]
    a_p, b_p, a_n, b_n = (rng.normal(size=s) for s in ((4, 8), (3, 4), (4, 8), (4, 4)))
    bias = rng.normal(size=4)
    periodic = V.periodic_features(a_p, b_p, a_n, b_n, bias)
    got = {
        r.i: r
        for r in df.select(
            "i",
            V.l2_normalize(F.col("v")).alias("l2"),
            V.rms_normalize(F.col("v"), gain=gain).alias("rms"),
            periodic(F.col("v")).alias("f"),
        ).collect()
    }
    erf = np.vectorize(math.erf)

    def gelu(y):
        return 0.5 * y * (1 + erf(y / math.sqrt(2)))

    for i in range(50):
        assert np.allclose(got[i].l2, x[i] / np.linalg.norm(x[i]))
        assert np.allclose(got[i].rms, x[i] / np.sqrt((x[i] ** 2).mean() + 1e-5) * gain)
        p, n = b_p @ gelu(a_p @ x[i]), b_n @ gelu(a_n @ x[i]) + bias
        assert np.allclose(got[i].f, np.concatenate([np.cos(p), np.sin(p), n]))
    assert got[50].l2 == [0.0] * 8 and got[51].f is None and got[51].l2 is None
    assert V.periodic_dims(20, 0.15) == (3, 14)


def test_periodic_weights_are_bounded():
    wide = np.zeros((4001, 4000))
    with pytest.raises(ValueError, match="weights"):
        V.periodic_features(wide, wide, wide, wide, [])


@pytest.mark.parametrize("k,p", [(1, 0.0), (3, 0.5), (0, 0.9), (7, 1.0), (500, 0.3), (0, 1e-9)])
def test_long_filters_sort_the_border_bin_only(spark, k, p):
    """Against sorting whole rows: ties, logits far below the largest, one row with most tokens."""
    import math
    import random

    rng = random.Random(k)
    rows = [("hot", t, rng.choice([rng.gauss(0, 3), 2.0, -900.0, float("-inf")])) for t in range(600)]
    rows += [(f"r{i}", t, rng.choice([rng.gauss(0, 1), 1.0])) for i in range(20) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, float(t % 2)) for t in range(6)]
    df = spark.createDataFrame(rows, "row_id string, tok int, z double").repartition(5)
    want = set()
    for row in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == row), key=lambda r: (-r[2], r[1]))
        if k > 0:
            mine = [r for r in mine if r[2] >= mine[min(k, len(mine)) - 1][2]]
        if p > 0:
            e = [math.exp(r[2] - mine[0][2]) for r in mine]
            mine = [r for i, r in enumerate(mine) if sum(e[:i]) / sum(e) <= p]
        want |= {(r[0], r[1]) for r in mine}
    out = sampling.long_top_p(sampling.long_top_k(df, k), p)
    assert out.columns == ["row_id", "tok", "z"]
    got = [(r.row_id, r.tok) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_an_epoch_folded_from_arrivals_in_any_order(spark, tmp_path):
    from millrace.streaming import epoch_metrics as E

    rows = [(b, b * 3 + e, ["web", "math", None][e], p, (b * e + p) % 4, p % 4) for b in range(6) for e in range(3) for p in range(5)]
    schema = "batch_id bigint, example_id bigint, domain string, pos int, predicted int, target int"
    pred = spark.createDataFrame(rows, schema)
    out, arrivals = str(tmp_path / "out"), tmp_path / "in"
    for k in range(4):
        pred.where(F.expr(f"(pos + batch_id) % 4 = {k}")).write.parquet(f"{arrivals}/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{arrivals}/*")
        E.start_epoch_sink(stream, out, 3).awaitTermination()
        if k in (1, 2):
            E.fold(spark, out)
            E.fold(spark, out)  # nothing left to do

    def same(got, want):
        return sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)

    results = metrics.example_results(pred, 3)
    assert same(E.read_example_results(spark, out), results)
    assert same(E.read_domain_accuracy(spark, out), metrics.domain_accuracy(results))
    assert same(E.read_batch_accuracy(spark, out), metrics.batch_accuracy(pred, 3))
    assert same(E.read_domain_gap(spark, out, "web", "math"), metrics.domain_gap(results, "web", "math"))
    # Folded, but the crash came before the parts were deleted: they do not count twice.
    (folded,) = [p for p in (tmp_path / "out" / "parts").glob("first=0/last=*")]
    part = E.partial_counts(pred.where("batch_id = 0"), 3)
    part.write.parquet(f"{out}/parts/first=1/last=1")
    assert folded.name == "last=2" and same(E.read_domain_accuracy(spark, out), metrics.domain_accuracy(results))
    # A replay of the last arrival overwrites its part.
    E.partial_counts(pred.where("(pos + batch_id) % 4 = 3"), 3).write.mode("overwrite").parquet(f"{out}/parts/first=3/last=3")
    assert same(E.read_example_results(spark, out), results)
