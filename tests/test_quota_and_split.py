import pytest
from pyspark.sql import functions as F

from millrace.config import source_quotas
from millrace.functions.cleaning import web_clean
from millrace.operators.quota import Source, first_kept, union_sources
from millrace.operators.reports import (
    attribution,
    domain_stats,
    domain_stats_wide,
    mix_ratio,
    share_report,
    source_counts,
)
from millrace.operators.splitting import split_positions, stratified_split, validation_quotas
from millrace.session import pin


def texts(spark, n, hot=False):
    """Every third text is too short; the keys run downwards in the table."""
    order = f"{n} - id" if not hot else f"if(id % 3 = 1, 5, {n} - id)"
    return spark.range(n).selectExpr(
        f"{order} as a",
        "id as b",
        "if(id % 3 = 0, 'too short', repeat(concat('w', id, ' '), 12)) as text",
    )


def test_quotas_truncate():
    assert source_quotas(300, [0.9]) == [270, 30]
    assert source_quotas(100, [0.29]) == [28, 72]
    with pytest.raises(ValueError):
        source_quotas(10, [0.9, 0.9])


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("quota", [None, 0, 1, 30, 399, 400, 1000])
def test_quota_takes_the_first_kept_rows(spark, hot, quota):
    rows = texts(spark, 600, hot)
    source = Source("web", rows, ["a", "b"], web_clean)
    got = union_sources([source], [quota]).collect()
    kept = sorted((r for r in rows.collect() if r.b % 3), key=lambda r: (r.a, r.b))
    want = kept if quota is None else kept[:quota]
    assert {(r.id, r.text, r.pos) for r in got} == {
        (f"web_{i}", r.text.strip(), i) for i, r in enumerate(want)
    }
    assert len(got) == len(want)


def test_small_quota_cleans_a_small_prefix(spark):
    kept = first_kept(Source("web", texts(spark, 6000), ["a", "b"], web_clean), 20)
    assert 20 <= kept.texts.count() < 200


def test_whole_quota_for_one_source(spark):
    pair = [Source(d, texts(spark, 90), ["a", "b"], web_clean) for d in ("web", "math")]
    got = union_sources(pair, source_quotas(40, (1.0,))).collect()
    assert len(got) == 40 and {r.domain for r in got} == {"web"}


def test_a_source_is_cleaned_once_and_filtered_before_the_exchange(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    counted = counted.asNondeterministic()
    rows = texts(spark, 500).withColumn("text", counted("text"))
    plans = []

    def save(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df, label)

    kept = first_kept(Source("web", rows, ["a", "b"], web_clean), None, save=save)
    assert kept.texts.count() == 333 and seen.value == 500
    assert "Exchange" not in plans[0] and "Exchange" in plans[1]
    assert "regexp_replace" in plans[0] and "regexp_replace" not in plans[1]
    # The text is written once; only keys are put in order.
    assert "text#" in plans[0] and "text" not in plans[1]


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_time_keys_stop_early_too(spark, kind):
    day = "date_add(date'2020-01-01', cast(a as int))"
    rows = texts(spark, 3000).withColumn("a", F.expr(day if kind == "date" else f"cast({day} as timestamp)"))
    source = Source("web", rows, ["a", "b"], web_clean)
    assert first_kept(source, 20).texts.count() < 200
    want = [r.text.strip() for r in sorted((r for r in rows.collect() if r.b % 3), key=lambda r: (r.a, r.b))][:20]
    got = sorted(union_sources([source], [20]).collect(), key=lambda r: r.pos)
    assert [r.text for r in got] == want


@pytest.mark.parametrize("kind", ["string", "composite", "decimal"])
def test_keys_of_any_type_stop_early(spark, kind):
    """A quota of 20 of 3000 rows: the rows cleaned are counted."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    counted = counted.asNondeterministic()
    first = {"string": "format_string('é%06d', a)", "composite": "cast(a div 2000 as string)", "decimal": "cast(a / 7 as decimal(12, 4))"}[kind]
    rows = texts(spark, 3000).withColumn("b", F.lpad(F.col("a").cast("string"), 6, "0")).withColumn("a", F.expr(first))
    rows = rows.withColumn("a", F.when(F.col("b") != "000007", F.col("a")))
    want = sorted((r for r in rows.collect() if r.text != "too short"), key=lambda r: (r.a is not None, r.a or 0, r.b))
    clean = lambda c: web_clean(counted(c))
    got = union_sources([Source("web", rows, ["a", "b"], clean)], [20]).orderBy("pos").collect()
    assert [r.text for r in got] == [r.text.strip() for r in want[:20]]
    assert 20 <= seen.value < 300


def test_a_quota_between_equal_keys(spark):
    """Slices end between keys, wherever the sketch puts them."""
    rows = texts(spark, 600).withColumn("a", F.lit("same"))
    got = union_sources([Source("web", rows, ["a", "b"], web_clean)], [7]).orderBy("pos").collect()
    kept = sorted((r for r in rows.collect() if r.b % 3), key=lambda r: r.b)
    assert [r.text for r in got] == [r.text.strip() for r in kept[:7]]


def test_quota_counts_rows_without_a_key(spark):
    rows = texts(spark, 300).withColumn("a", F.when(F.col("b") != 1, F.col("a")))
    got = union_sources([Source("web", rows, ["a", "b"], web_clean)], [5]).collect()
    assert "w1 " * 11 + "w1" in {r.text for r in got}


def test_union_positions_run_on(spark):
    a = Source("web", texts(spark, 60), ["a"], web_clean)
    b = Source("math", texts(spark, 90), ["a"], web_clean)
    got = sorted(union_sources([a, b], [25, 1000]).collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(25 + 60))
    assert [r.id for r in got[:26]] == [f"web_{i}" for i in range(25)] + ["math_0"]


@pytest.mark.parametrize(
    "counts,ratio,want",
    [
        ({"a": 1000, "b": 536}, 0.1, {"a": 100, "b": 54}),
        ({"a": 10, "b": 10, "c": 10}, 0.5, {"a": 5, "b": 5, "c": 5}),
        ({"a": 7, "b": 7, "c": 7}, 0.25, {"a": 2, "b": 2, "c": 2}),
        ({"a": 3, "b": 3, "c": 4}, 0.35, {"a": 1, "b": 1, "c": 2}),
        ({"a": 4 * 10**18, "b": 10**18}, 0.5, {"a": 2 * 10**18, "b": 5 * 10**17}),
    ],
)
def test_validation_quotas(spark, counts, ratio, want):
    df = spark.createDataFrame(list(counts.items()), "domain string, n bigint")
    assert {r.domain: r.n_val for r in validation_quotas(df, ratio).collect()} == want


@pytest.fixture(scope="module")
def examples(spark):
    return spark.range(1536).selectExpr(
        "if(id < 1000, concat('web_', id), concat('math_', id - 1000)) as id",
        "if(id < 1000, 'web', 'math') as domain",
    )


def test_split_is_exact_disjoint_and_complete(examples):
    rows = stratified_split(examples, 0.1, 42).collect()
    assert len(rows) == 1536 and len({r.id for r in rows}) == 1536
    val = [r.domain for r in rows if r.split == "validation"]
    assert (val.count("web"), val.count("math")) == (100, 54)


def test_split_does_not_depend_on_partitioning(examples):
    def ids(parts):
        rows = stratified_split(examples.repartition(parts), 0.1, 42).collect()
        return {r.id for r in rows if r.split == "validation"}

    assert ids(1) == ids(4) == ids(8)
    other = stratified_split(examples, 0.1, 43).filter("split = 'validation'").collect()
    assert {r.id for r in other} != ids(1)


def test_split_positions_are_dense(examples):
    rows = split_positions(stratified_split(examples, 0.1, 42), 42).collect()
    for split, n in (("train", 1382), ("validation", 154)):
        assert sorted(r.split_pos for r in rows if r.split == split) == list(range(n))


@pytest.mark.parametrize("extra", [1, 3])
def test_split_refuses_domains_too_small(examples, extra):
    small = examples.sparkSession.range(extra).selectExpr(
        "concat('tiny_', id) as id", "'tiny' as domain"
    )
    with pytest.raises(ValueError, match="tiny"):
        stratified_split(examples.union(small), 0.1, 42)


def test_reports(spark):
    rows = [("train", "web")] * 6 + [("train", "math")] * 2 + [("validation", "web")]
    df = spark.createDataFrame(rows, "split string, domain string")
    stats = domain_stats(df)
    assert {(r.split, r.domain, r.n, r.pct) for r in stats.collect()} == {
        ("train", "web", 6, 75.0), ("train", "math", 2, 25.0), ("validation", "web", 1, 100.0),
    }
    wide = {r.split: r for r in domain_stats_wide(stats, ["web", "math"]).collect()}
    assert (wide["validation"].math_count, wide["validation"].math_percent) == (0, 0.0)
    assert {r.domain: r.n for r in source_counts(df).collect()} == {"web": 7, "math": 2}
    assert {r.domain: r.pct for r in mix_ratio(df).collect()} == {"web": 77.8, "math": 22.2}
    zero = share_report(df.withColumn("w", F.lit(0)), "domain", F.col("w")).collect()
    assert {r.pct for r in zero} == {0.0}


def test_attribution_also_for_nothing(spark):
    df = spark.createDataFrame([("web",)] * 9 + [("math",)], "domain string")
    labels = {"web": "Web", "math": "Math"}
    row = attribution(df, {"source": "s"}, labels, 10, "today").first()
    assert row.mix_ratio == "90.0% Web, 10.0% Math"
    assert (row.processed_examples, row.min_words_exclusive, row.source) == (10, 10, "s")
    empty = attribution(df.limit(0), {}, labels, 10, "today").first()
    assert empty.mix_ratio is None and empty.processed_examples == 0
