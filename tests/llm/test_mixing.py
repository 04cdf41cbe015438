import helpers as H
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def targets(sizes: dict, share: float = 1.0) -> dict:
    """Water filling by repeated sharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= 3 * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_targets_and_takings(spark):
    got = mixing.mix(H.documents(spark)).collect()
    assert len(got) == len(H.rows())
    sizes = {}
    for r in H.rows():
        sizes[r[2]] = sizes.get(r[2], 0) + len(H.blanks(r[1]))
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r["size"] == len(H.blanks(r["text"]))
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        whole = int(r["target"] / sizes[r["source"]] + 1e-9)
        assert r["copies"] in (whole, whole + 1)  # complete epochs come first
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(len(H.blanks(r[1])) for r in H.rows() if r[2] == s) / 2 + 1e-6


def test_order_is_by_exponential_keys(spark):
    """Brute force: sort every source by key and take while the middle fits."""
    data = [(i, H.prose(i, 5 + i % 40), "s", "en", 0, 0, 0.0, "", "", "") for i in range(700)]
    docs = H.documents(spark, data + [(9000, H.prose(1, 4000), "t", "en", 0, 0, 0.0, "", "", "")])
    got = {r["doc_id"]: r for r in mixing.mix(docs, weights=(1, 2)).collect()}
    keyed = mixing.sized(docs).where("source = 's'").select("doc_id", "size", "_mix_at").collect()
    before, rest = 0, got[0]["target"] % got[0]["source_size"]
    for r in sorted(keyed, key=lambda r: (r["_mix_at"], r["doc_id"])):
        inside = before + r["size"] / 2 <= rest
        assert got[r["doc_id"]]["copies"] == int(inside) + int(got[0]["target"] // got[0]["source_size"])
        before += r["size"]


def test_heavier_documents_are_taken_more_often(spark):
    data = [(i, H.prose(i, 30), "s" if i < 2000 else "t", "en", 0, 0, 0.0, "", "", "") for i in range(4000)]
    docs = H.documents(spark, data)
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(F.when(F.col("doc_id") % 4 == 1, None).otherwise(1.0))
    out = mixing.mix(docs, quality=weight, weights=(1, 3), with_text=True).where("source = 's' and copies > 0")
    got = {r[0]: r[1] for r in out.groupBy((F.col("doc_id") % 4).alias("k")).count().collect()}
    assert got[0] > 1.5 * got[3] and got[2] > 1.5 * got[3] and got.get(1, 0) < got[3] / 20


def test_partitioning_does_not_matter_and_tables_may_be_empty(spark):
    docs = H.documents(spark)
    a = sorted(map(str, mixing.mix(docs, with_text=False).collect()))
    b = sorted(map(str, mixing.mix(docs.repartition(7, "text"), with_text=False).collect()))
    assert a == b
    assert mixing.mix(H.nothing(spark)).collect() == []
    assert mixing.mixed_documents(H.nothing(spark)).columns == docs.columns


def test_mixed_documents_repeat(spark):
    docs = H.documents(spark)
    want = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == want
    assert out.distinct().exceptAll(docs.distinct()).count() == 0
