from collections import defaultdict

import helpers as H
from pyspark.sql import functions as F

from millrace.llm import line_dedup as D

FIELDS = ("s", "en", 0, 0, 0.0, "", "", "")


def documents(spark):
    rows = []
    for i in range(60):
        site = None if i % 19 == 0 else f"site{i % 12}"
        lines = [H.prose(i, 6), "  Everywhere  " if i % 2 else "Everywhere", f"on {i % 12 % 5} sites", "", "   "]
        lines += [f"shared by {i % 4}"] if i % 12 in (0, 4, 8) else []
        rows.append((i, "\n".join(lines), site, *FIELDS[1:]))
    rows += [(60, None, "site1", *FIELDS[1:]), (61, "", "site1", *FIELDS[1:]), (5, rows[5][1], "site5", *FIELDS[1:])]
    return rows, H.documents(spark, rows)


def test_against_exact_counts(spark):
    rows, docs = documents(spark)
    for least, band in ((5, 0.5), (3, 0.5), (3, 10.0)):
        sites = defaultdict(set)
        for r in rows:
            for line in (r[1] or "").split("\n"):
                if r[2] is not None and line.strip(" "):
                    sites[line.strip(" ")].add(r[2])
        spread = {k for k, v in sites.items() if len(v) >= least}
        assert spread
        got = D.remove_spread_lines(docs, least_sites=least, band=band)
        out = sorted((tuple(r) for r in got.select("doc_id", "clean_text", "n_lines", "n_removed").collect()), key=str)
        want = []
        for r in rows:
            lines = [] if r[1] is None else r[1].split("\n")
            kept = [x for x in lines if x.strip(" ") not in spread]
            want.append((r[0], None if r[1] is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
        assert out == sorted(want, key=str)


def test_empty_table_and_plan(spark):
    assert D.remove_spread_lines(H.nothing(spark)).collect() == []
    _, docs = documents(spark)
    plan = D.spread_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert D.remove_spread_lines(docs.withColumn("n_lines", F.lit(1))).columns[-3:] == ["n_lines", "clean_text", "n_removed"]


def test_lines_of_one_site_count_when_one_is_enough(spark):
    rows = [(1, "a\nb", "s"), (2, "c", None), (3, "\n \n", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.clean_text, r.n_lines, r.n_removed) for r in D.remove_spread_lines(docs, least_sites=1).collect()}
    assert got == {1: ("", 2, 2), 2: ("c", 1, 0), 3: ("\n \n", 3, 0)}


def test_spread_lines_too_many_to_hand_out(spark, monkeypatch):
    from millrace.operators import joining

    monkeypatch.setattr(joining.join_lookup, "__defaults__", (1,))
    rows = [(i, f"hot\nown {i}\ntwo {i % 2}", f"s{i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = D.remove_spread_lines(docs)
    assert {r.doc_id: r.clean_text for r in out.collect()} == {i: f"own {i}" for i in range(60)}
