"""Mixing sources."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vectriage.llm import mixing

SCHEMA = "doc_id long, text string, d string, l string, s string"


def shares(budget, children):
    """Water-filling in exact fractions: {name: (weight, capacity)} to {name: amount}."""
    from fractions import Fraction

    out, left, rest = {}, dict(children), Fraction(budget)
    while left:
        total = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if total and Fraction(c) <= rest * w / total] if total else []
        if not full:
            return out | {n: rest * w / total if total else Fraction(0) for n, (w, _) in left.items()}
        for n in full:
            out[n] = Fraction(left.pop(n)[1])
        rest -= sum(out[n] for n in full)
    return out


def mixed(spark, rows, weights, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return mixing.mix_sources(df, F.col("d"), F.col("l"), F.col("s"), weights, **more)


def test_budgets_follow_weights_and_shortages_go_to_siblings_first(spark):
    rows, n = [], 0
    for d, l, s, docs in [("a", "x", "s1", 4), ("a", "x", "s2", 200), ("a", "y", "s1", 3), ("b", "x", "s1", 90), ("b", "y", "s9", 150), ("c", "z", "s4", 1)]:
        for _ in range(docs):
            rows.append((n, " ".join(["w"] * (1 + n % 7)), d, l, s))
            n += 1
    weights = {"domain": {"a": 5, "b": 3, "c": 2}, "language": {"x": 3}, "origin": {"s2": 2}}
    size = {}
    for _, t, d, l, s in rows:
        size[d, l, s] = size.get((d, l, s), 0) + len(t.split())
    for budget in (0, 50, 400, 900, 10**9):
        got = {}
        for r in mixed(spark, rows, weights, budget=budget, max_epochs=2).collect():
            got[r.domain, r.language, r.origin] = got.get((r.domain, r.language, r.origin), 0) + r.taken
        cap = {k: 2 * v for k, v in size.items()}
        top = shares(min(budget, sum(cap.values())), {d: (weights["domain"][d], sum(v for k, v in cap.items() if k[0] == d)) for d in "abc"})
        for d in "abc":
            mid = shares(top[d], {l: (3 if l == "x" else 1, sum(v for k, v in cap.items() if k[:2] == (d, l))) for l in {k[1] for k in cap if k[0] == d}})
            for l, given in mid.items():
                for s, amount in shares(given, {k[2]: (2 if k[2] == "s2" else 1, v) for k, v in cap.items() if k[:2] == (d, l)}).items():
                    assert abs(got.get((d, l, s), 0) - amount) < 3
        assert sum(got.values()) == min(budget, sum(cap.values()))


def test_epochs_and_prefix(spark):
    rows = [(i, "a b c", "d", "l", "s") for i in range(10)]
    got = mixed(spark, rows, {}, budget=70, max_epochs=5).collect()
    assert sum(r.taken for r in got) == 70 and sorted(r.epoch for r in got) == [0] * 10 + [1] * 10 + [2] * 4
    assert sorted(r.taken for r in got if r.epoch == 2) == [1, 3, 3, 3]
    again = mixed(spark, rows, {}, budget=67, max_epochs=5).collect()
    assert {r.doc_id for r in again if r.epoch == 2} <= {r.doc_id for r in got if r.epoch == 2}
    seeds = [frozenset(r.doc_id for r in mixed(spark, rows, {}, budget=67, max_epochs=5, seed=s).collect() if r.epoch == 2) for s in range(2, 5)]
    assert len({*seeds, frozenset(r.doc_id for r in again if r.epoch == 2)}) > 1  # the order of an epoch comes from the seed


def test_edges(spark):
    rows = [(1, None, "d", "l", "s"), (2, "", "d", "l", "s"), (3, " \t", None, None, None), (4, "one", None, None, None), (4, "one", None, None, None), (None, "two words", "d", "l", None), (5, "x " * 30000, "z", "l", "s")]
    got = sorted((str(r.doc_id), r.domain, r.language, r.origin, r.taken) for r in mixed(spark, rows, {}, share=1.0, max_epochs=1).collect())
    assert got == [("4", "unknown", "unknown", "unknown", 1), ("4", "unknown", "unknown", "unknown", 1), ("5", "z", "l", "s", 30000), ("None", "d", "l", "unknown", 2)]
    assert mixed(spark, rows[:3], {}, share=1.0).count() == 0
    assert mixed(spark, rows, {"domain": {"z": 0}}, share=1.0, max_epochs=1).where("doc_id = 5").count() == 0
    clash = spark.createDataFrame([(1, "a b", 7, "q")], "doc_id long, text string, tokens int, language string")
    out = mixing.mix_sources(clash, F.lit("d"), F.col("language"), F.lit("s"), {}, share=1.0).first()
    assert (out.tokens, out.language, out.taken) == (2, "q", 2)
    with pytest.raises(ValueError):
        mixing.mix_sources(clash, F.lit("d"), F.lit("l"), F.lit("s"), {})


def test_cut_text(spark):
    df = spark.createDataFrame([("a  b\nc", 3, 2), ("a  b\nc", 3, 3), (" a b", 2, 1)], "t string, n long, k long")
    assert [r[0] for r in df.select(mixing.cut_text(F.col("t"), F.col("n"), F.col("k"))).collect()] == ["a b", "a  b\nc", "a"]


def test_query_and_sql(spark, sf_dir):
    from vectriage.llm.queries import ORACLE, QUERIES

    df = QUERIES["op2_mix_sources"](spark, sf_dir)
    got = sorted(tuple(r) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    rel = con.sql(ORACLE["op2_mix_sources"])
    assert rel.columns == df.columns
    assert got == sorted(rel.fetchall())
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
