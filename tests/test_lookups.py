"""Lookups of many references and many symbols of one name: right, and never pair by pair."""

import random

from pyspark.sql import functions as F

from loomgraph.kinds import KIND_SETS
from loomgraph.operators import resolve as N


def joined_rows(df):
    """The most rows that a join of the executed plan put out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        if ("Join" in name or "Product" in name) and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
    return most


def test_lexical_against_brute_force(spark):
    rng = random.Random(5)
    kinds = ["struct", "method", "function", "trait"]
    some = lambda n: rng.choice([None, *range(n)])
    symbols = [(i, rng.choice(kinds), some(4), some(3)) for i in range(200)]
    named = [(rng.randrange(6), rng.choice("ab"), i, rng.randrange(9)) for i in range(200) for _ in range(rng.randrange(1, 3))]
    chain = [(s, a, rng.randrange(3)) for s in range(5) for a in rng.sample(range(6), 4)]
    refs = [(i, rng.randrange(5), rng.choice("abc"), rng.choice([None, "types", "call_target"]), some(4), some(3)) for i in range(300)]
    want = {}
    for ref, scope, name, kind_set, unit, package in refs:
        met = [(d, o, s) for c, a, d in chain if c == scope for at, n, s, o in named if at == a and n == name and (kind_set is None or symbols[s][1] in KIND_SETS[kind_set])]
        same = lambda a, b: -1 if a is None or b is None else int(a == b)
        if met:
            want[ref] = max((same(symbols[s][2], unit), same(symbols[s][3], package), o, s) for d, o, s in met if d == min(met)[0])[3]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = N.lexical(
        frame(refs, "ref_id long, scope_id long, name string, kinds string, ref_unit long, ref_package long"), frame(chain, "scope_id long, ancestor_id long, depth int"),
        frame(named, "scope_id long, name string, symbol_id long, ordinal long"), frame(symbols, "symbol_id long, kind string, unit_id long, package_index long"),
    )
    assert {r.ref_id: r.symbol_id for r in got.collect()} == want


def test_lexical_of_one_name_in_many_units(spark, monkeypatch):
    """2000 references meet 2000 symbols of their name in one scope; each finds its own unit's."""
    seen = []
    rule = N.by_precedence
    monkeypatch.setattr(N, "by_precedence", lambda rows, key="ref_id": (seen.append(rows.count()), rule(rows, key))[1])
    n = spark.range(2000)
    symbols = n.select(F.col("id").alias("symbol_id"), F.lit("struct").alias("kind"), F.col("id").alias("unit_id"), (F.col("id") % 7).alias("package_index"))
    named = n.select(F.lit(1).cast("long").alias("scope_id"), F.lit("x").alias("name"), F.col("id").alias("symbol_id"), F.col("id").alias("ordinal"))
    refs = n.select(F.col("id").alias("ref_id"), F.lit(1).cast("long").alias("scope_id"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("kinds"), F.col("id").alias("ref_unit"), (F.col("id") % 7).alias("ref_package"))
    chain = spark.createDataFrame([(1, 1, 0)], "scope_id long, ancestor_id long, depth int")
    got = N.lexical(refs, chain, named, symbols).collect()
    assert len(got) == 2000 and all(r.ref_id == r.symbol_id for r in got)
    assert max(seen) <= 16 * 2000


def test_overloads_against_brute_force(spark):
    rng = random.Random(6)
    types = lambda: rng.choice([None, [], *[[rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(1, 4))] for _ in range(5)]])
    calls = [(i % 280, rng.choice("fgh"), types()) for i in range(300)]
    known = [(i, rng.choice("fg"), types()) for i in range(25)]
    met = {}
    for call, name, a in calls:
        for symbol, n, b in known:
            if n == name and a is not None and b is not None and len(a) == len(b):
                met.setdefault(call, []).append((sum(x is not None and x == y for x, y in zip(a, b)), symbol))
    want = set()
    for call, rows in met.items():
        best = [s for score, s in rows if score == max(rows)[0]]
        if len(best) == 1 and (max(rows)[0] > 0 or len(rows) == 1):
            want.add((call, best[0]))
    assert want and {tuple(r) for r in N.overloads(spark.createDataFrame(calls, "call_id long, name string, types array<string>"), spark.createDataFrame(known, "symbol_id long, name string, types array<string>")).collect()} == want


def test_overloads_of_equal_signatures_meet_once(spark):
    n = spark.range(1500)
    calls = n.select(F.col("id").alias("call_id"), F.lit("f").alias("name"), F.array(F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("types"))
    known = n.select(F.col("id").alias("symbol_id"), F.lit("f").alias("name"), F.array(F.when(F.col("id") < 1, "a").otherwise("b")).alias("types"))
    out = N.overloads(calls, known)
    assert joined_rows(out) <= 4 * 1500
    assert {tuple(r) for r in out.collect()} == {(i, 0) for i in range(0, 1500, 2)}


def test_member_calls_of_one_receiver_meet_once(spark):
    n = spark.range(1500).withColumn("name", F.when(F.col("id") == 0, "g").otherwise("f"))  # the plan of an empty result is cut
    none = F.array().cast("array<long>").alias("types")
    calls, own = n.select(F.col("id").alias("call_id"), "name", none), n.select(F.col("id").alias("symbol_id"), "name", none)
    out = N.member_calls(calls, own, n.select(F.col("id").alias("ref_id"), (F.col("id") + 7).alias("symbol_id")))
    assert joined_rows(out) <= 4 * 1500
    assert {tuple(r) for r in out.collect()} == {(0, 0), *((i, i + 7) for i in range(1, 1500))}
