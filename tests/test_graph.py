"""Rank, selection, collection, roll-up, hierarchy and resolution on hand-made graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.kinds import EDGE_KINDS, INFLUENCE, INVERSE, ORCHESTRATION, parse_name
from loomgraph.operators import blocks as B
from loomgraph.operators import collect as C
from loomgraph.operators import meta as M
from loomgraph.operators import rank as K
from loomgraph.operators import relations as R
from loomgraph.operators import resolve as N
from loomgraph.operators import rollup as U
from loomgraph.operators.graph import Graph

BLOCK = "block_id long, unit_id long, kind string, name string, start_line long, symbol_kind string, type_ref long, nested_types array<long>, type_deps array<long>"
META = "unit_id long, project_name string, project_root string, package_name string, package_root string, module_name string, module_root string, file_name string, file_path string, package_index long"


def make(spark, blocks, facts, files=None):
    rows = [(b[0], b[2] if len(b) > 2 else 0, b[1], f"b{b[0]}", b[0], None, b[3] if len(b) > 3 else None, b[4] if len(b) > 4 else None, b[5] if len(b) > 5 else None) for b in blocks]
    rel = R.with_inverses(spark.createDataFrame(facts, "src long, relation string, dst long"))
    meta = spark.createDataFrame([(u, "p", "p", None, None, None, None, f, f, 0) for u, f in (files or {}).items()], META) if files else None
    return Graph(spark.createDataFrame(rows, BLOCK), rel, meta)


def fixture(spark):
    return make(spark, [(1, "class", 1), (2, "func", 1), (3, "func", 2), (4, "field", 2)], [(2, "calls", 3), (2, "uses", 1), (3, "uses", 1), (4, "type_of", 1), (3, "calls", 3)], {1: "f1", 2: "f2"})


@pytest.mark.parametrize("engine", ["one_task", "joins"])
def test_rank_fixture(spark, engine):
    g = fixture(spark)
    got = K.scores(g, iterations=10, engine=engine).orderBy("block_id").collect()
    assert np.allclose([r.influence for r in got], [0.49162113, 0.14558086, 0.23167198, 0.13112602], atol=1e-7)
    assert np.allclose([r.orchestration for r in got], [0.17415117, 0.38304354, 0.20313494, 0.23967035], atol=1e-7)
    assert np.allclose([r.score for r in got], [0.25351866, 0.32367787, 0.21026920, 0.21253427], atol=1e-7)
    assert np.allclose([r.p for r in K.teleport(g.block).orderBy("block_id").collect()], [0.25636364] * 3 + [0.23090909], atol=1e-7)
    done = K.scores(g, engine=engine).orderBy("block_id").collect()
    assert np.allclose([r.score for r in done], [0.25351775, 0.32367933, 0.21026758, 0.21253534], atol=1e-7)
    assert {(r.iterations, r.converged) for r in done} == {(15, True)}
    assert [r.block_id for r in K.top(g, K.scores(g), 4).collect()] == [2, 1, 4, 3]
    assert [r.block_id for r in K.ranked(g, K.scores(g), "influence").orderBy("rank").collect()][0] == 1


def test_rank_engines_agree(spark):
    rng = random.Random(1)
    blocks = [(i, rng.choice(["class", "func", "field", "root"]), i % 3) for i in range(60)]
    facts = [(rng.randrange(60), rng.choice(list(INFLUENCE)), rng.randrange(70)) for _ in range(300)]
    g = make(spark, blocks, facts, {0: "a", 1: "b", 2: "c"})
    options = K.RankOptions(max_degree=3)
    for weights in (INFLUENCE, ORCHESTRATION):
        a = {r.block_id: r["rank"] for r in K.pagerank(g, weights, options, engine="one_task").collect()}
        b = {r.block_id: r["rank"] for r in K.pagerank(g, weights, options, engine="joins").collect()}
        assert abs(sum(a.values()) - 1) < 1e-9 and max(abs(a[k] - b[k]) for k in a) < 1e-9
    degrees = K.adjacency(g, INFLUENCE, options).groupBy("src").agg(F.count("*").alias("n"), F.sum("share").alias("s")).collect()
    assert max(r.n for r in degrees) == 3 and all(abs(r.s - 1) < 1e-12 for r in degrees)
    none = make(spark, blocks, [(0, "calls", 0)])
    assert abs(sum(r["rank"] for r in K.pagerank(none, INFLUENCE).collect()) - 1) < 1e-9


@pytest.mark.parametrize("bad", [{"damping": 1.0}, {"damping": 0}, {"tolerance": 0}, {"max_iterations": 0}, {"max_degree": 0}, {"cross_file_penalty": 1.5}, {"influence_weight": 0, "orchestration_weight": 0}, {"influence_weight": -1}, {"priors": {"class": -1}}])
def test_rank_options(bad):
    with pytest.raises(ValueError):
        K.RankOptions(**bad)


def test_topk_with_coverage(spark):
    scores = [0.24, 0.20, 0.16, 0.13, 0.11, 0.09, 0.07]
    rows = spark.createDataFrame([(i + 1, 0, s, "p::a" if i < 6 else "p::b") for i, s in enumerate(scores)], "block_id long, unit_id long, score double, module string")
    pick = lambda k: sorted(r.block_id for r in K.top_with_coverage(rows, k).collect())
    assert pick(0) == [1] and pick(1) == [1] and pick(5) == [1, 2, 3, 4, 7] and pick(7) == [1, 2, 3, 4, 5, 6, 7]


def test_component_rollup(spark):
    nodes = spark.createDataFrame([(1, 0, "A", None), (2, 0, "A", None), (3, 1, "B", None)], "block_id long, unit_id long, component_id string, folder string")
    edges = spark.createDataFrame([(1, 3, "call"), (3, 2, "field"), (2, 3, "return"), (1, 2, "call")], "from_id long, to_id long, kind string")
    assert [tuple(r) for r in U.component_edges(nodes, edges).collect()] == [("A", "B", 3, "call:1,field:1,return:1")]


def edges_of(graph):
    return {(r.from_id, r.to_id, r.kind) for r in C.edges(graph).collect()}


def test_suppression(spark):
    f_t = [(1, "func"), (2, "class"), (3, "return"), (4, "func")]
    g = make(spark, f_t, [(1, "has_return", 3), (3, "type_of", 2), (1, "uses", 2), (4, "uses", 2)])
    assert edges_of(g) == {(1, 2, "return"), (4, 2, "type_dep")}
    g = make(spark, [(1, "func"), (2, "trait")], [(1, "uses", 2)])
    assert edges_of(g) == set()
    g = make(spark, [(1, "class"), (2, "class"), (3, "class"), (5, "field", 0, 2, [2, 3])], [(1, "has_field", 5), (5, "type_of", 2)])
    assert edges_of(g) == {(2, 1, "nested_field"), (3, 1, "nested_field")}
    g = make(spark, [(1, "class"), (2, "class"), (3, "trait"), (5, "field", 0, 2, [3]), (6, "field", 0, 2, [2])], [(1, "has_field", 5), (1, "has_field", 6), (5, "type_of", 2), (6, "type_of", 2)])
    assert edges_of(g) == {(3, 2, "type_arg"), (2, 1, "nested_field")}
    g = make(spark, [(1, "class"), (2, "class"), (5, "field", 0, 2, [2]), (6, "field")], [(1, "has_field", 5), (1, "has_field", 6), (5, "type_of", 2), (6, "type_of", 2)])
    assert (2, 1, "field") in edges_of(g)
    g = make(spark, [(1, "class", 0, None, None, [2, 1]), (2, "enum"), (3, "func"), (7, "impl"), (8, "interface")], [(1, "uses", 3), (7, "impl_for", 1), (7, "implements", 8), (1, "implements", 8), (2, "extends", 1)])
    assert edges_of(g) == {(2, 1, "impl_arg"), (3, 1, "annotation"), (8, 1, "conformance"), (1, 2, "specialization")}
    assert g.contracts().where("src = 1").count() == 2
    g = make(spark, [(1, "class"), (5, "field"), (6, "field"), (2, "class")], [(1, "has_field", 5), (5, "has_field", 6), (6, "has_field", 5), (6, "type_of", 2)])
    assert edges_of(g) == {(2, 1, "field")}
    nodes = C.nodes(g)
    assert {r.block_id for r in C.without_orphans(nodes, C.edges(g)).collect()} == {1, 2}
    assert C.retain(nodes, C.edges(g), nodes.where("block_id = 1"))[1].count() == 0


def test_relation_maintenance(spark):
    g = make(spark, [(1, "func"), (2, "func"), (3, "class")], [(1, "calls", 2), (1, "uses", 3), (2, "has_parameters", 3)])
    assert all(INVERSE[INVERSE[k]] == k for k in INVERSE)
    assert g.relation.count() == 5
    assert R.remove(g.relation, spark.createDataFrame([(1, "calls", 2)], "src long, relation string, dst long")).count() == 3
    assert R.remove_kind(g.relation, 1, "uses").count() == 3
    assert R.remove_blocks(g.relation, spark.createDataFrame([(3,)], "block_id long")).count() == 2
    assert R.add(g.relation, spark.createDataFrame([(1, "calls", 2), (2, "calls", 1)], "src long, relation string, dst long")).count() == 7
    assert {r.src for r in g.has_related("calls").collect()} == {1} and g.contains(1, "calls", 2) and not g.contains(2, "calls", 1)
    rows = {r.relation: (r.n, r.sources) for r in R.stats(g.relation).collect()}
    assert rows[None] == (5, 3) and rows["calls"] == (1, 1)
    assert R.relations_from(g.relation).where("src = 1").orderBy("ordinal").collect()[0].relation == "calls"
    assert g.symbol_of(1).count() == 1 and g.contains_block(1) and not g.contains_block(9)


def test_names():
    assert parse_name(" Type_Dep ", EDGE_KINDS) == "type_dep"
    with pytest.raises(ValueError):
        parse_name("typedep", EDGE_KINDS)


def test_precedence(spark):
    def best(*rows):
        df = spark.createDataFrame([(0, s, u, p, d, o, 1, 0) for s, u, p, d, o in rows], "ref_id long, symbol_id long, unit_id long, package_index long, depth int, ordinal long, ref_unit long, ref_package long")
        return N.by_precedence(N.innermost(df)).collect()[0].symbol_id

    assert best((1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (3, 2, 1, 0, 2)) == 2
    assert best((1, 0, 0, 0, 0), (3, 2, 1, 0, 1)) == 1
    assert best((3, 2, 1, 0, 0), (4, 3, 2, 0, 1)) == 4
    assert best((2, 1, 0, 1, 0), (5, 2, 1, 0, 1)) == 5


def test_chase_and_references(spark):
    rows = [(1, "type_alias", 2), (2, "type_alias", 3), (3, "struct", None), (4, "type_alias", 5), (5, "type_alias", 4), (6, "type_alias", 99), (7, "variable", 3)]
    symbol = spark.createDataFrame(rows, "symbol_id long, kind string, type_of long")
    got = {r.symbol_id: r.target_id for r in N.chase(symbol).collect()}
    assert {k: got[k] for k in (1, 2, 3, 6, 7)} == {1: 3, 2: 3, 3: 3, 6: 6, 7: 7} and got[4] in (4, 5)
    refs = {r.symbol_id: r.type_symbol_id for r in N.type_reference(symbol, N.chase(symbol)).collect()}
    assert refs[1] == 3 and refs[3] == 3 and refs[7] == 3


def test_members_and_overloads(spark):
    symbol = spark.createDataFrame([(1, "struct", 0, 0, 10), (2, "struct", 0, 0, 20), (3, "field", 0, 0, None), (4, "method", 0, 0, None)], "symbol_id long, kind string, unit_id long, package_index long, owned_scope_id long")
    named = spark.createDataFrame([(10, "run", 3, 0), (20, "go", 4, 0)], "scope_id long, name string, symbol_id long, ordinal long")
    up = spark.createDataFrame([(10, 20, 0), (20, 10, 0)], "scope_id long, parent_id long, ordinal long")
    same = symbol.select("symbol_id", F.col("symbol_id").alias("target_id"))
    refs = spark.createDataFrame([(1, 1, "run", 0, 0), (2, 1, "go", 0, 0), (3, 2, "none", 0, 0)], "ref_id long, receiver_id long, name string, ref_unit long, ref_package long")
    assert {tuple(r) for r in N.members(refs, same, symbol, up, named).collect()} == {(1, 3), (2, 4)}
    calls = spark.createDataFrame([(1, "f", ["int"]), (2, "f", ["x", "y"]), (3, "f", [None]), (4, "g", [])], "call_id long, name string, types array<string>")
    cands = spark.createDataFrame([(1, "f", ["int"]), (2, "f", ["str"]), (3, "f", ["a", "b"])], "symbol_id long, name string, types array<string>")
    assert {tuple(r) for r in N.overloads(calls, cands).collect()} == {(1, 1), (2, 3)}


def test_declarations(spark):
    rows = spark.createDataFrame([(1, "a", "unknown", 0, 10), (1, "a", "struct", 1, 11), (1, "a", "enum", 2, 12), (2, "a", "unknown", 3, 13)], "scope_id long, name string, kind string, ordinal long, symbol_id long")
    assert {(r.scope_id, r.symbol_id, r.declared_kind) for r in N.declare(rows).collect()} == {(1, 10, "struct"), (2, 13, "unknown")}
    assert N.declare_global(rows).count() == 3


def test_blocks(spark):
    schema = "block_id long, parent_id long, kind string, symbol_kind string, symbol_id long, name string, ordinal long"
    rows = spark.createDataFrame([(1, None, "root", None, None, None, 0), (2, 1, "impl", None, None, None, 0), (3, 2, "func", "function", 30, "f", 0), (4, 1, "func", None, None, None, 1), (5, 4, "call", None, None, None, 0), (6, 3, "parameter", None, 60, "x", 0)], schema)
    assert {r.block_id: r.kind for r in B.methods(rows).collect()}[3] == "method"
    assert {r.block_id: r.parent_id for r in B.materialized(rows).collect()} == {1: None, 2: 1, 3: 2, 5: 1, 6: 3}
    assert [tuple(r) for r in B.members(rows).collect()] == [(3, "func", 6, "parameter")]


def test_modules(spark):
    files = [(i, f"r/src/x/{i}.rs") for i in range(4)] + [(9, "r/src/y/1.rs"), (10, "r/src/lib.rs")]
    manifests = spark.createDataFrame([("r/Cargo.toml", '[package]\nname = "box"\n[dependencies]\nname = "no"')], "path string, content string")
    meta = {r.unit_id: r for r in M.unit_meta(spark.createDataFrame(files, "unit_id long, path string"), manifests, ("src",)).collect()}
    assert {meta[i].module_name for i in range(4)} == {"x"} and meta[9].module_name == "y" and meta[10].module_name is None
    assert meta[0].module_root == "r/src/x" and meta[0].package_name == "box" and meta[0].package_root == "r" and meta[0].project_name == "src"
    nested = spark.createDataFrame([("r/package.json", '{"name": "@a/b"}'), ("r/k/package.json", "{}")], "path string, content string")
    files = spark.createDataFrame([(0, "r/a.ts"), (1, "r/k/b.ts"), (2, "s/c.ts")], "unit_id long, path string")
    got = {r.unit_id: (r.package_name, r.package_index) for r in M.unit_meta(files, nested, ()).collect()}
    assert got == {0: ("a_b", 0), 1: ("k", 1), 2: (None, 0)}
    alone = M.unit_meta(files, nested.limit(0), ()).orderBy("unit_id").collect()
    assert [r.package_name for r in alone] == [None] * 3
