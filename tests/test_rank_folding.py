"""PageRank on blocks that no edge points at, that no edge leaves, and that have none: folded, and as a plain loop over all of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.kinds import INFLUENCE
from loomgraph.operators import rank as K
from loomgraph.operators.graph import Graph

N = 90


@pytest.fixture(scope="module")
def graph(spark):
    """0-19 are heads, 20-49 have edges both ways, 50-79 are sinks, 80-89 have no edge."""
    rng = random.Random(5)
    block = spark.createDataFrame([(i, rng.choice(["class", "func", "field", "root"]), i % 3) for i in range(N)], "block_id long, kind string, unit_id long")
    ends = [(rng.randrange(50), rng.randrange(20, 80)) for _ in range(250)] + [(i, i % 30 + 20) for i in range(50)] + [(i % 50, i) for i in range(20, 80)]
    return Graph(block, spark.createDataFrame([(a, rng.choice(list(INFLUENCE)), z) for a, z in ends], "src long, relation string, dst long"), None)


def plain(graph, options, fixed):
    p = np.array([r.p for r in K.teleport(graph.block, options).orderBy("block_id").collect()])
    edges = [(r.src, r.dst, r.share) for r in K.adjacency(graph, INFLUENCE, options).collect()]
    sink = np.array([i not in {a for a, _, _ in edges} for i in range(N)])
    assert {i for i in range(N) if not sink[i]} & {z for _, z, _ in edges} and len(edges) > 150
    rank, n, done, d = p.copy(), 0, False, options.damping
    while n < (fixed or options.max_iterations) and not done:
        new = ((1 - d) + d * rank[sink].sum()) * p
        for a, z, share in edges:
            new[z] += d * rank[a] * share
        done = fixed is None and np.abs(new - rank).sum() < options.tolerance
        rank, n = new, n + 1
    return rank, n, done


@pytest.mark.parametrize("engine", ["one_task", "joins", "auto"])
@pytest.mark.parametrize("fixed,tolerance,most", [(1, 1e-6, 100), (4, 1e-6, 100), (None, 0.5, 100), (None, 3e-2, 100), (None, 1e-3, 100), (None, 1e-9, 3)])
def test_folded(graph, engine, fixed, tolerance, most):
    options = K.RankOptions(tolerance=tolerance, max_iterations=most, one_task_edges=1)
    rank, n, done = plain(graph, options, fixed)
    got = K.pagerank(graph, INFLUENCE, options, fixed, engine).orderBy("block_id").collect()
    assert [r.block_id for r in got] == list(range(N)) and np.allclose([r["rank"] for r in got], rank, rtol=0, atol=1e-12)
    assert {(r.iterations, r.converged) for r in got} == {(n, done)}


def test_chunks(graph):
    options = K.RankOptions(one_task_edges=1)
    got = K._one_task(K.flow(graph, INFLUENCE, options), options, None, chunk=7).orderBy("block_id").collect()
    assert np.allclose([r["rank"] for r in got], plain(graph, options, None)[0], rtol=0, atol=1e-12)


@pytest.mark.parametrize("engine", ["one_task", "joins"])
def test_rounds_hold_no_heads(graph, engine, monkeypatch):
    """A round reads no block that no edge points at, the joins none that has no edge of its own either."""
    most, settle, arrow = [], K.settle, type(graph.block).mapInArrow

    def settled(df, name, *folders):
        out = settle(df, name, *folders)
        if name == "rank":
            most.append(out.count())
        return out

    monkeypatch.setattr(K, "settle", settled)
    monkeypatch.setattr(type(graph.block), "mapInArrow", lambda df, *a, **k: (most.append(df.where(~F.isnan("p")).count()), arrow(df, *a, **k))[1])
    K.pagerank(graph, INFLUENCE, K.RankOptions(tolerance=1e-2, one_task_edges=1), engine=engine).count()
    assert most and max(most) <= (60 if engine == "one_task" else 30)
