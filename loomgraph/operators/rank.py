"""Weighted two-direction PageRank and the coverage-aware selection of its best nodes."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import module_key
from ..kinds import INFLUENCE, KIND_PRIOR, ORCHESTRATION
from ..session import settle
from .graph import Graph
from .relations import mapped


@dataclass(frozen=True)
class RankOptions:
    damping: float = 0.85
    tolerance: float = 1e-6
    max_iterations: int = 100
    influence_weight: float = 0.25
    orchestration_weight: float = 0.75
    prior_strength: float = 0.12
    cross_file_penalty: float = 0.8
    max_degree: int | None = 150
    influence: dict = field(default_factory=lambda: dict(INFLUENCE))
    orchestration: dict = field(default_factory=lambda: dict(ORCHESTRATION))
    priors: dict = field(default_factory=lambda: dict(KIND_PRIOR))
    one_task_edges: int = 5_000_000  # up to here one task with arrays beats joins

    def __post_init__(self):
        finite = lambda x: isinstance(x, (int, float)) and np.isfinite(x)
        if not (finite(self.damping) and 0 < self.damping < 1):
            raise ValueError("damping must lie between 0 and 1, both excluded")
        for name in ("prior_strength", "cross_file_penalty"):
            if not (finite(getattr(self, name)) and 0 <= getattr(self, name) <= 1):
                raise ValueError(f"{name} must lie in [0, 1]")
        if not (finite(self.tolerance) and self.tolerance > 0):
            raise ValueError("tolerance must be positive")
        if self.max_iterations < 1 or self.max_degree is not None and self.max_degree < 1:
            raise ValueError("max_iterations and max_degree must be positive")
        both = (self.influence_weight, self.orchestration_weight)
        if not all(finite(x) and x >= 0 for x in both) or sum(both) <= 0:
            raise ValueError("score weights must not be negative, nor both zero")
        if any(not finite(x) or x < 0 for d in (self.influence, self.orchestration, self.priors) for x in d.values()):
            raise ValueError("weights and priors must not be negative")


def teleport(block: DataFrame, options: RankOptions = RankOptions()) -> DataFrame:
    """(block_id, p): uniform, blended with the kinds' priors; sums to 1."""
    prior = F.coalesce(mapped(F.col("kind"), options.priors), F.lit(0.0))
    base = block.select("block_id", prior.alias("prior"))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.sum("prior").alias("total"))
    s = options.prior_strength
    share = F.when(F.col("total") <= 2.220446049250313e-16, 1 / F.col("n")).otherwise(F.try_divide(F.col("prior"), F.col("total")))
    return base.join(F.broadcast(total)).select("block_id", ((1 - s) / F.col("n") + s * share).alias("p"))  # one row


def adjacency(graph: Graph, weights: dict, options: RankOptions = RankOptions()) -> DataFrame:
    """(src, dst, w, share): parallel relations summed, the heaviest `max_degree` kept, shares over what is kept."""
    positive = {k: w for k, w in weights.items() if w > 0}
    rel = graph.relation.where(F.col("relation").isin(*positive) & (F.col("src") != F.col("dst"))).distinct()
    path = graph.block.select("block_id", "unit_id")
    if graph.unit_meta is not None:
        path = path.join(graph.unit_meta.select("unit_id", "file_path"), "unit_id", "left")
    else:
        path = path.withColumn("file_path", F.col("unit_id").cast("string"))
    path = path.select("block_id", "file_path")
    rel = rel.join(path.select(F.col("block_id").alias("dst"), F.col("file_path").alias("b")), "dst")
    rel = rel.join(path.select(F.col("block_id").alias("src"), F.col("file_path").alias("a")), "src")  # last: what follows stays dealt by src
    w = mapped(F.col("relation"), positive)
    w = F.when(F.col("a") != F.col("b"), w * options.cross_file_penalty).otherwise(w) if options.cross_file_penalty < 1 else w
    merged = rel.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w > 0")
    if options.max_degree is not None:
        order = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
        merged = merged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= options.max_degree).drop("_n")
    return merged.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


@dataclass(frozen=True)
class Flow:
    """What both engines iterate over. A block that no edge points at (a head) has c * p as its rank in every round, the
    same c for all; heads and their edges may be folded into `q`, what a block gets from them at c = 1, and two sums."""

    nodes: DataFrame  # (block_id, p, q, feeds), without the folded heads; feeds: has an edge of its own
    edges: DataFrame  # (src, dst, share) between them
    heads: DataFrame | None  # (block_id, p)
    head_mass: float  # sum of p over the folded heads
    idle_mass: float  # the same over those of them that have no edge either
    size: int  # nodes and edges before folding


def flow(graph: Graph, weights: dict, options: RankOptions = RankOptions(), engine: str = "auto") -> Flow:
    """Folded for the joins and above `one_task_edges`; what is smaller goes to one task as it is."""
    start, edges = settle(teleport(graph.block, options), "teleport"), settle(adjacency(graph, weights, options).select("src", "dst", "share"), "adjacency")
    size = edges.count() + start.count()
    if engine != "joins" and size <= options.one_task_edges:
        return Flow(start.select("block_id", "p", F.lit(0.0).alias("q")), edges, None, 0.0, 0.0, size)
    fed = edges.select(F.col("dst").alias("block_id")).distinct().withColumn("_in", F.lit(True))
    feeds = edges.select(F.col("src").alias("block_id")).distinct().withColumn("_out", F.lit(True))
    marked = start.join(fed, "block_id", "left").join(feeds, "block_id", "left")
    marked = settle(marked.select("block_id", "p", F.col("_out").isNotNull().alias("feeds"), F.col("_in").isNotNull().alias("fed")), "marked", "fed")
    dealt = edges.join(marked.where("feeds").select(F.col("block_id").alias("src"), "p", "fed"), "src")
    dealt = settle(dealt.select(F.when(F.col("fed"), F.col("src")).alias("src"), "dst", F.when(F.col("fed"), F.col("share")).otherwise(F.col("share") * F.col("p")).alias("share"), "fed"), "dealt", "fed")
    got = dealt.where("not fed").groupBy(F.col("dst").alias("block_id")).agg(F.sum("share").alias("q"))
    nodes = settle(marked.where("fed").join(got, "block_id", "left").select("block_id", "p", F.coalesce("q", F.lit(0.0)).alias("q"), "feeds"), "nodes")
    heads = marked.where("not fed")
    mass = heads.agg(F.coalesce(F.sum("p"), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("feeds"), F.col("p"))), F.lit(0.0))).first()
    return Flow(nodes, dealt.where("fed").select("src", "dst", "share"), heads.select("block_id", "p"), *mass, size)


def _one_task(flow: Flow, options: RankOptions, fixed: int | None, chunk: int = 1 << 22) -> DataFrame:
    """All iterations in one task: arrays of the nodes in memory, edges in a temporary file, read a chunk at a time."""
    d, tolerance, most, head_mass, idle_mass = options.damping, options.tolerance, fixed or options.max_iterations, flow.head_mass, flow.idle_mass
    raw, coded = np.dtype([("a", "<i8"), ("b", "<i8"), ("w", "<f8")]), np.dtype([("a", "<i4"), ("b", "<i4"), ("w", "<f8")])

    def chunks(file, kind):
        file.seek(0)
        while data := file.read(chunk * kind.itemsize):
            yield np.frombuffer(data, kind)

    def run(batches):
        with tempfile.TemporaryFile() as edges:
            ids, ps, qs = [], [], []
            with tempfile.TemporaryFile() as given:
                for batch in batches:
                    p = batch.column("p").to_numpy(zero_copy_only=False)
                    node = ~np.isnan(p)
                    a, z, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "w"))
                    ids.append(a[node]), ps.append(p[node]), qs.append(w[node])
                    rows = np.empty(len(a) - len(ids[-1]), raw)
                    rows["a"], rows["b"], rows["w"] = a[~node], z[~node], w[~node]
                    given.write(rows.tobytes())
                ids, ps, qs = (np.concatenate(x) if x else np.zeros(0) for x in (ids, ps, qs))
                order = np.argsort(ids)
                ids, ps, qs = ids[order], ps[order], qs[order]
                sink = np.ones(len(ids), bool)
                for rows in chunks(given, raw):
                    out = np.empty(len(rows), coded)
                    out["a"], out["b"], out["w"] = np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"]), rows["w"]
                    sink[out["a"]] = False
                    edges.write(out[np.lexsort((out["a"], out["b"]))].tobytes())
            rank, c, n, done = ps.copy(), 1.0, 0, False
            while n < most and not done:
                got = c * qs
                for rows in chunks(edges, coded):
                    got += np.bincount(rows["b"], rank[rows["a"]] * rows["w"], len(ids))
                next_c = (1 - d) + d * (rank[sink].sum() + c * idle_mass)
                new = next_c * ps + d * got
                done = fixed is None and np.abs(new - rank).sum() + abs(next_c - c) * head_mass < tolerance
                rank, c, n = new, next_c, n + 1
        # the row without a block carries the heads' factor
        ids, rank = pa.array(np.append(ids, 0).astype(np.int64), mask=np.append(np.zeros(len(ids), bool), True)), np.append(rank, c)
        whole = pa.RecordBatch.from_arrays([ids, pa.array(rank), pa.array(np.full(len(rank), n, np.int64)), pa.array(np.full(len(rank), bool(done)))], names=["block_id", "rank", "iterations", "converged"])
        for at in range(0, len(rank), 1 << 18):
            yield whole.slice(at, 1 << 18)

    nan = F.lit(float("nan"))
    rows = flow.nodes.select(F.col("block_id").alias("a"), F.col("block_id").alias("b"), F.col("q").alias("w"), "p").unionAll(flow.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("share").alias("w"), nan.alias("p")))
    ranks = rows.coalesce(1).mapInArrow(run, "block_id long, rank double, iterations long, converged boolean")
    if flow.heads is None:
        return ranks.where("block_id is not null")
    ranks = settle(ranks, "ranks")
    end = ranks.where("block_id is null").select(F.col("rank").alias("c"), "iterations", "converged")
    return ranks.where("block_id is not null").unionAll(flow.heads.join(F.broadcast(end)).select("block_id", F.col("p") * F.col("c"), "iterations", "converged"))  # one row


def _sums(df: DataFrame, *columns) -> tuple:
    return tuple(df.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in columns)).first())


def _joins(flow: Flow, options: RankOptions, fixed: int | None) -> DataFrame:
    """Power iteration as joins and aggregates, any size; lineage is cut every round.

    Blocks without an edge of their own (sinks) pass on the sum of their ranks only, which follows from the others. Their
    own ranks are taken once, from the last round; what they moved by is bounded, and taken where the bounds leave it open.
    """
    d, nodes = options.damping, flow.nodes
    inner = flow.edges.join(nodes.select(F.col("block_id").alias("dst"), "feeds"), "dst").select("src", "dst", "share", "feeds")
    inner = settle(inner, "inner", "feeds")
    inner, outer = inner.where("feeds").select("src", "dst", "share"), inner.where("not feeds").select("src", "dst", "share")
    sinks = nodes.where("not feeds").select("block_id", "p", "q")
    sink_p, sink_q = _sums(sinks, F.col("p"), F.col("q"))
    kept = inner.groupBy(F.col("src").alias("block_id")).agg(F.sum("share").alias("kept"))
    given = F.greatest(1 - F.coalesce("kept", F.lit(0.0)), F.lit(0.0)).alias("given")  # the share that goes to sinks; all shares of a block sum to 1
    state = settle(nodes.where("feeds").join(kept, "block_id", "left").select("block_id", "p", "q", given, F.col("p").alias("rank"), F.lit(0.0).alias("old")), "rank")

    def to_sinks(value):  # what they get of the others' `value`
        got = outer.join(state.select(F.col("block_id").alias("src"), value.alias("_v")), "src").groupBy(F.col("dst").alias("block_id")).agg(F.sum(F.col("_v") * F.col("share")).alias("got"))
        return sinks.join(got, "block_id", "left").select("block_id", "p", "q", F.coalesce("got", F.lit(0.0)).alias("got"))

    now, old, move = F.col("rank"), F.col("old"), F.col("rank") - F.col("old")
    given_now, given_move, _ = _sums(state, F.col("given") * now, F.col("given") * F.abs(move), F.abs(move))
    c, old_c, sunk, n, done = 1.0, 0.0, sink_p, 0, False
    while n < (fixed or options.max_iterations) and not done:
        next_c = (1 - d) + d * (sunk + c * flow.idle_mass)
        next_sunk = next_c * sink_p + d * (given_now + c * sink_q)
        got = inner.join(state.select(F.col("block_id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("block_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = state.join(got, "block_id", "left").select("block_id", "p", "q", "given", (next_c * F.col("p") + d * (F.coalesce("got", F.lit(0.0)) + c * F.col("q"))).alias("rank"), now.alias("old"))
        new = settle(new, "rank")
        next_given, next_move, moved = _sums(new, F.col("given") * now, F.col("given") * F.abs(move), F.abs(move))
        if fixed is None:
            moved += abs(next_c - c) * flow.head_mass
            if moved + abs(next_sunk - sunk) < options.tolerance:  # the sinks move by this much at least
                done = moved + abs(next_c - c) * sink_p + d * (given_move + abs(c - old_c) * sink_q) < options.tolerance  # and by this at most
                if not done:
                    done = moved + _sums(to_sinks(move), F.abs((next_c - c) * F.col("p") + d * (F.col("got") + (c - old_c) * F.col("q"))))[0] < options.tolerance
        state, given_now, given_move, sunk, old_c, c, n = new, next_given, next_move, next_sunk, c, next_c, n + 1
    rank = state.select("block_id", "rank").unionAll(to_sinks(old).select("block_id", c * F.col("p") + d * (F.col("got") + old_c * F.col("q"))))
    rank = rank.unionAll(flow.heads.select("block_id", c * F.col("p")))
    return rank.select("block_id", "rank", F.lit(n).cast("long").alias("iterations"), F.lit(bool(done)).alias("converged"))


def pagerank(graph: Graph, weights: dict, options: RankOptions = RankOptions(), iterations: int | None = None, engine: str = "auto", ready: Flow | None = None) -> DataFrame:
    """(block_id, rank, iterations, converged); `iterations` fixes their number, else they run to the tolerance; `ready`: a folded flow to run on."""
    ready = ready or flow(graph, weights, options, engine)
    if engine == "auto":
        engine = "one_task" if ready.size <= options.one_task_edges else "joins"
    return (_one_task if engine == "one_task" else _joins)(ready, options, iterations)


def blend(influence: DataFrame, orchestration: DataFrame, options: RankOptions = RankOptions()) -> DataFrame:
    total = options.influence_weight + options.orchestration_weight
    a, b = options.influence_weight / total, options.orchestration_weight / total
    i = influence.select("block_id", F.col("rank").alias("influence"), F.col("iterations").alias("_i"), F.col("converged").alias("_a"))
    o = orchestration.select("block_id", F.col("rank").alias("orchestration"), F.col("iterations").alias("_o"), F.col("converged").alias("_b"))
    score = F.col("influence") * a + F.col("orchestration") * b
    return i.join(o, "block_id").select("block_id", "influence", "orchestration", score.alias("score"), F.greatest("_i", "_o").alias("iterations"), (F.col("_a") & F.col("_b")).alias("converged"))


def scores(graph: Graph, options: RankOptions = RankOptions(), iterations: int | None = None, engine: str = "auto") -> DataFrame:
    """(block_id, influence, orchestration, score, iterations, converged)."""
    return blend(pagerank(graph, options.influence, options, iterations, engine), pagerank(graph, options.orchestration, options, iterations, engine), options)


def ranked(graph: Graph, scored: DataFrame, metric: str = "score") -> DataFrame:
    """Adds unit_id and rank from 1 by a metric, ties by unit and block."""
    if metric not in ("score", "influence", "orchestration"):
        raise ValueError(f"unknown metric {metric}")
    order = Window.orderBy(F.desc(metric), "unit_id", "block_id")
    return scored.join(graph.block.select("block_id", "unit_id", "kind", "name"), "block_id").withColumn("rank", F.row_number().over(order).cast("long"))


def top(graph: Graph, scored: DataFrame, k: int, metric: str = "score") -> DataFrame:
    """The k best; a top-k plan, no global window."""
    return scored.join(graph.block.select("block_id", "unit_id", "kind", "name"), "block_id").orderBy(F.desc(metric), "unit_id", "block_id").limit(k)


def top_with_coverage(rows: DataFrame, k: int) -> DataFrame:
    """`rows(block_id, unit_id, score, module)` -> (block_id): modules are covered first, then the best of the rest.

    Two fifths of k (at least one) go to modules by their summed score, at most max(1, min(5, k / 120)) each; the rest
    by score. With no more rows than k all are kept; k = 0 keeps one.
    """
    budget, per = max(1, 2 * k // 5), min(5, max(1, k // 120))
    n = rows.count()
    if n <= k:
        return rows.select("block_id")
    by_score = [F.desc("score"), F.col("unit_id"), F.col("block_id")]
    modules = rows.groupBy("module").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "module").limit(budget)  # each module gives at least one
    modules = modules.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "module")))
    inside = rows.join(modules, "module").withColumn("n", F.row_number().over(Window.partitionBy("module").orderBy(*by_score))).where(F.col("n") <= per)
    covered = settle(inside.orderBy("place", "n").limit(budget).select("block_id"), "covered")
    have = covered.count()
    fill = rows.join(covered, "block_id", "left_anti").orderBy(*by_score).limit(max(0, k - have)).select("block_id")
    return covered.unionAll(fill)


def modules_of(node: DataFrame, unit_meta: DataFrame) -> DataFrame:
    meta = unit_meta.select("unit_id", "package_name", "module_name")
    return node.join(meta, "unit_id", "left").withColumn("module", module_key(F.col("package_name"), F.col("module_name"))).drop("package_name", "module_name")
