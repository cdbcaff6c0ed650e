"""The visible graph: nodes, and edges by eleven rules with suppression inside each collecting block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kinds import EDGE_KINDS
from .graph import Graph
from .relations import mapped


#: relations that edges are made of
READ = ("calls", "has_parameters", "has_return", "type_of", "has_impl", "implements", "extends", "uses", "has_field")


def _edge(pairs: DataFrame, collector: str, start: str, end: str, kind: str) -> DataFrame:
    return pairs.select(F.col(collector).alias("collector"), F.col(start).alias("from_id"), F.col(end).alias("to_id"), F.lit(kind).alias("kind")).where("from_id <> to_id")


def field_edges(graph: Graph) -> DataFrame:
    """field, nested_field and type_arg edges; a field edge stands if the last event of its pair is not a removal."""
    graph = graph.store(*READ)
    ids = graph.visible().select("block_id")
    shown = lambda df, c: df.join(ids.withColumnRenamed("block_id", c), c, "left_semi")
    types = shown(shown(graph.field_types(), "owner"), "type_id")
    inserts = types.select("owner", "type_id", (F.col("field_id") * 2).alias("at"), F.lit(False).alias("removal"))
    owned = shown(graph.hop("has_field").select(F.col("src").alias("owner"), F.col("dst").alias("field_id")), "owner")
    args = owned.join(graph.field_args(), "field_id").where("type_id <> owner")
    args = shown(args, "type_id").join(graph.nominal().select(F.col("block_id").alias("type_id")), "type_id", "left_semi")
    removals = args.where("includes_type").select("owner", "type_id", (F.col("field_id") * 2 + 1).alias("at"), F.lit(True).alias("removal"))
    last = inserts.unionAll(removals).groupBy("owner", "type_id").agg(F.max_by("removal", "at").alias("removal"))
    spread = args.select("owner", "type_id", "includes_type", F.explode("arg_ids").alias("arg")).where("arg <> owner")
    spread = shown(spread, "arg")
    nested = spread.where("includes_type").join(graph.nominal().select(F.col("block_id").alias("arg")), "arg", "left_semi")
    generic = spread.where("not includes_type and arg <> type_id")
    return (
        _edge(last.where("not removal"), "owner", "type_id", "owner", "field")
        .unionAll(_edge(nested, "owner", "arg", "owner", "nested_field")).unionAll(_edge(generic, "owner", "arg", "type_id", "type_arg"))
    )


def _without_suppressed(edges: DataFrame) -> DataFrame:
    """A type dependency goes if its collector's own edges join the pair either way, an implementation argument if they, or a type dependency that stays, join it
    that way; annotations neither go nor count. One window over a collector's edges of an unordered pair."""
    pair = Window.partitionBy("collector", F.least("from_id", "to_id"), F.greatest("from_id", "to_id"))
    ahead, kind = F.col("from_id") < F.col("to_id"), F.col("kind")
    own, dep = ~kind.isin("type_dep", "impl_arg", "annotation"), kind == "type_dep"
    some = lambda c: F.max(c).over(pair)
    rows = edges.withColumns({"_own": some(own), "_a": some(own & ahead), "_b": some(own & ~ahead), "_c": some(dep & ahead), "_d": some(dep & ~ahead)})
    that_way = F.when(ahead, F.col("_a") | (F.col("_c") & ~F.col("_own"))).otherwise(F.col("_b") | (F.col("_d") & ~F.col("_own")))
    return rows.where(~(dep & F.col("_own")) & ~((kind == "impl_arg") & that_way)).select("collector", "from_id", "to_id", "kind")


def collected_edges(graph: Graph) -> DataFrame:
    """(collector, from_id, to_id, kind) of every visible block, before the collectors' sets are united."""
    graph = graph.store(*READ)
    ids = graph.visible().select("block_id")
    forward = lambda pairs, kind: _edge(pairs, "src", "src", "dst", kind)
    backward = lambda pairs, kind: _edge(pairs, "src", "dst", "src", kind)
    found = (
        forward(graph.callees(), "call").unionAll(backward(graph.param_types(), "param")).unionAll(forward(graph.return_types(), "return"))
        .unionAll(backward(graph.contracts(), "conformance")).unionAll(backward(graph.bases(), "specialization"))
        .unionAll(forward(graph.type_deps(), "type_dep")).unionAll(backward(graph.impl_args(), "impl_arg")).unionAll(backward(graph.annotations(), "annotation"))
    )
    # both ends visible; the collector is one of them
    found = found.distinct().join(ids.withColumnRenamed("block_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("block_id", "to_id"), "to_id", "left_semi")
    return _without_suppressed(found.select("collector", "from_id", "to_id", "kind").unionAll(field_edges(graph).distinct()))


def edges(graph: Graph) -> DataFrame:
    """(from_id, to_id, kind), each once."""
    return collected_edges(graph).select("from_id", "to_id", "kind").distinct()


def nodes(graph: Graph) -> DataFrame:
    """Visible blocks in source order columns: block_id, name, unit_id, source_line, symbol_kind, kind."""
    return graph.visible().select("block_id", "name", "unit_id", F.col("start_line").alias("source_line"), "symbol_kind", "kind")


def oriented(edge: DataFrame) -> DataFrame:
    """Adds dep_from, dep_to (dependency direction), from_role and to_role."""
    back = mapped(F.col("kind"), {k: v[0] for k, v in EDGE_KINDS.items()})
    return (
        edge.withColumn("dep_from", F.when(back, F.col("to_id")).otherwise(F.col("from_id"))).withColumn("dep_to", F.when(back, F.col("from_id")).otherwise(F.col("to_id")))
        .withColumn("from_role", mapped(F.col("kind"), {k: v[1] for k, v in EDGE_KINDS.items()})).withColumn("to_role", mapped(F.col("kind"), {k: v[2] for k, v in EDGE_KINDS.items()}))
    )


def retain(node: DataFrame, edge: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of `keep(block_id)` and the edges between them."""
    ids = keep.select("block_id").distinct()
    kept = edge.join(ids.withColumnRenamed("block_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("block_id", "to_id"), "to_id", "left_semi")
    return node.join(ids, "block_id", "left_semi"), kept.select(*edge.columns)


def without_orphans(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    ends = edge.select(F.col("from_id").alias("block_id")).unionAll(edge.select(F.col("to_id").alias("block_id"))).distinct()
    return node.join(ends, "block_id", "left_semi")

