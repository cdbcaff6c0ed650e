"""Component roll-up: nodes to project, package or module components, edges to weighted dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem, parent_dir, sanitize_id
from ..kinds import ViewDepth
from .collect import oriented


def classified(node: DataFrame, unit_meta: DataFrame, depth: int) -> DataFrame:
    """Nodes with component_id, label, component_kind, package, module, folder; joins the units' metadata once."""
    meta = unit_meta.select("unit_id", "package_name", "package_root", "module_name", "module_root", "file_path")
    node = node.join(meta, "unit_id", "left")
    package = F.coalesce("package_name", F.lit("unknown"))
    if depth == ViewDepth.PROJECT:
        none = F.lit(None).cast("string")
        return node.withColumns({"component_id": F.lit("project"), "label": F.lit("project"), "component_kind": F.lit("project"), "package": none, "module": none, "folder": none})
    if depth == ViewDepth.PACKAGE:
        return node.withColumns({"component_id": F.concat(F.lit("package_"), sanitize_id(package)), "label": package, "component_kind": F.lit("package"), "package": package, "module": F.lit(None).cast("string"), "folder": F.col("package_root")})
    if depth != ViewDepth.MODULE:
        raise ValueError("files are shown as a tree, not as components")
    segment = F.coalesce("module_name", file_stem(F.col("file_path")), F.lit("unknown"))
    folder = F.when(F.col("module_name").isNotNull(), F.coalesce("module_root", parent_dir(F.col("file_path")))).otherwise(parent_dir(F.col("file_path")))
    return node.withColumns({
        "component_id": F.concat(F.lit("namespace_"), sanitize_id(package), F.lit("_"), sanitize_id(segment)), "label": F.concat(package, F.lit("::"), segment),
        "component_kind": F.lit("module"), "package": package, "module": segment, "folder": folder,
    })


def components(named: DataFrame) -> DataFrame:
    """One row a component; attributes of its first node in (unit_id, block_id) order, the first known folder."""
    order = F.struct("unit_id", "block_id")
    first = lambda c: F.min_by(c, order).alias(c)
    return named.groupBy("component_id").agg(first("label"), first("component_kind"), first("package"), first("module"), F.min(F.when(F.col("folder").isNotNull(), F.struct("unit_id", "block_id", "folder")))["folder"].alias("folder"), F.count(F.lit(1)).alias("nodes"))


def via(kind: str = "kind", n: str = "n"):
    """'kind:count' in order of kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("kind"), F.col(n).alias("n")))), lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string"))), ",")


def component_edges(named: DataFrame, edge: DataFrame) -> DataFrame:
    """(src, dst, weight, via) in dependency direction; edges inside a component are dropped."""
    ids = named.select("block_id", "component_id")
    far = oriented(edge).join(ids.select(F.col("block_id").alias("dep_from"), F.col("component_id").alias("src")), "dep_from")
    far = far.join(ids.select(F.col("block_id").alias("dep_to"), F.col("component_id").alias("dst")), "dep_to").where("src <> dst")
    per_kind = far.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per_kind.groupBy("src", "dst").agg(F.sum("n").alias("weight"), via().alias("via"))


def level_counts(node: DataFrame, unit_meta: DataFrame) -> DataFrame:
    """Nodes per project, package and module at once (the fixed hierarchy as a rollup)."""
    meta = unit_meta.select("unit_id", "project_name", "package_name", "module_name")
    return node.join(meta, "unit_id", "left").rollup("project_name", "package_name", "module_name").agg(F.count(F.lit(1)).alias("nodes"), F.grouping_id().alias("level"))
