"""The relation table: inverses, lookups, statistics, maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kinds import INVERSE, RELATIONS


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed lookup table, small by construction."""
    return spark.createDataFrame(rows, schema)


def mapped(column: Column, table: dict) -> Column:
    """`table[column]` as a literal map: lookup without a join."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def with_inverses(relation: DataFrame) -> DataFrame:
    """Adds the inverse of every relation that has one; no duplicates."""
    back = relation.where(F.col("relation").isin(*INVERSE)).select(F.col("dst").alias("src"), mapped(F.col("relation"), INVERSE).alias("relation"), F.col("src").alias("dst"))
    return relation.select("src", "relation", "dst").unionAll(back).distinct()


def related(relation: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """`sources(src)` expanded over one relation: (src, dst)."""
    return relation.where(F.col("relation") == kind).join(sources.select("src").distinct(), "src", "left_semi").select("src", "dst")


def hop(relation: DataFrame, kind: str, src: str = "src", dst: str = "dst") -> DataFrame:
    return relation.where(F.col("relation") == kind).select(F.col("src").alias(src), F.col("dst").alias(dst))


def reverse_related(relation: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """Who points at `targets(dst)`: (dst, src)."""
    return relation.where(F.col("relation") == kind).join(targets.select("dst").distinct(), "dst", "left_semi").select("dst", "src")


def relations_from(relation: DataFrame) -> DataFrame:
    """(src, relation, ordinal, dsts sorted): all that leaves a block, by relation in fixed order."""
    place = mapped(F.col("relation"), {r: i for i, r in enumerate(RELATIONS)}).cast("long")
    return relation.groupBy("src", "relation").agg(F.sort_array(F.collect_set("dst")).alias("dsts")).withColumn("ordinal", place)


def related_blocks(relation: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct (src, dst) over several relations."""
    return relation.where(F.col("relation").isin(*kinds)).select("src", "dst").distinct()


def linked_blocks(relation: DataFrame) -> DataFrame:
    """Blocks that have relations of their own."""
    return relation.select(F.col("src").alias("block_id")).distinct()


def stats(relation: DataFrame) -> DataFrame:
    """Per relation and, with relation null, in all: n relations, n source blocks. One shuffle of (source, relation) sums, no rows multiplied."""
    per = relation.groupBy("src", "relation").agg(F.count(F.lit(1)).alias("n"))
    each = per.groupBy("relation").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"))
    total = per.groupBy("src").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"))
    total = total.select(F.lit(None).cast("string").alias("relation"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "sources")
    return each.unionByName(total)


def add(relation: DataFrame, new: DataFrame) -> DataFrame:
    return relation.select("src", "relation", "dst").unionAll(with_inverses(new)).distinct()


def remove(relation: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the given facts and their inverses."""
    return relation.join(with_inverses(gone), ["src", "relation", "dst"], "left_anti")


def remove_kind(relation: DataFrame, src: int, kind: str) -> DataFrame:
    """One block's facts of one kind, and their inverses."""
    mine = (F.col("src") == src) & (F.col("relation") == kind)
    back = (F.col("dst") == src) & (F.col("relation") == INVERSE[kind]) if kind in INVERSE else F.lit(False)
    return relation.where(~(mine | back))


def remove_blocks(relation: DataFrame, blocks: DataFrame) -> DataFrame:
    """Without facts that touch `blocks(block_id)`."""
    ids = blocks.select("block_id").distinct()
    return relation.join(ids, relation["src"] == ids["block_id"], "left_anti").join(ids, F.col("dst") == ids["block_id"], "left_anti")


def replace_units(old: DataFrame, new: DataFrame, key: str = "unit_id") -> DataFrame:
    """Upsert by unit: rows of units that `new` has give way to its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
