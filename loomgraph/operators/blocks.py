"""From syntax facts to blocks: ids, kinds, ownership, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kinds import MATERIALIZED, NEEDS_SYMBOL, NO_SYMBOL_BLOCK

#: (parent kinds, child kinds) that make a member
MEMBERS = {
    "parameter": ("func", "method"), "return": ("func", "method"), "field": ("class", "interface", "enum", "field"), "method": ("class", "interface", "trait", "impl"),
}


def number(facts: DataFrame) -> DataFrame:
    """Deterministic ids: by unit, start, widest first, kind. Ids are dense inside a unit; the unit is the high part."""
    order = Window.partitionBy("unit_id").orderBy("start_byte", F.desc("end_byte"), "kind", "local_id")
    return facts.withColumn("block_id", F.col("unit_id") * F.lit(1 << 24) + F.row_number().over(order))


def block_kind(facts: DataFrame) -> DataFrame:
    """A field's own kind goes before the node's; an override of the parent goes before both, and may suppress the block."""
    return facts.withColumn("kind", F.coalesce("override_kind", "field_kind", "node_kind", F.lit("undefined")))


def methods(block: DataFrame) -> DataFrame:
    """A func is a method if its symbol is one or its parent is an impl."""
    parent = block.select(F.col("block_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    is_method = (F.col("kind") == "func") & ((F.col("symbol_kind") == "method") | (F.col("parent_kind") == "impl"))
    return block.join(parent, "parent_id", "left").withColumn("kind", F.when(is_method, F.lit("method")).otherwise(F.col("kind"))).select(*block.columns)


def materialized(block: DataFrame, rounds: int = 64) -> DataFrame:
    """Blocks that exist: kinds with a block, functions only with a symbol; children of dropped blocks hang on the next one above."""
    keep = F.col("kind").isin(*MATERIALIZED) & (~F.col("kind").isin(*NEEDS_SYMBOL) | F.col("symbol_id").isNotNull())
    gone = block.where(~keep).select(F.col("block_id").alias("gone"), F.col("parent_id").alias("above"))
    out = block.where(keep)
    for _ in range(rounds):
        if out.join(gone, F.col("parent_id") == F.col("gone"), "left_semi").isEmpty():
            return out
        out = out.join(gone, F.col("parent_id") == F.col("gone"), "left").withColumn("parent_id", F.when(F.col("gone").isNotNull(), F.col("above")).otherwise(F.col("parent_id"))).select(*block.columns)
    raise RuntimeError("blocks nested too deep")


def owned_symbols(block: DataFrame, symbol: DataFrame) -> DataFrame:
    """(symbol_id, block_id): the block that a symbol stands for; not for impl and return, unnamed fields, primitives."""
    mine = block.where(~F.col("kind").isin(*NO_SYMBOL_BLOCK) & F.col("symbol_id").isNotNull() & ~((F.col("kind") == "field") & F.coalesce(F.col("name").rlike("^[0-9]+$"), F.lit(True))))
    return mine.join(symbol.where("kind <> 'primitive'").select("symbol_id"), "symbol_id", "left_semi").groupBy("symbol_id").agg(F.min("block_id").alias("block_id"))


def members(block: DataFrame) -> DataFrame:
    """(owner, owner_kind, member, member_kind): children that belong to their parent by kind; a column parent_kind spares the join."""
    known = "parent_kind" in block.columns
    down = block.select(F.col("block_id").alias("member"), F.col("kind").alias("member_kind"), F.col("parent_id").alias("owner"), *([F.col("parent_kind").alias("owner_kind")] if known else []))
    fits = F.lit(False)
    for child, parents in MEMBERS.items():
        fits = fits | ((F.col("member_kind") == child) & F.col("owner_kind").isin(*parents))
    if not known:
        down = down.join(block.select(F.col("block_id").alias("owner"), F.col("kind").alias("owner_kind")), "owner")
    return down.where(fits).select("owner", "owner_kind", "member", "member_kind")


def positional_names(block: DataFrame) -> DataFrame:
    """Unnamed fields of one parent are called 0, 1, ... in order."""
    bare = (F.col("kind") == "field") & F.col("name").isNull()
    place = F.row_number().over(Window.partitionBy("parent_id", bare).orderBy("ordinal", "block_id")) - 1
    return block.withColumn("name", F.when(bare, place.cast("string")).otherwise(F.col("name")))


def inline_modules(block: DataFrame) -> DataFrame:
    """(block_id, is_inline) of modules: inline if anything is inside."""
    inside = block.select(F.col("parent_id").alias("block_id")).distinct().withColumn("is_inline", F.lit(True))
    return block.where("kind = 'module'").select("block_id").join(inside, "block_id", "left").select("block_id", F.coalesce("is_inline", F.lit(False)).alias("is_inline"))
