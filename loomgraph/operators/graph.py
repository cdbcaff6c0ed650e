"""Graph queries over `block` and `relation`; every method returns a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kinds import KIND_SETS, NOMINAL, VISIBLE
from ..session import settle
from . import relations as R


@dataclass
class Graph:
    """block(block_id, unit_id, kind, name, ...), relation(src, relation, dst), unit_meta (optional)."""

    block: DataFrame
    relation: DataFrame
    unit_meta: DataFrame | None = None
    stored: bool = False

    def store(self, *kinds: str) -> Graph:
        """Written once and read many times; relations (of `kinds`, if any are named) lie in a folder each, so a hop reads its own only."""
        if self.stored:
            return self
        relation = self.relation.where(F.col("relation").isin(*kinds)) if kinds else self.relation
        return Graph(settle(self.block, "block"), settle(relation, "relation", "relation"), self.unit_meta, True)

    # filters and lookups

    def blocks(self, *kinds: str) -> DataFrame:
        return self.block.where(F.col("kind").isin(*kinds)) if kinds else self.block

    def by_name(self, name: str) -> DataFrame:
        return self.block.where(F.col("name") == name)

    def by_unit(self, unit_id: int, *kinds: str) -> DataFrame:
        return self.blocks(*kinds).where(F.col("unit_id") == unit_id)

    def block_info(self, block_id: int) -> DataFrame:
        return self.block.where(F.col("block_id") == block_id)

    def contains_block(self, block_id: int) -> bool:
        return not self.block_info(block_id).isEmpty()

    def counts(self) -> DataFrame:
        return self.block.agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("name").alias("names"), F.countDistinct("unit_id").alias("units"))

    def symbol_of(self, block_id: int) -> DataFrame:
        shown = [c for c in ("symbol_id", "symbol_kind", "name") if c in self.block.columns]
        return self.block_info(block_id).select(*shown).limit(1)

    def visible(self) -> DataFrame:
        return self.blocks(*VISIBLE)

    def nominal(self) -> DataFrame:
        return self.blocks(*NOMINAL)

    # one hop

    def hop(self, kind: str) -> DataFrame:
        return R.hop(self.relation, kind)

    def matching(self, kind: str, keep: Column) -> DataFrame:
        """Targets of a relation for which `keep`, over the target's block columns, holds."""
        return self.hop(kind).join(self.block.where(keep).select(F.col("block_id").alias("dst")), "dst", "left_semi").select("src", "dst")

    def of_kind(self, kind: str, *block_kinds: str) -> DataFrame:
        return self.matching(kind, F.col("kind").isin(*block_kinds))

    def has_related(self, kind: str) -> DataFrame:
        """(src) of blocks with at least one such relation."""
        return self.hop(kind).select("src").distinct()

    def contains(self, src: int, kind: str, dst: int) -> bool:
        return not self.hop(kind).where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def callees(self) -> DataFrame:
        return self.hop("calls")

    def bases(self) -> DataFrame:
        return self.hop("extends")

    def annotations(self) -> DataFrame:
        return self._from_nominal(self.of_kind("uses", "func"))

    def type_deps(self) -> DataFrame:
        """Uses of classes and enums. Traits never show: a use is always stored with its inverse, which rules them out."""
        return self.of_kind("uses", *NOMINAL)

    def impl_args(self) -> DataFrame:
        deps = self.nominal().select(F.col("block_id").alias("src"), F.explode("type_deps").alias("dst")).distinct()
        return deps.join(self.nominal().select(F.col("block_id").alias("dst")), "dst", "left_semi").select("src", "dst")

    def _from_nominal(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.nominal().select(F.col("block_id").alias("src")), "src", "left_semi").select("src", "dst")

    # two hops

    def _through(self, first: str, second: str) -> DataFrame:
        return R.hop(self.relation, first, "src", "mid").join(R.hop(self.relation, second, "mid", "dst"), "mid").select("src", "dst")

    def param_types(self) -> DataFrame:
        return self._through("has_parameters", "type_of")

    def return_types(self) -> DataFrame:
        return self._through("has_return", "type_of")

    def contracts(self) -> DataFrame:
        """A bag: what its implementations conform to, and what it conforms to itself."""
        return self._through("has_impl", "implements").unionAll(self.hop("implements"))

    def try_block(self, block_id: int):
        """The block's row, or None."""
        return self.block_info(block_id).first()

    def try_field(self, owner: int, name: str):
        """The owner's first field of that name, or None."""
        mine = self.hop("has_field").where(F.col("src") == owner).select(F.col("dst").alias("block_id"))
        return self.block.join(mine, "block_id", "left_semi").where(F.col("name") == name).orderBy("block_id").first()

    def actual_types(self, symbol: DataFrame, *keep: str) -> DataFrame:
        """(block_id, type_symbol_id, type_block_id) and the block's columns `keep`: what a block's type stands for, over one alias link; types without a block go."""
        actual = F.when(F.col("kind").isin(*KIND_SETS["alias_link"]), F.coalesce("type_of", "symbol_id")).otherwise(F.col("symbol_id"))
        step = symbol.select("symbol_id", actual.alias("type_symbol_id"))
        owner = symbol.where("block_id is not null").select(F.col("symbol_id").alias("type_symbol_id"), F.col("block_id").alias("type_block_id"))
        typed = self.block.where("type_symbol_id is not null").select("block_id", *keep, F.col("type_symbol_id").alias("symbol_id"))
        return typed.join(step, "symbol_id").join(owner, "type_symbol_id").select("block_id", "type_symbol_id", "type_block_id", *keep)

    def nested_type_blocks(self, symbol: DataFrame) -> DataFrame:
        """(block_id, place, type_block_id): a block's type arguments in order; those without a block go."""
        owner = symbol.where("block_id is not null").select("symbol_id", F.col("block_id").alias("type_block_id"))
        return self.block.select("block_id", F.posexplode("nested_types").alias("place", "symbol_id")).join(owner, "symbol_id").select("block_id", "place", "type_block_id")

    # closures

    def field_types(self, max_depth: int = 64) -> DataFrame:
        """(owner, field_id, type_id): types of each owned field and of the fields nested in it, cycles cut by the visited set."""
        inner = R.hop(self.relation, "has_field", "at", "inner")
        seen = settle(R.hop(self.relation, "has_field", "owner", "field_id").select("owner", "field_id", F.col("field_id").alias("at")).distinct(), "fields")
        front = seen
        for _ in range(max_depth):
            front = front.join(inner, "at").select("owner", "field_id", F.col("inner").alias("at")).distinct().join(seen, ["owner", "field_id", "at"], "left_anti")
            front = settle(front, "fields-front")
            if front.isEmpty():
                break
            seen = settle(seen.unionAll(front), "fields")
        else:
            raise RuntimeError(f"field nesting deeper than {max_depth}")
        return seen.join(R.hop(self.relation, "type_of", "at", "type_id"), "at").select("owner", "field_id", "type_id").distinct()

    def field_args(self) -> DataFrame:
        """(field_id, type_id, arg_ids, includes_type) of fields with a type and arguments."""
        known = F.col("type_ref").isNotNull() & F.col("nested_types").isNotNull()
        return self.blocks("field").where(known).select(F.col("block_id").alias("field_id"), F.col("type_ref").alias("type_id"), F.col("nested_types").alias("arg_ids"), F.array_contains("nested_types", F.col("type_ref")).alias("includes_type"))
