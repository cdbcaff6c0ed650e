"""Relations from blocks and symbols: one rule a function, united once, inverses added once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kinds import KIND_SETS
from .blocks import members
from .relations import hop, union_all, with_inverses
from .resolve import chase


class Linker:
    """block, symbol (both as in `schema`), calls(call_id, enclosing_id, symbol_id), scope_symbol, impls(block_id, target_symbol, contract_symbol)."""

    def __init__(self, block: DataFrame, symbol: DataFrame, calls: DataFrame, scope_symbol: DataFrame, impls: DataFrame | None = None):
        self.block, self.symbol, self.calls, self.scope_symbol, self.impls = block, symbol, calls, scope_symbol, impls
        self.chased = chase(symbol)
        self.owner = symbol.where("block_id is not null").select("symbol_id", F.col("block_id").alias("at"), F.col("kind").alias("at_kind"))
        self.member = members(block)

    def _facts(self, df: DataFrame, kind: str, src: str = "src", dst: str = "dst") -> DataFrame:
        return df.select(F.col(src).alias("src"), F.lit(kind).alias("relation"), F.col(dst).alias("dst")).where("src is not null and dst is not null")

    def _to_block(self, df: DataFrame, symbol_col: str, follow: bool = True) -> DataFrame:
        """Adds dst (block of the symbol, through alias links) and dst_kind (symbol kind)."""
        if follow:
            df = df.join(self.chased.select(F.col("symbol_id").alias(symbol_col), F.col("target_id").alias("_t")), symbol_col)
        else:
            df = df.withColumn("_t", F.col(symbol_col))
        return df.join(self.owner.select(F.col("symbol_id").alias("_t"), F.col("at").alias("dst"), F.col("at_kind").alias("dst_kind")), "_t").drop("_t")

    def _symbols_of(self, *kinds: str) -> DataFrame:
        own = self.symbol.select("symbol_id", "type_of", "nested_types", "decorators", "owned_scope_id")
        rows = self.block.where(F.col("kind").isin(*kinds)).select(F.col("block_id").alias("src"), "kind", "symbol_id", *(c for c in ("type_of_block",) if c in self.block.columns))
        return rows.join(own, "symbol_id")

    def containment(self) -> DataFrame:
        return self._facts(self.block, "contains", "parent_id", "block_id")

    def signatures(self) -> DataFrame:
        part = lambda kind, rel: self._facts(self.member.where(F.col("member_kind") == kind), rel, "owner", "member")
        return part("parameter", "has_parameters").unionAll(part("return", "has_return"))

    def member_facts(self) -> DataFrame:
        part = lambda kind, rel: self._facts(self.member.where(F.col("member_kind") == kind), rel, "owner", "member")
        return part("field", "has_field").unionAll(part("method", "has_method"))

    def bounds(self) -> DataFrame:
        """Functions, traits and interfaces use the bounds of the type parameters in their scope."""
        own = self._scopes_of("func", "method", "trait", "interface")
        params = self.scope_symbol.select("scope_id", F.col("symbol_id").alias("p")).join(self._typed_symbols().where("kind = 'type_parameter'").select(F.col("symbol_id").alias("p"), F.col("type_of").alias("bound")), "p")
        return self._facts(self._to_block(own.join(params, "scope_id"), "bound"), "uses")

    def _scopes_of(self, *kinds: str) -> DataFrame:
        return self._symbols_of(*kinds).where("owned_scope_id is not null").select("src", F.col("owned_scope_id").alias("scope_id"))

    def _typed_symbols(self) -> DataFrame:
        return self.symbol.where("type_of is not null").select("symbol_id", "kind", "type_of")

    def _bases(self, kind: str) -> DataFrame:
        return self._symbols_of(kind).where("type_of is not null").select("src", "type_of")

    def _types(self, *kinds: str) -> DataFrame:
        return self.block.where(F.col("kind").isin(*kinds) & F.col("type_symbol_id").isNotNull()).select(F.col("block_id").alias("src"), F.col("type_symbol_id").alias("s"))

    def _nested(self, *kinds: str) -> DataFrame:
        return self._to_block(self._symbols_of(*kinds).select("src", "kind", F.explode("nested_types").alias("n")), "n")

    def _decorators(self, *kinds: str) -> DataFrame:
        return self._to_block(self._symbols_of(*kinds).select("src", F.explode("decorators").alias("d")), "d", follow=False)

    def call_dependencies(self) -> DataFrame:
        """(src, dst, is_call): what a function's body reaches, nested functions excluded (calls carry their nearest function)."""
        hit = self._to_block(self.calls.select(F.col("enclosing_id").alias("src"), F.col("symbol_id").alias("s")).where("src is not null"), "s", follow=False)
        bodies = hit.where(F.col("dst_kind").isin(*KIND_SETS["callable_body"])).select("src", "dst", F.lit(True).alias("is_call"))
        made = hit.where(F.col("dst_kind").isin(*KIND_SETS["constructable"])).select("src", "dst", F.lit(False).alias("is_call"))
        methods = self.calls.join(self._typed_symbols().where("kind = 'method'").select("symbol_id", "type_of"), "symbol_id").select(F.col("enclosing_id").alias("src"), "type_of")
        receivers = self._to_block(methods.where("src is not null"), "type_of").select("src", "dst", F.lit(False).alias("is_call"))
        return bodies.unionAll(made).unionAll(receivers).distinct()

    def callables(self) -> DataFrame:
        deps = self.call_dependencies()
        uses = deps.where("not is_call").select("src", "dst").unionAll(self._nested("func", "method").select("src", "dst")).unionAll(self._decorators("func", "method").select("src", "dst"))
        return self.function_calls().unionAll(self._facts(uses, "uses"))

    def function_calls(self) -> DataFrame:
        """(src, relation, dst): the calls that leave functions, methods and whatever else encloses them; those of call blocks are in `call_sites`."""
        return self._facts(self.call_dependencies().where("is_call"), "calls")

    def call_sites(self) -> DataFrame:
        hit = self._to_block(self.calls.select(F.col("call_id").alias("src"), F.col("symbol_id").alias("s")), "s", follow=False)
        return self._facts(hit, "calls")

    def classes(self) -> DataFrame:
        bases = self._to_block(self._bases("class"), "type_of")
        nested = self._nested("class")
        contract, constraint = nested.where("dst_kind = 'interface'"), nested.where("dst_kind in ('trait', 'interface')")
        return self._facts(bases, "extends").unionAll(self._facts(constraint, "uses")).unionAll(self._facts(contract, "implements")).unionAll(self._facts(self._decorators("class"), "uses"))

    def interfaces(self) -> DataFrame:
        return self._facts(self._nested("interface"), "extends")

    def implementations(self) -> DataFrame:
        if self.impls is None:
            return self._facts(self.block.where("false").select(F.col("block_id").alias("src"), F.col("block_id").alias("dst")), "impl_for")
        target = self._to_block(self.impls.select(F.col("block_id").alias("src"), F.col("target_symbol").alias("s")), "s")
        contract = self._to_block(self.impls.where("contract_symbol is not null").select(F.col("block_id").alias("src"), F.col("contract_symbol").alias("s")), "s")
        return self._facts(target, "impl_for").unionAll(self._facts(contract, "implements"))

    def typed(self, *kinds: str) -> DataFrame:
        """Parameters, returns, constants, fields and aliases point at their types; `kinds` are some of these."""
        return self._facts(self._to_block(self._types(*(kinds or ("parameter", "return", "const", "field", "alias"))), "s"), "type_of")

    #: the rules that make a relation
    RULES = {
        "contains": ("containment",), "has_parameters": ("signatures",), "has_return": ("signatures",), "has_field": ("member_facts",), "has_method": ("member_facts",), "uses": ("bounds", "callables", "classes"),
        "calls": ("function_calls", "call_sites"), "extends": ("classes", "interfaces"), "implements": ("classes", "implementations"), "impl_for": ("implementations",), "type_of": ("typed",),
    }

    def relations(self) -> DataFrame:
        return with_inverses(union_all([self.containment(), self.signatures(), self.member_facts(), self.bounds(), self.callables(), self.call_sites(), self.classes(), self.interfaces(), self.implementations(), self.typed()]))

    def one(self, relation: str, *kinds: str) -> DataFrame:
        """(src, dst) of one relation, which no other is derived for; inverses are not in `RULES`. `type_of` may be asked for blocks of some kinds."""
        return hop(union_all([getattr(self, rule)(*kinds) for rule in self.RULES[relation]]), relation).distinct()

    def type_deps(self) -> DataFrame:
        """(block_id, type_deps): arguments of implementation targets and what classes nest or are decorated with."""
        rows = self._nested("class").select("src", "dst").unionAll(self._decorators("class").select("src", "dst"))
        if self.impls is not None and "target_args" in self.impls.columns:
            target = self._to_block(self.impls.select(F.col("target_symbol").alias("s"), "target_args"), "s").select(F.col("dst").alias("src"), F.explode("target_args").alias("a"))
            rows = rows.unionAll(self._to_block(target, "a").select("src", "dst"))
        return rows.groupBy(F.col("src").alias("block_id")).agg(F.sort_array(F.collect_set("dst")).alias("type_deps"))
