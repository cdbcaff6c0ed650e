"""Name resolution as joins and windows: scope chains, lexical and qualified lookup, members, type links, overloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kinds import KIND_SETS, MEMBER_ORDER
from ..session import settle
from .relations import mapped

MAX_LINKS = 32
MAX_SCOPES = 64


def scope_chain(scope_parent: DataFrame, scopes: DataFrame, max_depth: int = MAX_SCOPES) -> DataFrame:
    """(scope_id, ancestor_id, depth, place): a scope itself at depth 0, then its parents, nearest first; cycles are cut."""
    up = scope_parent.select(F.col("scope_id").alias("ancestor_id"), "parent_id", F.col("ordinal").alias("o"))
    seen = settle(scopes.select("scope_id", F.col("scope_id").alias("ancestor_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place")).distinct(), "chain")
    front = seen
    for depth in range(1, max_depth + 1):
        nxt = front.join(up, "ancestor_id").groupBy("scope_id", F.col("parent_id").alias("ancestor_id")).agg(F.min("o").alias("place"))
        front = settle(nxt.join(seen, ["scope_id", "ancestor_id"], "left_anti").select("scope_id", "ancestor_id", F.lit(depth).alias("depth"), "place"), "chain-front")
        if front.isEmpty():
            return seen
        seen = settle(seen.unionByName(front), "chain")
    raise RuntimeError(f"scopes nested deeper than {max_depth}")


def in_set(kind: Column, set_name: Column) -> Column:
    """Is a symbol kind in the named set; a null set allows all."""
    return set_name.isNull() | F.array_contains(_sets(set_name), kind)


def _sets(set_name: Column) -> Column:
    pairs = [x for name, kinds in KIND_SETS.items() for x in (F.lit(name), F.array(*[F.lit(k) for k in kinds]))]
    return F.element_at(F.create_map(*pairs), set_name)


def by_precedence(candidates: DataFrame, key: str = "ref_id") -> DataFrame:
    """Of several candidates the last in the same unit, else the last in the same package, else the last."""
    best = F.struct((F.col("unit_id") == F.col("ref_unit")).alias("u"), (F.col("package_index") == F.col("ref_package")).alias("p"), F.col("ordinal"), F.col("symbol_id"))
    return candidates.groupBy(key).agg(F.max(best).alias("b")).select(key, F.col("b.symbol_id").alias("symbol_id"))


def innermost(candidates: DataFrame, key: str = "ref_id", depth: str = "depth") -> DataFrame:
    """Only candidates of the nearest scope with a match: it shadows all others."""
    near = candidates.groupBy(key).agg(F.min(depth).alias("_near"))
    return candidates.join(near, key).where(F.col(depth) == F.col("_near")).drop("_near")


def lexical(refs: DataFrame, chain: DataFrame, scope_symbol: DataFrame, symbol: DataFrame) -> DataFrame:
    """`refs(ref_id, scope_id, name, kinds, ref_unit, ref_package)` -> (ref_id, symbol_id).

    A reference meets a scope's symbols of its name as one row a kind, never one by one: a kind that several symbols share
    is looked up by unit, package, both and neither, each of which holds its last symbols only.
    """
    at = ["ancestor_id", "name", "kind"]
    named = scope_symbol.select(F.col("scope_id").alias("ancestor_id"), "name", "symbol_id", "ordinal").join(symbol.select("symbol_id", "kind", "unit_id", "package_index"), "symbol_id")
    candidate = F.struct("ordinal", "symbol_id", "unit_id", "package_index")
    groups = settle(named.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.max(candidate).alias("last")), "scope-names")
    met = refs.join(chain.select("scope_id", "ancestor_id", "depth"), "scope_id").join(groups, ["ancestor_id", "name"]).where(in_set(F.col("kind"), F.col("kinds")))
    met = met.withColumn("_near", F.rank().over(Window.partitionBy("ref_id").orderBy("depth"))).where("_near = 1")
    met = settle(met.select("ref_id", "ref_unit", "ref_package", *at, "n", "last"), "scope-hits")
    found = met.where("n = 1").select("ref_id", "ref_unit", "ref_package", "last.*")
    # of several the best for any unit and package is the last of those that share both, one or none with the reference
    unit, package = F.col("unit_id"), F.col("package_index")
    several = named.join(groups.where("n > 1").select(*at), at, "left_semi")
    several = several.select(*at, candidate.alias("c"), unit.isNotNull().alias("u"), package.isNotNull().alias("p"), F.explode(_views(unit, package)).alias("view"))
    best = lambda *known: F.max(F.when(F.expr(" and ".join(known)), F.col("c")) if known else F.col("c"))
    several = several.where("view is not null").groupBy(*at, "view").agg(F.array_distinct(F.array_compact(F.array(best("u", "p"), best("u"), best("p"), best()))).alias("all"))
    asked = met.where("n > 1").select("ref_id", "ref_unit", "ref_package", *at, F.explode(_views(F.col("ref_unit"), F.col("ref_package"))).alias("view")).where("view is not null")
    more = asked.join(several, [*at, "view"]).select("ref_id", "ref_unit", "ref_package", F.explode("all").alias("c")).select("ref_id", "ref_unit", "ref_package", "c.*")
    return by_precedence(found.unionByName(more))


def _views(unit: Column, package: Column) -> Column:
    """What candidates share with a reference: unit and package, the unit, the package, nothing; null where that is not known."""
    u, p = unit.cast("long").cast("string"), package.cast("long").cast("string")
    return F.array(F.concat(F.lit("both "), u, F.lit(" "), p), F.concat(F.lit("unit "), u), F.concat(F.lit("package "), p), F.lit("none"))


def qualified(refs: DataFrame, chain: DataFrame, global_scope: int, scope_symbol: DataFrame, symbol: DataFrame) -> DataFrame:
    """`refs(ref_id, scope_id, parts array, kinds, ref_unit, ref_package)` -> (ref_id, symbol_id).

    The first part is looked up in the chain, then in the global scope, or, where `refs` has a column `start` that is not null, in that scope alone; the others in
    the scope that the part before owns. Every branch is followed; the kinds count for the last part only.
    """
    given = None
    if "start" in refs.columns:
        given = refs.where("start is not null").select("ref_id", F.col("start").alias("at"), F.lit(0).alias("depth"))
        everywhere, refs = refs, refs.where("start is null")
    starts = refs.join(chain.select("scope_id", "ancestor_id", "depth"), "scope_id").select("ref_id", F.col("ancestor_id").alias("at"), "depth")
    starts = starts.unionAll(refs.select("ref_id", F.lit(global_scope).cast("long").alias("at"), F.lit(MAX_SCOPES + 1).alias("depth"))).groupBy("ref_id", "at").agg(F.min("depth").alias("depth"))
    if given is not None:
        starts, refs = starts.unionByName(given), everywhere
    info = symbol.select("symbol_id", "kind", "unit_id", "package_index", "owned_scope_id")
    named = scope_symbol.select(F.col("scope_id").alias("at"), "name", "symbol_id", "ordinal")
    front = refs.select("ref_id", "parts", "kinds", "ref_unit", "ref_package").join(starts, "ref_id")
    most = refs.agg(F.max(F.size("parts"))).first()[0] or 1
    found = None
    for i in range(most):
        hit = front.where(F.size("parts") > i).withColumn("name", F.col("parts")[i]).join(named, ["at", "name"]).join(info, "symbol_id")
        hit = hit.where((F.size("parts") > i + 1) & F.col("owned_scope_id").isNotNull() | (F.size("parts") == i + 1) & in_set(F.col("kind"), F.col("kinds")))
        hit = settle(hit, "path-steps") if i + 1 < most else hit  # each step is read twice
        last = hit.where(F.size("parts") == i + 1).select("ref_id", "symbol_id", "unit_id", "package_index", "ordinal", "ref_unit", "ref_package", "depth")
        found = last if found is None else found.unionAll(last)
        front = hit.where(F.size("parts") > i + 1).select("ref_id", "parts", "kinds", "ref_unit", "ref_package", "depth", F.col("owned_scope_id").alias("at"))
    return by_precedence(found)


def chase(symbol: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """(symbol_id, target_id): follow type_of while the kind is an alias or type parameter; a dead end keeps the last."""
    link = F.col("kind").isin(*KIND_SETS["alias_link"]) & F.col("type_of").isNotNull()
    known = symbol.select("symbol_id", "kind", "type_of")
    steps = settle(known.where(link).select(F.col("symbol_id").alias("from_id"), F.col("type_of").alias("to_id")).join(known.select(F.col("symbol_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id"), "links")
    at = known.select("symbol_id", F.col("symbol_id").alias("target_id"))
    moving, done = settle(at.join(steps, F.col("target_id") == F.col("from_id")).select("symbol_id", F.col("to_id").alias("target_id")), "chase"), at.join(steps, F.col("target_id") == F.col("from_id"), "left_anti")
    for _ in range(max_links - 1):
        if moving.isEmpty():
            break
        nxt = moving.join(steps, F.col("target_id") == F.col("from_id"), "left")
        done = done.unionAll(nxt.where("to_id is null").select("symbol_id", "target_id"))
        moving = settle(nxt.where("to_id is not null").select("symbol_id", F.col("to_id").alias("target_id")), "chase")
    return done.unionAll(moving).select("symbol_id", "target_id")


def type_reference(symbol: DataFrame, chased: DataFrame) -> DataFrame:
    """(symbol_id, type_symbol_id): aliases and parameters their chased link, others their type, else themselves if a type."""
    own = F.when(F.col("kind").isin(*KIND_SETS["types"]), F.col("symbol_id"))
    alias = F.when(F.col("kind").isin(*KIND_SETS["alias_link"]) & (F.col("target_id") != F.col("symbol_id")), F.col("target_id"))
    return symbol.join(chased, "symbol_id", "left").select("symbol_id", F.coalesce(alias, F.col("type_of"), own).alias("type_symbol_id"))


def display_type(symbol: DataFrame) -> DataFrame:
    """(symbol_id, shown_id): the type, of a type parameter its bound; variants show none."""
    return symbol.select("symbol_id", F.when(F.col("kind") != "enum_variant", F.col("type_of")).alias("shown_id"))


def members(refs: DataFrame, chased: DataFrame, symbol: DataFrame, scope_parent: DataFrame, scope_symbol: DataFrame) -> DataFrame:
    """`refs(ref_id, receiver_id, name, ref_unit, ref_package)` -> (ref_id, symbol_id): in the receiver's type scope and its parents."""
    owners = symbol.select(F.col("symbol_id").alias("target_id"), F.col("owned_scope_id").alias("scope_id")).where("scope_id is not null")
    at = refs.join(chased.withColumnRenamed("symbol_id", "receiver_id"), "receiver_id").join(owners, "target_id")
    chain = scope_chain(scope_parent, at.select("scope_id"))
    named = scope_symbol.select(F.col("scope_id").alias("ancestor_id"), "name", "symbol_id", "ordinal")
    met = at.join(chain, "scope_id").join(named, ["ancestor_id", "name"]).join(symbol.select("symbol_id", "kind", "unit_id", "package_index"), "symbol_id")
    place = F.coalesce(mapped(F.col("kind"), {k: i for i, k in enumerate(MEMBER_ORDER)}), F.lit(len(MEMBER_ORDER)))
    return by_precedence(innermost(innermost(met.withColumn("order", place), depth="order")))


def overloads(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """`calls(call_id, name, types array)`, `candidates(symbol_id, name, types array)` -> (call_id, symbol_id).

    Among candidates of the same arity the best number of equal parameter types wins if it is positive and unique;
    else the only candidate of that arity. Calls and candidates of equal name and types are compared once.
    """
    asked = calls.select("name", F.col("types").alias("a")).distinct()
    known = candidates.groupBy("name", F.col("types").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("symbol_id"))
    met = asked.join(known, "name").where(F.size("a") == F.size("b"))
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)

    def best(rows: DataFrame, *key: str) -> DataFrame:
        """The best score of a key, how many candidates have it, the least of them, and how many there are in all."""
        each = rows.groupBy(*key, "score").agg(F.sum("tied").alias("tied"), F.min("symbol_id").alias("symbol_id"), F.sum("n").alias("n"))
        return each.groupBy(*key).agg(F.max(F.struct("score", "tied", "symbol_id")).alias("t"), F.sum("n").alias("n")).select(*key, "t.*", "n")

    of_types = best(met.select("name", "a", score.alias("score"), F.col("n").alias("tied"), "n", "symbol_id"), "name", "a")
    top = best(calls.select("call_id", "name", F.col("types").alias("a")).join(of_types, ["name", "a"]).drop("name", "a"), "call_id")
    return top.where("tied = 1 and (score > 0 or n = 1)").select("call_id", "symbol_id")


def member_calls(calls: DataFrame, own: DataFrame, fallback: DataFrame) -> DataFrame:
    """The receiver's own overloads first, a member lookup else: (call_id, symbol_id)."""
    first = overloads(calls, own)
    return calls.select("call_id").join(first, "call_id", "left").join(fallback.select(F.col("ref_id").alias("call_id"), F.col("symbol_id").alias("other")), "call_id", "left").select("call_id", F.coalesce("symbol_id", "other").alias("symbol_id")).where("symbol_id is not null")


# declarations


def declare(declarations: DataFrame, key: list[str] | None = None) -> DataFrame:
    """`declarations(scope_id, name, kind, ordinal, symbol_id)`: one symbol a name and scope, of the first known kind."""
    key = key or ["scope_id", "name"]
    first_kind = F.min(F.when(F.col("kind") != "unknown", F.struct("ordinal", "kind")))["kind"]
    return declarations.groupBy(*key).agg(F.min_by("symbol_id", "ordinal").alias("symbol_id"), F.coalesce(first_kind, F.lit("unknown")).alias("declared_kind"), F.min("ordinal").alias("ordinal"))


def declare_global(declarations: DataFrame) -> DataFrame:
    """Globals of one name are apart by kind."""
    return declarations.groupBy("name", "kind").agg(F.min_by("symbol_id", "ordinal").alias("symbol_id"), F.min("ordinal").alias("ordinal")).withColumn("is_global", F.lit(True))


def merge_globals(unit_globals: DataFrame, global_scope: int) -> DataFrame:
    """Per-unit globals in one scope, ordered by unit and place."""
    order = Window.orderBy("unit_id", "ordinal", "symbol_id")
    return unit_globals.select(F.lit(global_scope).cast("long").alias("scope_id"), "name", "symbol_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))


def impl_scopes(impls: DataFrame) -> DataFrame:
    """`impls(impl_scope, target_scope, contract_scope)` -> scope_parent rows: target and impl see each other, the contract is the target's parent."""
    both = impls.select(F.col("impl_scope").alias("scope_id"), F.col("target_scope").alias("parent_id")).unionAll(impls.select(F.col("target_scope").alias("scope_id"), F.col("impl_scope").alias("parent_id")))
    up = impls.where("contract_scope is not null").select(F.col("target_scope").alias("scope_id"), F.col("contract_scope").alias("parent_id"))
    return both.where("scope_id is not null and parent_id is not null").unionAll(up).distinct().withColumn("ordinal", F.lit(1000).cast("long"))
