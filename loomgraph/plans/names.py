"""Numbering, kinds, ownership, type references and scopes of blocks and symbols as queries over the tables, each with the same query for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kinds import INFLUENCE, MATERIALIZED, NO_SYMBOL_BLOCK
from ..operators import blocks as B
from ..operators import meta as M
from ..operators import rank as K
from ..operators import resolve as N
from .star import SQL, Star, key, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, star: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = SQL.rstrip() + "\n" + sql if star else sql
        return f

    return add


@query("select l_orderkey as unit_id, l_linenumber as local_id, l_orderkey * 16777216 + row_number() over (partition by l_orderkey order by l_partkey % 5, l_suppkey desc, l_returnflag, l_linenumber) as block_id from items", star=True)
def block_numbers(spark, sf_dir):
    lines = Star(spark, sf_dir).lineitem
    facts = lines.select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("local_id"), (F.col("l_partkey") % 5).alias("start_byte"), F.col("l_suppkey").alias("end_byte"), F.col("l_returnflag").alias("kind"))
    return B.number(facts).select("unit_id", "local_id", "block_id")


@query("""select kind, count(*) as n from (select coalesce(case when l_linenumber % 7 = 0 then 'undefined' end, case when l_returnflag = 'A' then 'parameter' end, case when l_linenumber % 2 = 1 then 'field' end, 'undefined') as kind
    from lineitem) k group by kind""")
def block_kinds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    facts = lines.select(F.when(F.col("l_linenumber") % 7 == 0, "undefined").alias("override_kind"), F.when(F.col("l_returnflag") == "A", "parameter").alias("field_kind"), F.when(F.col("l_linenumber") % 2 == 1, "field").alias("node_kind"))
    return B.block_kind(facts).groupBy("kind").agg(F.count("*").alias("n"))


@query("""select b.block_id, case when b.kind = 'field' then case when p.kind = 'impl' then 'method' else 'func' end else b.kind end as kind from block b left join block p on p.block_id = b.parent_id""", star=True)
def func_to_method(spark, sf_dir):
    block = Star(spark, sf_dir).block()
    return B.methods(block.withColumn("kind", F.when(F.col("kind") == "field", "func").otherwise(F.col("kind")))).select("block_id", "kind")


@query("""select b.block_id, case when p.kind = 'func' and p.block_id % 16 = 3 then p.parent_id else b.parent_id end as parent_id from block b left join block p on p.block_id = b.parent_id
    where not (b.kind = 'func' and b.block_id % 16 = 3)""", star=True)
def blocks_that_exist(spark, sf_dir):
    """Functions without a symbol have no block; what is inside hangs on the next block above."""
    block = Star(spark, sf_dir).block()
    bare = (F.col("kind") == "func") & (F.col("block_id") % 16 == 3)
    return B.materialized(block.withColumn("symbol_id", F.when(~bare, F.col("block_id")))).select("block_id", "parent_id")


@query(f"""select block_id // 16 as symbol_id, min(block_id) as block_id from block where kind in {MATERIALIZED} and kind not in {NO_SYMBOL_BLOCK} and kind <> 'field'
    and (block_id // 16) % 5 <> 0 group by 1""", star=True)
def symbol_blocks(spark, sf_dir):
    block = Star(spark, sf_dir).block().withColumn("symbol_id", F.floor(F.col("block_id") / 16))
    block = block.withColumn("name", F.when((F.col("kind") == "field") & (F.col("block_id") % 32 == 6), "0").otherwise(F.col("name")))
    symbols = block.select("symbol_id", F.when(F.col("symbol_id") % 5 == 0, "primitive").otherwise("struct").alias("kind")).distinct()
    return B.owned_symbols(block, symbols)


def _symbols(spark, sf_dir) -> DataFrame:
    """Parts as symbols of four kinds, each typed by the part before it, every third not at all."""
    part = table(spark, sf_dir, "part")
    place = F.col("p_partkey") % 4
    kind = F.when(place == 0, "type_alias").when(place == 1, "struct").when(place == 2, "enum_variant").otherwise("type_parameter")
    return part.select(F.col("p_partkey").alias("symbol_id"), kind.alias("kind"), F.when((F.col("p_partkey") % 3 != 0) & (F.col("p_partkey") > 1), F.col("p_partkey") - 1).alias("type_of"))


_SYMBOLS = """with recursive symbols as (select p_partkey as symbol_id, ['type_alias', 'struct', 'enum_variant', 'type_parameter'][p_partkey % 4 + 1] as kind,
    case when p_partkey % 3 <> 0 and p_partkey > 1 then p_partkey - 1 end as type_of from part),
hop as (select symbol_id, symbol_id as here, 0 as n from symbols union all select h.symbol_id, s.type_of, h.n + 1 from hop h join symbols s on s.symbol_id = h.here and s.kind in ('type_alias', 'type_parameter') and s.type_of is not null),
chased as (select symbol_id, arg_max(here, n) as target_id from hop group by symbol_id)
"""


@query(_SYMBOLS + """select s.symbol_id, coalesce(case when kind in ('type_alias', 'type_parameter') and target_id <> s.symbol_id then target_id end, type_of, case when kind <> 'enum_variant' then s.symbol_id end) as type_symbol_id
    from symbols s join chased c on c.symbol_id = s.symbol_id""")
def type_references(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return N.type_reference(symbols, N.chase(symbols))


@query(_SYMBOLS + "select symbol_id, case when kind <> 'enum_variant' then type_of end as shown_id from symbols")
def display_types(spark, sf_dir):
    return N.display_type(_symbols(spark, sf_dir))


@query("""select c_mktsegment as name, case when c_nationkey % 2 = 0 then 'struct' else 'trait' end as kind, arg_min(c_custkey, c_custkey) as symbol_id, min(c_custkey) as ordinal, true as is_global from customer group by 1, 2""")
def global_declarations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "struct").otherwise("trait").alias("kind"), F.col("c_custkey").alias("symbol_id"), F.col("c_custkey").alias("ordinal"))
    return N.declare_global(rows)


@query("select 7::bigint as scope_id, s_name as name, s_suppkey as symbol_id, row_number() over (order by s_nationkey, s_suppkey) - 1 as ordinal from supplier")
def merged_globals(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("unit_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("symbol_id"), F.col("s_suppkey").alias("ordinal"))
    return N.merge_globals(rows, 7)


@query("""with i as (select o_orderkey * 8 + 3 as impl, o_custkey * 8 as target, case when o_custkey % 3 = 0 then (o_custkey % 10 + 1) * 8 + 1 end as contract from orders where o_orderstatus = 'P')
select impl as scope_id, target as parent_id, 1000::bigint as ordinal from i union select target, impl, 1000 from i union select target, contract, 1000 from i where contract is not null""")
def implementation_scopes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    contract = F.when(F.col("o_custkey") % 3 == 0, key(F.col("o_custkey") % 10 + 1, "supplier"))
    return N.impl_scopes(orders.select(key("o_orderkey", "order").alias("impl_scope"), key("o_custkey", "customer").alias("target_scope"), contract.alias("contract_scope")))


@query("""with own as (select c_custkey as call_id, arg_max(s_suppkey, s_suppkey) as symbol_id, count(*) as n from customer join supplier on s_nationkey = c_nationkey group by 1)
select c_custkey as call_id, case when n = 1 then symbol_id else c_custkey % 10 end as symbol_id from customer left join own on call_id = c_custkey""")
def member_call_targets(spark, sf_dir):
    """A call of no parameter goes to its receiver's only overload, else to what the member lookup found."""
    empty = F.array().cast("array<long>").alias("types")
    calls = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), F.col("c_nationkey").cast("string").alias("name"), empty)
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_nationkey").cast("string").alias("name"), empty)
    return N.member_calls(calls, own, calls.select(F.col("call_id").alias("ref_id"), (F.col("call_id") % 10).alias("symbol_id")))


@query("""select 'w/' || n_nationkey as package_root, case when n_nationkey % 2 = 0 then 'scope_' || n_name else '' || n_nationkey end as package_name from nation""")
def packages_of_manifests(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    path = F.concat(F.lit("w/"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "/package.json").otherwise("/Cargo.toml"))
    return M.packages(nation.select(path.alias("path"), F.concat(F.lit('{"name": "@scope/'), "n_name", F.lit('"}')).alias("content")))


@query("select 'w' as project_root, 'w' as project_name")
def project_of_files(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return M.project_root(nation.select(F.concat(F.lit("w/r"), F.col("n_regionkey").cast("string"), F.lit("/src/"), "n_name", F.lit(".rs")).alias("path")))


@query("""with f as (select 'w/r' || n_regionkey as a, 'w/r' || n_regionkey || '/src' as b from nation),
per as (select folder, count(*) as files from (select a as folder from f union all select b from f union all select 'w' from f) x group by folder)
select p.folder, p.files, coalesce(u.files, p.files) - p.files as beside from per p left join per u on u.folder = case when p.folder like '%/%' then regexp_replace(p.folder, '/[^/]*$', '') end""")
def folder_counts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return M.folder_counts(nation.select(F.concat(F.lit("w/r"), F.col("n_regionkey").cast("string"), F.lit("/src/"), "n_name", F.lit(".rs")).alias("path")))


def pagerank_joins_10(spark, sf_dir):
    """The engine that has no bound on its size, with as many rounds as the other."""
    return K.pagerank(Star(spark, sf_dir).graph(), INFLUENCE, iterations=10, engine="joins").select("block_id", F.round("rank", 9).alias("rank"))


def pagerank_settled(spark, sf_dir):
    """Both engines, run to a (coarse) tolerance, stop after the same round with the same ranks."""
    g, options = Star(spark, sf_dir).graph(), K.RankOptions(tolerance=1e-3)
    ready = K.flow(g, INFLUENCE, options, "joins")
    one, many = (K.pagerank(g, INFLUENCE, options, engine=e, ready=ready) for e in ("one_task", "joins"))
    both = one.join(many.select("block_id", F.col("rank").alias("other"), F.col("iterations").alias("rounds"), F.col("converged").alias("done")), "block_id")
    return both.agg(F.count("*").alias("blocks"), F.min((F.col("iterations") == F.col("rounds")) & F.col("converged") & F.col("done")).alias("alike"), (F.max(F.abs(F.col("rank") - F.col("other"))) < 1e-9).alias("near"))


QUERIES |= {f.__name__: f for f in (pagerank_joins_10, pagerank_settled)}
ORACLES["pagerank_settled"] = SQL.rstrip() + "\nselect count(*) as blocks, true as alike, true as near from block"
