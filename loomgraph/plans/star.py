"""A program graph derived from star-schema tables, so that every graph operator runs on data of any size.

customer = class, supplier = trait, part = enum, order = func (status P: impl), line = field, parameter or return (by its flag),
nation = module, region = root. Ids are key * 8 + tag, so they never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.relations import with_inverses

TAG = {"customer": 0, "supplier": 1, "part": 2, "order": 3, "nation": 4, "region": 5, "line": 6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str | Column, tag: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("long") * 8 + TAG[tag]


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str):
        t = lambda n: table(spark, sf_dir, n)
        self.region, self.nation, self.customer, self.supplier, self.part, self.orders, self.lineitem = map(t, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
        self.line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
        rest = ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")  # order and number may repeat: one row each
        self.lineitem = self.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*rest)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")

    def block(self) -> DataFrame:
        def rows(df, block_id, unit, kind, name, symbol_kind, line, parent, type_ref=None, nested=None):
            none = F.lit(None)
            return df.select(
                block_id.alias("block_id"), unit.cast("long").alias("unit_id"), kind.alias("kind"), name.alias("name"), symbol_kind.alias("symbol_kind"), line.cast("long").alias("start_line"),
                parent.cast("long").alias("parent_id"), (none if type_ref is None else type_ref).cast("long").alias("type_ref"), (none if nested is None else nested).cast("array<long>").alias("nested_types"),
            )

        lit, col, none = F.lit, F.col, F.lit(None)
        kind = F.when(col("l_returnflag") == "A", lit("parameter")).when(col("l_returnflag") == "R", lit("return")).otherwise(lit("field"))
        part, supplier = key("l_partkey", "part"), key("l_suppkey", "supplier")
        nested = F.when(kind == "field", F.when(col("l_quantity") > 40, F.array(supplier, part)).otherwise(F.array(supplier)))
        return (
            rows(self.region, key("r_regionkey", "region"), lit(-1), lit("root"), col("r_name"), lit("package"), col("r_regionkey"), none)
            .unionAll(rows(self.nation, key("n_nationkey", "nation"), lit(-1), lit("module"), col("n_name"), lit("module"), col("n_nationkey"), key("n_regionkey", "region")))
            .unionAll(rows(self.customer, key("c_custkey", "customer"), col("c_nationkey"), lit("class"), col("c_name"), lit("struct"), col("c_custkey"), key("c_nationkey", "nation")))
            .unionAll(rows(self.supplier, key("s_suppkey", "supplier"), col("s_nationkey"), lit("trait"), col("s_name"), lit("trait"), col("s_suppkey"), key("s_nationkey", "nation")))
            .unionAll(rows(self.part, key("p_partkey", "part"), lit(-1), lit("enum"), col("p_name"), lit("enum"), col("p_partkey"), none))
            .unionAll(rows(self.orders, key("o_orderkey", "order"), lit(-1), F.when(col("o_orderstatus") == "P", lit("impl")).otherwise(lit("func")), none.cast("string"), lit("function"), col("o_orderkey"), key("o_custkey", "customer")))
            .unionAll(rows(self.lineitem, key(self.line, "line"), lit(-1), kind, none.cast("string"), lit("field"), self.line, key("l_orderkey", "order"), part, nested))
        )

    def facts(self) -> DataFrame:
        """Facts, repeated ones included: `with_inverses` makes them distinct."""

        def rows(df, src, relation, dst):
            return df.select(src.alias("src"), F.lit(relation).alias("relation"), dst.alias("dst"))

        sold = self.lineitem.join(self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey")
        customer, supplier, order, line, part = key("o_custkey", "customer"), key("l_suppkey", "supplier"), key("l_orderkey", "order"), key(self.line, "line"), key("l_partkey", "part")
        near = self.customer.join(self.supplier, F.col("c_custkey") == F.col("s_suppkey"))  # one supplier at most: linear in the table
        next_part = self.part.where("p_partkey > 1").select(key("p_partkey", "part").alias("src"), key(F.col("p_partkey") - 1, "part").alias("dst"))
        own = self.orders.withColumnRenamed("o_orderkey", "l_orderkey")
        return (
            rows(self.nation, key("n_regionkey", "region"), "contains", key("n_nationkey", "nation"))
            .unionAll(rows(self.customer, key("c_nationkey", "nation"), "contains", key("c_custkey", "customer"))).unionAll(rows(self.supplier, key("s_nationkey", "nation"), "contains", key("s_suppkey", "supplier")))
            .unionAll(rows(sold, customer, "calls", supplier)).unionAll(rows(sold, customer, "uses", part))
            .unionAll(rows(own.where("o_orderpriority = '1-URGENT'"), customer, "uses", order)).unionAll(rows(own, order, "type_of", customer))
            .unionAll(rows(self.lineitem.where("l_returnflag = 'A'"), order, "has_parameters", line)).unionAll(rows(self.lineitem.where("l_returnflag = 'R'"), order, "has_return", line))
            .unionAll(rows(sold.where("l_returnflag = 'N'"), customer, "has_field", line)).unionAll(rows(self.lineitem, line, "type_of", part))
            .unionAll(rows(own.where("o_orderstatus = 'P'"), order, "impl_for", customer)).unionAll(rows(sold.where("o_orderstatus = 'P' and l_linenumber = 1"), order, "implements", supplier))
            .unionAll(rows(near, key("c_custkey", "customer"), "implements", key("s_suppkey", "supplier"))).unionAll(next_part.select("src", F.lit("extends").alias("relation"), "dst"))
        )

    def type_deps(self) -> DataFrame:
        sold = self.lineitem.where("l_discount >= 0.1").join(self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        return sold.select(key("o_custkey", "customer").alias("block_id"), key("l_partkey", "part").alias("dep")).groupBy("block_id").agg(F.collect_set("dep").alias("type_deps"))

    def unit_meta(self) -> DataFrame:
        path = F.concat_ws("/", F.lit("world"), "r_name", F.lit("src"), F.concat("n_name", F.lit(".rs")))
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("long").alias("unit_id"), F.lit("world").alias("project_name"), F.lit("world").alias("project_root"), F.col("r_name").alias("package_name"),
            F.concat(F.lit("world/"), "r_name").alias("package_root"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("module_name"),
            F.when(F.col("n_nationkey") % 3 > 0, F.concat_ws("/", F.lit("world"), "r_name", F.lit("src"))).alias("module_root"),
            F.concat("n_name", F.lit(".rs")).alias("file_name"), path.alias("file_path"), F.col("n_regionkey").cast("long").alias("package_index"),
        )

    def graph(self, deps: bool = False) -> Graph:
        block = self.block()
        if deps:
            block = block.join(self.type_deps(), "block_id", "left")
        return Graph(block, with_inverses(self.facts()), self.unit_meta())


# the same graph for DuckDB

SQL = """
with items as materialized (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag),
sold as materialized (select l.*, o.o_custkey, o.o_orderstatus from items l join orders o on o.o_orderkey = l.l_orderkey),
block as materialized (
  select r_regionkey::bigint * 8 + 5 as block_id, -1::bigint as unit_id, 'root' as kind, r_name as name, 'package' as symbol_kind, r_regionkey::bigint as start_line, null::bigint as parent_id, null::bigint as type_ref, null::bigint[] as nested_types from region
  union all select n_nationkey::bigint * 8 + 4, -1, 'module', n_name, 'module', n_nationkey, n_regionkey::bigint * 8 + 5, null, null from nation
  union all select c_custkey * 8, c_nationkey, 'class', c_name, 'struct', c_custkey, c_nationkey::bigint * 8 + 4, null, null from customer
  union all select s_suppkey * 8 + 1, s_nationkey, 'trait', s_name, 'trait', s_suppkey, s_nationkey::bigint * 8 + 4, null, null from supplier
  union all select p_partkey * 8 + 2, -1, 'enum', p_name, 'enum', p_partkey, null, null, null from part
  union all select o_orderkey * 8 + 3, -1, case when o_orderstatus = 'P' then 'impl' else 'func' end, null, 'function', o_orderkey, o_custkey * 8, null, null from orders
  union all select (l_orderkey * 8 + l_linenumber) * 8 + 6, -1, case l_returnflag when 'A' then 'parameter' when 'R' then 'return' else 'field' end, null, 'field', l_orderkey * 8 + l_linenumber, l_orderkey * 8 + 3, l_partkey * 8 + 2,
    case when l_returnflag not in ('A', 'R') then case when l_quantity > 40 then [l_suppkey * 8 + 1, l_partkey * 8 + 2] else [l_suppkey * 8 + 1] end end from items),
facts as materialized (
  select n_regionkey::bigint * 8 + 5 as src, 'contains' as relation, n_nationkey::bigint * 8 + 4 as dst from nation
  union select c_nationkey::bigint * 8 + 4, 'contains', c_custkey * 8 from customer
  union select s_nationkey::bigint * 8 + 4, 'contains', s_suppkey * 8 + 1 from supplier
  union select o_custkey * 8, 'calls', l_suppkey * 8 + 1 from sold
  union select o_custkey * 8, 'uses', l_partkey * 8 + 2 from sold
  union select o_custkey * 8, 'uses', o_orderkey * 8 + 3 from orders where o_orderpriority = '1-URGENT'
  union select o_orderkey * 8 + 3, 'type_of', o_custkey * 8 from orders
  union select l_orderkey * 8 + 3, 'has_parameters', (l_orderkey * 8 + l_linenumber) * 8 + 6 from items where l_returnflag = 'A'
  union select l_orderkey * 8 + 3, 'has_return', (l_orderkey * 8 + l_linenumber) * 8 + 6 from items where l_returnflag = 'R'
  union select o_custkey * 8, 'has_field', (l_orderkey * 8 + l_linenumber) * 8 + 6 from sold where l_returnflag = 'N'
  union select (l_orderkey * 8 + l_linenumber) * 8 + 6, 'type_of', l_partkey * 8 + 2 from items
  union select o_orderkey * 8 + 3, 'impl_for', o_custkey * 8 from orders where o_orderstatus = 'P'
  union select l_orderkey * 8 + 3, 'implements', l_suppkey * 8 + 1 from sold where o_orderstatus = 'P' and l_linenumber = 1
  union select c_custkey * 8, 'implements', s_suppkey * 8 + 1 from customer join supplier on c_custkey = s_suppkey
  union select p_partkey * 8 + 2, 'extends', (p_partkey - 1) * 8 + 2 from part where p_partkey > 1),
inverse(relation, back) as (values ('contains', 'contained_by'), ('calls', 'called_by'), ('has_field', 'field_of'), ('type_of', 'type_for'), ('impl_for', 'has_impl'), ('has_method', 'method_of'),
  ('implements', 'implemented_by'), ('uses', 'used_by'), ('extends', 'extended_by')),
relation as materialized (select * from facts union select f.dst, i.back, f.src from facts f join inverse i on i.relation = f.relation),
deps as (select distinct o_custkey * 8 as block_id, l_partkey * 8 + 2 as dep from sold where l_discount >= 0.1),
unit_meta as (select n_nationkey::bigint as unit_id, r_name as package_name, 'world/' || r_name as package_root, case when n_nationkey % 3 > 0 then n_name end as module_name,
  case when n_nationkey % 3 > 0 then 'world/' || r_name || '/src' end as module_root, 'world/' || r_name || '/src/' || n_name || '.rs' as file_path from nation join region on r_regionkey = n_regionkey),
visible as (select * from block where kind in ('class', 'trait', 'interface', 'enum', 'func')),
nominal as (select * from block where kind in ('class', 'enum')),
edge_kind(kind, back, from_role, to_role) as (values ('field', true, 'field_type', 'container'), ('nested_field', true, 'type_dep', 'container'), ('type_arg', true, 'type_arg', 'generic'), ('call', false, 'caller', 'callee'),
  ('param', true, 'input', 'func'), ('return', false, 'func', 'output'), ('conformance', true, 'contract', 'conforms'), ('specialization', true, 'base', 'specializes'), ('type_dep', false, 'source', 'type_dep'),
  ('impl_arg', true, 'type_arg', 'implementation'), ('annotation', true, 'annotation', 'annotates'))
"""
