"""A Rust source tree written from the star tables, one file a nation and one crate a region, and queries over the graph that the build makes of it.

Every nation's file declares the same names (`Home`, `Pair`, `Sells`, `make`, ...), so only paths, imports and declared types tell them apart:

* a supplier is a struct with a field and an implementation, a customer a struct with a field of its own module's `Home` and one of another module's;
* an order is a function of a customer and of the supplier of its first line, by a path into that supplier's crate, whose `make` it calls, as
  well as a method on the parameter.

The SQL says what must come out, straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import MEMBERS
from ..operators.graph import Graph
from .project import Project, build
from .star import table

_BUILT: dict[tuple[str, str], Project] = {}


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


class SourceTree:
    def __init__(self, spark: SparkSession, sf_dir: str):
        t = lambda n: table(spark, sf_dir, n)
        nation, self.customer, self.supplier, self.orders, self.lineitem = map(t, ("nation", "customer", "supplier", "orders", "lineitem"))
        first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
        self.nation = nation.join(first, "n_regionkey").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"), F.col("first").cast("long").alias("first"))

    def sales(self) -> DataFrame:
        """(n, o, c, s, sn, sr): an order, its customer, the supplier of its first line and where that is."""
        lines = self.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("s"))
        seller = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n")).select(F.col("s_suppkey").alias("s"), F.col("n").alias("sn"), F.col("r").alias("sr"))
        buyer = self.customer.select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("long").alias("n"))
        sold = self.orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c")).join(lines, F.col("o") == F.col("l_orderkey"))
        return sold.join(seller, "s").join(buyer, "c").select("n", "o", "c", "s", "sn", "sr")

    def files(self) -> DataFrame:
        """(unit_id, content, lang)"""
        c = F.col
        head = self.nation.select("n", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), _text(
            "use crate::n", c("first"), "::Home as First;\npub struct Home { pub size: u32 }\npub struct Pair { pub near: Home, pub far: First }\npub fn make() {}\n",
            "pub trait Marked { }\npub trait Sells { fn sell(&self); }\npub fn pick<T: Marked>(x: T) { }\n",
            "pub struct Bag<T> { pub item: T }\npub struct Shelf { pub bag: Bag<Pair> }",
        ).alias("text"))
        sellers = self.supplier.select(c("s_nationkey").cast("long").alias("n"), F.lit(1).alias("part"), c("s_suppkey").alias("at"), _text(
            "pub struct S", c("s_suppkey"), " { pub home: Home }\nimpl Sells for S", c("s_suppkey"), " { fn sell(&self) { make(); } }"
        ).alias("text"))
        buyers = self.customer.join(self.nation, c("c_nationkey") == c("n")).select("n", F.lit(2).alias("part"), c("c_custkey").alias("at"), _text(
            "pub struct C", c("c_custkey"), " { pub home: Home, pub other: crate::n", c("first"), "::Home }"
        ).alias("text"))
        where = _text("r", c("sr"), "::n", c("sn"), "::")
        sales = self.sales().select("n", F.lit(3).alias("part"), c("o").alias("at"), _text(
            "pub fn o", c("o"), "(buyer: C", c("c"), ", seller: ", where, "S", c("s"), ") -> Home { ", where, "make(); seller.sell(); }"
        ).alias("text"))
        rows = head.unionAll(sellers).unionAll(buyers).unionAll(sales)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "text"))), lambda x: x["text"])
        return rows.groupBy(c("n").alias("unit_id")).agg(F.array_join(ordered, "\n").cast("binary").alias("content")).withColumn("lang", F.lit("rust"))

    def unit_meta(self) -> DataFrame:
        package, name = F.concat(F.lit("r"), F.col("r").cast("string")), F.concat(F.lit("n"), F.col("n").cast("string"), F.lit(".rs"))
        root = F.concat(F.lit("world/"), package)
        return self.nation.select(
            F.col("n").alias("unit_id"), F.lit("world").alias("project_name"), F.lit("world").alias("project_root"), package.alias("package_name"), root.alias("package_root"),
            F.lit(None).cast("string").alias("module_name"), F.lit(None).cast("string").alias("module_root"), name.alias("file_name"), F.concat(root, F.lit("/src/"), name).alias("file_path"),
            F.col("r").alias("package_index"),
        )


def project(spark: SparkSession, sf_dir: str) -> Project:
    """Built once a session and folder; its tables lie in the shared folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _BUILT:
        tree = SourceTree(spark, sf_dir)
        _BUILT[at] = build(tree.files(), tree.unit_meta())
    return _BUILT[at]


SQL = """
with nat as (select n_nationkey::bigint as n, n_regionkey::bigint as r, min(n_nationkey::bigint) over (partition by n_regionkey) as first from nation),
sup as (select s_suppkey as s, n as sn, r as sr from supplier join nat on s_nationkey = n),
lines as (select l_orderkey, l_suppkey as s, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) as i from lineitem),
sales as (select c_nationkey::bigint as n, o_orderkey as o, c_custkey as c, sup.s, sup.sn, sup.sr from orders join lines on o_orderkey = l_orderkey and i = 1 join sup on sup.s = lines.s join customer on c_custkey = o_custkey)
"""


def _named(p: Project, side: str, *kinds: str) -> DataFrame:
    """Blocks, of these kinds or all, as one end of a relation: their file, kind and name."""
    block = p.located.where(F.col("kind").isin(*kinds)) if kinds else p.located
    return block.select(F.col("block_id").alias(side), F.col("unit_id").alias(f"{side}_file"), F.col("kind").alias(f"{side}_kind"), F.col("name").alias(f"{side}_name"))


def _meant(p: Project, side: str = "dst") -> DataFrame:
    """The blocks that a name can lead to, in the same form."""
    return p.declared.select(F.col("symbol_id").alias(side), F.col("unit_id").alias(f"{side}_file"), F.col("block_kind").alias(f"{side}_kind"), F.col("name").alias(f"{side}_name"))


def linked(p: Project, relation: str) -> DataFrame:
    """A relation of the whole graph with both ends."""
    return p.graph.hop(relation).join(_named(p, "src"), "src").join(_named(p, "dst"), "dst")


def _to_named(p: Project, edges: DataFrame, *kinds: str) -> DataFrame:
    """Edges from blocks of these kinds to what a name led to, with both ends."""
    return edges.join(_meant(p), "dst").join(_named(p, "src", *kinds), "src")


# each query asks for the relations that it reads, and for no other


def source_blocks(spark, sf_dir):
    return project(spark, sf_dir).located.groupBy(F.col("unit_id").alias("file"), "kind").agg(F.count("*").alias("n"))


def source_field_types(spark, sf_dir):
    p = project(spark, sf_dir)
    owner = p.linker.one("has_field").join(_named(p, "src", *MEMBERS["field"]), "src").select(F.col("src_name").alias("owner"), F.col("dst").alias("src"))
    out = _to_named(p, p.linker.one("type_of", "field"), "field").join(owner, "src")
    return out.select(F.col("src_file").alias("file"), "owner", F.col("src_name").alias("field"), F.col("dst_name").alias("type"), F.col("dst_file").alias("type_file"))


def source_signatures(spark, sf_dir):
    p = project(spark, sf_dir)
    parts = p.linker.one("has_parameters").withColumn("role", F.lit("takes")).unionAll(p.linker.one("has_return").withColumn("role", F.lit("gives"))).withColumnRenamed("dst", "part")
    types = p.linker.one("type_of", "parameter", "return").withColumnRenamed("src", "part")
    out = _to_named(p, parts.join(types, "part"), "func", "method")
    return out.select(F.col("src_file").alias("file"), F.col("src_name").alias("func"), "role", F.col("dst_name").alias("type"), F.col("dst_file").alias("type_file"))


def source_calls(spark, sf_dir):
    p = project(spark, sf_dir)
    out = _to_named(p, p.linker.function_calls(), "func", "method")
    return out.groupBy(F.col("src_file").alias("file"), F.col("src_name").alias("caller"), F.col("dst_name").alias("callee"), F.col("dst_file").alias("callee_file")).agg(F.countDistinct("src").alias("n"))


def source_impls(spark, sf_dir):
    p = project(spark, sf_dir)
    target = p.linker.one("impl_for").join(_meant(p), "dst").select("src", F.col("dst_name").alias("target"), F.col("dst_file").alias("target_file"))
    contract = p.linker.one("implements").join(_meant(p), "dst").select("src", F.col("dst_name").alias("contract"), F.col("dst_file").alias("contract_file"))
    return target.join(contract, "src").select("target", "target_file", "contract", "contract_file")


def source_methods(spark, sf_dir):
    p = project(spark, sf_dir)
    out = p.linker.one("has_method").join(_named(p, "src", *MEMBERS["method"]), "src").join(_named(p, "dst", "method"), "dst")
    return out.select(F.col("src_file").alias("file"), F.col("src_kind").alias("owner_kind"), F.col("src_name").alias("owner"), F.col("dst_name").alias("method"))


def source_bounds(spark, sf_dir):
    p = project(spark, sf_dir)
    out = _to_named(p, p.linker.one("uses"), "func")
    return out.select(F.col("src_file").alias("file"), F.col("src_name").alias("func"), F.col("dst_name").alias("bound"), F.col("dst_file").alias("bound_file"))


def source_package_calls(spark, sf_dir):
    p = project(spark, sf_dir)
    package = p.unit_meta.select("unit_id", "package_name")
    out = _to_named(p, p.linker.function_calls(), "func")
    out = out.join(package.select(F.col("unit_id").alias("src_file"), F.col("package_name").alias("caller")), "src_file").join(package.select(F.col("unit_id").alias("dst_file"), F.col("package_name").alias("callee")), "dst_file")
    return out.groupBy("caller", "callee").agg(F.count("*").alias("n"))


def source_actual_types(spark, sf_dir):
    p = project(spark, sf_dir)
    types = Graph(p.typed, None).actual_types(p.target, "unit_id", "kind").withColumnRenamed("type_block_id", "dst")
    return types.join(_meant(p), "dst").groupBy(F.col("unit_id").alias("file"), "kind", F.col("dst_name").alias("type"), F.col("dst_file").alias("type_file")).agg(F.count("*").alias("n"))


def source_type_arguments(spark, sf_dir):
    p = project(spark, sf_dir)
    out = Graph(p.argued, None).nested_type_blocks(p.target).withColumnRenamed("block_id", "src").withColumnRenamed("type_block_id", "dst")
    return _to_named(p, out).select(F.col("src_file").alias("file"), F.col("src_name").alias("field"), "place", F.col("dst_name").alias("argument"), F.col("dst_file").alias("argument_file"))


ORACLES = {
    "source_actual_types": """select file, kind, type, type_file, count(*) as n from (
        select n as file, 'field' as kind, 'Home' as type, n as type_file from nat union all select n, 'field', 'Home', first from nat union all select n, 'field', 'Bag', n from nat
        union all select n, 'parameter', 'Marked', n from nat union all select sn, 'field', 'Home', sn from sup union all select sn, 'impl', 'S' || s, sn from sup
        union all select n, 'field', 'Home', n from customer join nat on c_nationkey = n union all select n, 'field', 'Home', first from customer join nat on c_nationkey = n
        union all select n, 'parameter', 'C' || c, n from sales union all select n, 'parameter', 'S' || s, sn from sales union all select n, 'return', 'Home', n from sales) t group by file, kind, type, type_file""",
    "source_type_arguments": "select n as file, 'bag' as field, 0 as place, 'Pair' as argument, n as argument_file from nat",
    "source_blocks": """select file, kind, cast(sum(n) as bigint) as n from (
        select n as file, unnest(['root', 'class', 'field', 'class', 'field', 'field', 'func', 'trait', 'trait', 'method', 'parameter', 'func', 'parameter', 'class', 'field', 'class', 'field']) as kind, 1 as n from nat
        union all select n, unnest(['class', 'field', 'impl', 'method', 'parameter', 'call']), 1 from sup join nat on sn = n
        union all select n, unnest(['class', 'field', 'field']), 1 from customer join nat on c_nationkey = n
        union all select n, unnest(['func', 'parameter', 'parameter', 'return', 'call', 'call']), 1 from sales) group by file, kind""",
    "source_field_types": """select n as file, 'Pair' as owner, 'near' as field, 'Home' as type, n as type_file from nat union all select n, 'Pair', 'far', 'Home', first from nat
        union all select n, 'Shelf', 'bag', 'Bag', n from nat union all select sn, 'S' || s, 'home', 'Home', sn from sup union all select n, 'C' || c_custkey, 'home', 'Home', n from customer join nat on c_nationkey = n
        union all select n, 'C' || c_custkey, 'other', 'Home', first from customer join nat on c_nationkey = n""",
    "source_signatures": """select n as file, 'o' || o as func, 'takes' as role, 'C' || c as type, n as type_file from sales union all select n, 'o' || o, 'takes', 'S' || s, sn from sales
        union all select n, 'o' || o, 'gives', 'Home', n from sales union all select n, 'pick', 'takes', 'Marked', n from nat""",
    "source_calls": """select n as file, 'o' || o as caller, 'make' as callee, sn as callee_file, 1::bigint as n from sales union all select n, 'o' || o, 'sell', sn, 1 from sales
        union all select sn, 'sell', 'make', sn, count(*) from sup group by sn""",
    "source_impls": "select 'S' || s as target, sn as target_file, 'Sells' as contract, sn as contract_file from sup",
    "source_methods": "select n as file, 'trait' as owner_kind, 'Sells' as owner, 'sell' as method from nat union all select sn, 'impl', 'S' || s, 'sell' from sup",
    "source_bounds": "select n as file, 'pick' as func, 'Marked' as bound, n as bound_file from nat",
    "source_package_calls": "select 'r' || a.r as caller, 'r' || sr as callee, 2 * count(*) as n from sales join nat a on a.n = sales.n group by 1, 2",
}
ORACLES = {name: SQL + sql for name, sql in ORACLES.items()}
QUERIES = {f.__name__: f for f in (source_blocks, source_field_types, source_signatures, source_calls, source_impls, source_methods, source_bounds, source_package_calls, source_actual_types, source_type_arguments)}
