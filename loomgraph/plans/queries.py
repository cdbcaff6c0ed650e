"""Every graph operator as a query over the star graph or the raw tables, each with the same query for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..kinds import EDGE_KINDS, INFLUENCE, KIND_PRIOR, KIND_SETS, ORCHESTRATION
from ..operators import blocks as B
from ..operators import collect as C
from ..operators import meta as M
from ..operators import rank as K
from ..operators import relations as R
from ..operators import resolve as N
from ..operators import rollup as U
from ..operators.graph import Graph
from . import generated, names
from .star import SQL, Star, key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, star: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (SQL.rstrip() + "\n" + sql) if star and not sql.lstrip().startswith(",") else SQL.rstrip() + sql if star else sql
        return f

    return add


def graph(spark, sf_dir, deps=False) -> Graph:
    return Star(spark, sf_dir).graph(deps)


# relations and lookups


@query("select src, dst from relation where relation = 'calls'")
def related_one_hop(spark, sf_dir):
    return graph(spark, sf_dir).callees()


@query("""select p.src, t.dst, p.relation as via from relation p join relation t on t.src = p.dst and t.relation = 'type_of' where p.relation in ('has_parameters', 'has_return')""")
def related_two_hop_types(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.param_types().withColumn("via", F.lit("has_parameters")).unionAll(g.return_types().withColumn("via", F.lit("has_return")))


@query("select dst, src from relation where relation = 'implements' and dst in (select block_id from block where kind = 'trait')")
def reverse_related(spark, sf_dir):
    g = graph(spark, sf_dir)
    targets = g.blocks("trait").select(F.col("block_id").alias("dst"))
    return R.reverse_related(g.relation, targets, "implements")


@query("""select h.src, i.dst from relation h join relation i on i.src = h.dst and i.relation = 'implements' where h.relation = 'has_impl'
union all select src, dst from relation where relation = 'implements'""")
def contracts_bag_union(spark, sf_dir):
    return graph(spark, sf_dir).contracts()


@query("select src, relation, array_to_string(list_sort(list(distinct dst)), ',') as dsts from relation group by src, relation")
def relations_grouped(spark, sf_dir):
    out = R.relations_from(graph(spark, sf_dir).relation)
    return out.select("src", "relation", F.array_join(F.col("dsts").cast("array<string>"), ",").alias("dsts"))


@query("select distinct src, dst from relation where relation in ('calls', 'uses', 'implements')")
def related_blocks(spark, sf_dir):
    return R.related_blocks(graph(spark, sf_dir).relation, ["calls", "uses", "implements"])


@query("select r.src, r.dst from relation r join block b on b.block_id = r.dst where r.relation = 'uses' and b.kind in ('enum', 'trait') and b.name is not null")
def related_matching(spark, sf_dir):
    return graph(spark, sf_dir).matching("uses", F.col("kind").isin("enum", "trait") & F.col("name").isNotNull())


@query("select distinct src from relation where relation = 'has_impl'")
def has_related(spark, sf_dir):
    return graph(spark, sf_dir).has_related("has_impl")


@query("select src, relation, dst from relation")
def inverse_relations(spark, sf_dir):
    return graph(spark, sf_dir).relation


@query("""select relation, cast(sum(n) as bigint) as n, count(*) as sources from (select src, relation, count(*) as n from relation group by 1, 2) group by relation
union all select null, count(*), count(distinct src) from relation""")
def relation_stats(spark, sf_dir):
    return R.stats(graph(spark, sf_dir).relation)


@query("""select relation, cast(sum(n) as bigint) as n from (select src % 2 as half, relation, count(*) as n from relation where not (relation in ('calls', 'called_by')) and src % 8 <> 1 and dst % 8 <> 1 group by 1, 2) group by relation""")
def relation_maintenance(spark, sf_dir):
    g = graph(spark, sf_dir)
    less = R.remove(g.relation, g.relation.where("relation = 'calls'"))
    return R.remove_blocks(less, g.blocks("trait")).groupBy("relation").agg(F.count("*").alias("n"))


@query("select count(*) as blocks, count(distinct name) as names, count(distinct unit_id) as units from block")
def block_counts(spark, sf_dir):
    return graph(spark, sf_dir).counts()


@query("select block_id, kind, name from block where unit_id = 7 and kind in ('class', 'trait')")
def blocks_by_kind_in_unit(spark, sf_dir):
    return graph(spark, sf_dir).by_unit(7, "class", "trait").select("block_id", "kind", "name")


@query("select block_id, name, unit_id, start_line as source_line, symbol_kind, kind from visible")
def visible_nodes(spark, sf_dir):
    return C.nodes(graph(spark, sf_dir))


@query("select block_id, kind from nominal")
def nominal_nodes(spark, sf_dir):
    return graph(spark, sf_dir).nominal().select("block_id", "kind")


@query("select block_id, case when name is null or name = '' then kind || ':' || block_id else name end as shown from block")
def display_names(spark, sf_dir):
    return graph(spark, sf_dir).block.select("block_id", T.display_name(F.col("name"), F.col("kind"), F.col("block_id")).alias("shown"))


# edges

_SIMPLE = """
simple as (
  select src as collector, src as from_id, dst as to_id, 'call' as kind from relation where relation = 'calls'
  union select p.src, t.dst, p.src, 'param' from relation p join relation t on t.src = p.dst and t.relation = 'type_of' where p.relation = 'has_parameters'
  union select p.src, p.src, t.dst, 'return' from relation p join relation t on t.src = p.dst and t.relation = 'type_of' where p.relation = 'has_return'
  union select h.src, i.dst, h.src, 'conformance' from relation h join relation i on i.src = h.dst and i.relation = 'implements' where h.relation = 'has_impl'
  union select src, dst, src, 'conformance' from relation where relation = 'implements'
  union select src, dst, src, 'specialization' from relation where relation = 'extends'),
shown as (select * from simple where from_id <> to_id and from_id in (select block_id from visible) and to_id in (select block_id from visible)),
events as (
  select r.src as owner, t.dst as type_id, t.src * 2 as moment, false as removal from relation r join relation t on t.src = r.dst and t.relation = 'type_of' where r.relation = 'has_field'
  union all select r.src, f.type_ref, f.block_id * 2 + 1, true from relation r join block f on f.block_id = r.dst and f.kind = 'field' where r.relation = 'has_field' and list_contains(f.nested_types, f.type_ref)),
last as (select owner, type_id, arg_max(removal, moment) as removal from events where owner in (select block_id from visible) group by all),
args as (select r.src as owner, f.type_ref as type_id, unnest(f.nested_types) as arg, list_contains(f.nested_types, f.type_ref) as inside from relation r join block f on f.block_id = r.dst and f.kind = 'field' where r.relation = 'has_field'),
fields as (
  select owner as collector, type_id as from_id, owner as to_id, 'field' as kind from last where not removal
  union select owner, arg, owner, 'nested_field' from args where inside and arg <> owner and arg in (select block_id from nominal)
  union select owner, arg, type_id, 'type_arg' from args where not inside and arg <> owner and arg <> type_id and arg in (select block_id from visible)),
base as (select * from shown union select * from fields),
deps_all as (select r.src, r.dst from relation r join nominal n on n.block_id = r.dst where r.relation = 'uses' and r.src in (select block_id from visible)),
type_dep as (select src as collector, src as from_id, dst as to_id, 'type_dep' as kind from deps_all d where src <> dst
  and not exists (select 1 from base b where b.collector = d.src and b.from_id = d.src and b.to_id = d.dst) and not exists (select 1 from base b where b.collector = d.src and b.from_id = d.dst and b.to_id = d.src)),
more as (select * from base union select * from type_dep),
impl_arg as (select block_id as collector, dep as from_id, block_id as to_id, 'impl_arg' as kind from deps d where not exists (select 1 from more m where m.collector = d.block_id and m.from_id = d.dep and m.to_id = d.block_id)),
annotation as (select src as collector, dst as from_id, src as to_id, 'annotation' as kind from relation join block b on b.block_id = dst and b.kind = 'func' where relation = 'uses' and src in (select block_id from nominal)),
every as (select * from more union select * from impl_arg union select * from annotation),
edge as (select distinct from_id, to_id, kind from every)
"""


@query("," + _SIMPLE + "select from_id, to_id, kind from edge")
def edges_visible(spark, sf_dir):
    return C.edges(graph(spark, sf_dir, deps=True))


@query("," + _SIMPLE + "select kind, cast(sum(n) as bigint) as n, cast(sum(loops) as bigint) as loops from (select collector % 2 as half, kind, count(*) as n, count(*) filter (from_id = to_id) as loops from every group by 1, 2) group by kind")
def edges_no_self(spark, sf_dir):
    edges = C.collected_edges(graph(spark, sf_dir, deps=True))
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("from_id") == F.col("to_id"), 1)).alias("loops"))


@query("," + _SIMPLE + "select collector, from_id, to_id from type_dep")
def type_dep_suppressed(spark, sf_dir):
    return C.collected_edges(graph(spark, sf_dir, deps=True)).where("kind = 'type_dep'").select("collector", "from_id", "to_id")


@query("," + _SIMPLE + "select collector, from_id, to_id, kind from fields")
def nested_field_rewrite(spark, sf_dir):
    return C.field_edges(graph(spark, sf_dir)).distinct()


@query("select src, dst from (select block_id as src, dep as dst from deps) where dst in (select block_id from nominal)")
def impl_args(spark, sf_dir):
    return graph(spark, sf_dir, deps=True).impl_args()


@query("select src, dst from relation join block b on b.block_id = dst and b.kind = 'func' where relation = 'uses' and src in (select block_id from nominal)")
def annotations(spark, sf_dir):
    return graph(spark, sf_dir).annotations()


@query("select src, dst from relation r join nominal n on n.block_id = r.dst where relation = 'uses'")
def type_deps(spark, sf_dir):
    return graph(spark, sf_dir).type_deps()


_ORIENTED = """
flags as (select distinct o_custkey * 8 as c, l_suppkey * 8 + 1 as s, l_returnflag as flag from sold),
near_edge as (select case when flag = 'A' then s else c end as from_id, case when flag = 'A' then c else s end as to_id, case flag when 'A' then 'param' when 'R' then 'return' else 'call' end as kind from flags),
oriented as (select e.*, case when k.back then to_id else from_id end as dep_from, case when k.back then from_id else to_id end as dep_to, k.from_role, k.to_role from near_edge e join edge_kind k on k.kind = e.kind)
"""


def near_edges(s: Star) -> DataFrame:
    """Customers and suppliers that trade, the edge's kind by the line's flag."""
    sold = s.lineitem.join(s.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pairs = sold.select(key("o_custkey", "customer").alias("c"), key("l_suppkey", "supplier").alias("s"), "l_returnflag").distinct()
    param = F.col("l_returnflag") == "A"
    kind = F.when(param, "param").when(F.col("l_returnflag") == "R", "return").otherwise("call")
    return pairs.select(F.when(param, F.col("s")).otherwise(F.col("c")).alias("from_id"), F.when(param, F.col("c")).otherwise(F.col("s")).alias("to_id"), kind.alias("kind"))


@query("," + _ORIENTED + "select from_id, to_id, kind, dep_from, dep_to, from_role, to_role from oriented")
def edge_orientation_labels(spark, sf_dir):
    return C.oriented(near_edges(Star(spark, sf_dir)))


@query("," + _ORIENTED + "select v.block_id, v.kind from visible v where v.block_id in (select from_id from near_edge union select to_id from near_edge)")
def orphans_removed(spark, sf_dir):
    s = Star(spark, sf_dir)
    return C.without_orphans(C.nodes(s.graph()), near_edges(s)).select("block_id", "kind")


@query("," + _ORIENTED.rstrip() + ", placed as (select block_id from visible v join unit_meta m on m.unit_id = v.unit_id where m.module_name is not null) select from_id, to_id, kind from near_edge where from_id in (select block_id from placed) and to_id in (select block_id from placed)")
def retain_subset(spark, sf_dir):
    s = Star(spark, sf_dir)
    nodes = C.nodes(s.graph())
    placed = nodes.join(s.unit_meta().where("module_name is not null").select("unit_id"), "unit_id", "left_semi")
    return C.retain(nodes, near_edges(s), placed)[1]


# roll-up

_NAMED = """
named as (select v.block_id, v.unit_id, m.package_root, m.module_root, m.module_name, coalesce(m.package_name, 'unknown') as package,
  coalesce(m.module_name, regexp_extract(m.file_path, '([^/]+)\\.[^./]*$', 1), 'unknown') as segment, m.file_path from visible v left join unit_meta m on m.unit_id = v.unit_id),
ided as (select *, 'package_' || regexp_replace(package, '[^A-Za-z0-9]', '_', 'g') as pid, 'namespace_' || regexp_replace(package, '[^A-Za-z0-9]', '_', 'g') || '_' || regexp_replace(segment, '[^A-Za-z0-9]', '_', 'g') as mid from named)
"""
_EDGE_ROLL = """select src, dst, cast(sum(n) as bigint) as weight, string_agg(kind || ':' || n, ',' order by kind) as via from
(select a.{c} as src, b.{c} as dst, o.kind, count(*) as n from oriented o join ided a on a.block_id = dep_from join ided b on b.block_id = dep_to where a.{c} <> b.{c} group by 1, 2, 3) group by src, dst"""


def _named(s: Star, depth: int) -> DataFrame:
    return U.classified(C.nodes(Graph(s.block(), s.facts())), s.unit_meta(), depth)


@query("," + _ORIENTED.rstrip() + "," + _NAMED + _EDGE_ROLL.format(c="pid"))
def component_package(spark, sf_dir):
    s = Star(spark, sf_dir)
    return U.component_edges(_named(s, 1), near_edges(s))


@query("," + _ORIENTED.rstrip() + "," + _NAMED + _EDGE_ROLL.format(c="mid"))
def component_module(spark, sf_dir):
    s = Star(spark, sf_dir)
    return U.component_edges(_named(s, 2), near_edges(s))


@query("," + _NAMED + """select mid as component_id, arg_min(package || '::' || segment, (unit_id, block_id)) as label, count(*) as nodes,
arg_min(case when module_name is not null then coalesce(module_root, regexp_extract(file_path, '^(.*)/[^/]*$', 1)) else regexp_extract(file_path, '^(.*)/[^/]*$', 1) end, (unit_id, block_id)) as folder from ided group by mid""")
def component_attributes(spark, sf_dir):
    return U.components(_named(Star(spark, sf_dir), 2)).select("component_id", "label", "nodes", "folder")


@query("select component_id, 0 as edges from (select 'project' as component_id)")
def component_project(spark, sf_dir):
    s = Star(spark, sf_dir)
    named = _named(s, 0)
    return U.components(named).select("component_id").join(U.component_edges(named, near_edges(s)).groupBy(F.col("src").alias("component_id")).agg(F.count("*").cast("int").alias("edges")), "component_id", "left").select("component_id", F.coalesce("edges", F.lit(0)).alias("edges"))


@query("""select package_name, module_name, nodes, level from (select p, package_name, module_name, count(*) as nodes, grouping(p, package_name, module_name) as level from
(select case when m.unit_id is not null then 'world' end as p, m.package_name, m.module_name from visible v left join unit_meta m on m.unit_id = v.unit_id) x group by rollup(p, package_name, module_name)) y where level < 7""")
def component_rollup_levels(spark, sf_dir):
    s = Star(spark, sf_dir)
    out = U.level_counts(C.nodes(s.graph()), s.unit_meta()).where("level < 7")
    return out.select("package_name", "module_name", "nodes", F.col("level").cast("long").alias("level"))


# rank

_RANK_OPTIONS = K.RankOptions()


def _weights_sql(weights: dict) -> str:
    return ", ".join(f"('{k}', {w}::double)" for k, w in weights.items())


def _adjacency_sql(weights: dict) -> str:
    return f"""
weight(relation, w) as (values {_weights_sql(weights)}),
located as (select b.block_id, m.file_path from block b left join unit_meta m on m.unit_id = b.unit_id),
merged as (select r.src, r.dst, sum(case when a.file_path <> z.file_path then w.w * 0.8::double else w.w end) as w from relation r join weight w on w.relation = r.relation
  join located a on a.block_id = r.src join located z on z.block_id = r.dst where r.src <> r.dst group by 1, 2),
capped as (select * from (select *, row_number() over (partition by src order by w desc, dst) as place from merged) where place <= 150),
adjacency as materialized (select src, dst, w, w / sum(w) over (partition by src) as share from capped)"""


_TELEPORT_SQL = f"""
prior(kind, prior) as (values {_weights_sql(KIND_PRIOR)}),
teleport as materialized (select block_id, 0.88::double / count(*) over () + 0.12::double * prior / sum(prior) over () as p from block join prior on prior.kind = block.kind)"""


def _pagerank_sql(weights: dict, tag: str, rounds: int = 10) -> str:
    steps = [f"{tag}0 as materialized (select block_id, p as rank from teleport)"]
    for i in range(rounds):
        steps.append(f"""{tag}{i + 1} as materialized (select t.block_id, 0.15::double * t.p + 0.85::double * coalesce(f.got, 0) + 0.85::double * s.lost * t.p as rank from teleport t
  left join (select a.dst, sum(r.rank * a.share) as got from adj_{tag} a join {tag}{i} r on r.block_id = a.src group by a.dst) f on f.dst = t.block_id
  cross join (select coalesce(sum(rank), 0) as lost from {tag}{i} where block_id not in (select src from adj_{tag})) s)""")
    adjacency = _adjacency_sql(weights)
    for name in ("weight", "located", "merged", "capped", "adjacency"):
        adjacency = adjacency.replace(f"\n{name}(", f"\n{name}_{tag}(").replace(f"\n{name} as", f"\n{name}_{tag} as").replace(f"from {name} ", f"from {name}_{tag} ").replace(f"from {name})", f"from {name}_{tag})").replace(f"join {name} ", f"join {name}_{tag} ")
    return adjacency.replace(f"adjacency_{tag} as", f"adj_{tag} as") + ",\n" + ",\n".join(steps)


@query("," + _TELEPORT_SQL + " select block_id, round(p * 1e6, 6) as p from teleport")
def teleport_vector(spark, sf_dir):
    return K.teleport(Star(spark, sf_dir).block()).select("block_id", F.round(F.col("p") * 1e6, 6).alias("p"))


@query("," + _adjacency_sql(INFLUENCE) + " select src, dst, round(w, 6) as w, round(share, 9) as share from adjacency")
def weighted_adjacency(spark, sf_dir):
    return K.adjacency(graph(spark, sf_dir), INFLUENCE).select("src", "dst", F.round("w", 6).alias("w"), F.round("share", 9).alias("share"))


@query("," + _adjacency_sql(ORCHESTRATION) + " select src, count(*) as degree, round(sum(w), 6) as total from adjacency group by src")
def degree_cap_topn(spark, sf_dir):
    return K.adjacency(graph(spark, sf_dir), ORCHESTRATION).groupBy("src").agg(F.count("*").alias("degree"), F.round(F.sum("w"), 6).alias("total"))


@query("select src, dst, cast(count(*) as bigint) as parallel from relation where relation in ('calls', 'uses', 'implements', 'type_of') and src <> dst group by 1, 2 having count(*) > 1")
def parallel_edge_merge(spark, sf_dir):
    rel = graph(spark, sf_dir).relation.where(F.col("relation").isin(*INFLUENCE) & (F.col("src") != F.col("dst")))
    return rel.groupBy("src", "dst").agg(F.count("*").alias("parallel")).where("parallel > 1")


@query("," + _TELEPORT_SQL + "," + _pagerank_sql(INFLUENCE, "i") + " select block_id, round(rank, 9) as rank from i10")
def pagerank_influence_10(spark, sf_dir):
    return K.pagerank(graph(spark, sf_dir), INFLUENCE, iterations=10).select("block_id", F.round("rank", 9).alias("rank"))


@query("," + _TELEPORT_SQL + "," + _pagerank_sql(ORCHESTRATION, "o") + " select block_id, round(rank, 9) as rank from o10")
def pagerank_orchestration_10(spark, sf_dir):
    return K.pagerank(graph(spark, sf_dir), ORCHESTRATION, iterations=10).select("block_id", F.round("rank", 9).alias("rank"))


@query("," + _TELEPORT_SQL + "," + _pagerank_sql(INFLUENCE, "i") + "," + _pagerank_sql(ORCHESTRATION, "o") + " select block_id, round(0.25 * i10.rank + 0.75 * o10.rank, 9) as score from i10 join o10 using (block_id)")
def pagerank_blend_10(spark, sf_dir):
    return K.scores(graph(spark, sf_dir), iterations=10).select("block_id", F.round("score", 9).alias("score"))


_CUSTOMER_ROWS = "select c_custkey * 8 as block_id, c_nationkey::bigint as unit_id, c_acctbal as score, coalesce(package_name, '<unknown_package>') || '::' || coalesce(module_name, '<root>') as module from customer join unit_meta on unit_id = c_nationkey"


def _customer_rows(s: Star) -> DataFrame:
    rows = s.customer.select(key("c_custkey", "customer").alias("block_id"), F.col("c_nationkey").cast("long").alias("unit_id"), F.col("c_acctbal").alias("score"))
    return K.modules_of(rows, s.unit_meta())


@query("select block_id, score, row_number() over (order by score desc, unit_id, block_id) as rank from (select c_custkey * 8 as block_id, c_nationkey as unit_id, c_acctbal as score from customer) order by rank limit 100")
def rank_top_k(spark, sf_dir):
    s = Star(spark, sf_dir)
    best = K.top(Graph(s.block(), s.facts()), _customer_rows(s).select("block_id", "score"), 100)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "unit_id", "block_id")).cast("long")).select("block_id", "score", "rank")


@query(f""", scored as ({_CUSTOMER_ROWS}),
mods as (select module, row_number() over (order by sum(score) desc, module) as place from scored group by module),
inside as (select s.*, m.place, row_number() over (partition by s.module order by score desc, unit_id, block_id) as n from scored s join mods m on m.module = s.module),
covered as (select * from inside where n <= 2 order by place, n limit 120),
fill as (select * from scored where block_id not in (select block_id from covered) order by score desc, unit_id, block_id limit (300 - (select count(*) from covered)))
select block_id from covered union all select block_id from fill""")
def topk_with_coverage(spark, sf_dir):
    return K.top_with_coverage(_customer_rows(Star(spark, sf_dir)), 300)


@query(f"select module, round(sum(score), 4) as total from ({_CUSTOMER_ROWS}) group by module")
def module_score(spark, sf_dir):
    return _customer_rows(Star(spark, sf_dir)).groupBy("module").agg(F.round(F.sum("score"), 4).alias("total"))


# resolution

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("""select ref_id, symbol_id from (select p_partkey as ref_id, s_suppkey as symbol_id, row_number() over (partition by p_partkey order by (s_nationkey = rn.n_nationkey) desc, (sn.n_regionkey = rn.n_regionkey) desc, s_suppkey desc) as place
from part join nation rn on rn.n_nationkey = p_partkey % 25 join (select distinct l_partkey, l_suppkey from lineitem) on l_partkey = p_partkey join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey) where place = 1""", star=False)
def ambiguity_precedence(spark, sf_dir):
    s = Star(spark, sf_dir)
    refs = s.part.withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int")).join(s.nation, "n_nationkey").select(F.col("p_partkey").alias("l_partkey"), F.col("n_nationkey").alias("ref_unit"), F.col("n_regionkey").alias("ref_package"))
    seen = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    found = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("unit_id"), F.col("n_regionkey").alias("package_index"))
    rows = refs.join(seen, "l_partkey").join(found, "l_suppkey").select(F.col("l_partkey").alias("ref_id"), F.col("l_suppkey").alias("symbol_id"), F.col("l_suppkey").alias("ordinal"), "unit_id", "package_index", "ref_unit", "ref_package")
    return N.by_precedence(rows)


def _declared(s: Star) -> tuple[DataFrame, DataFrame]:
    """Suppliers as symbols: a third each is declared in its nation, its region and globally; names are market segments."""
    name = F.element_at(F.array(*[F.lit(x) for x in _SEGMENTS]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    scope = F.when(F.col("s_suppkey") % 3 == 0, F.col("n_nationkey") * 10 + 1).when(F.col("s_suppkey") % 3 == 1, F.col("n_regionkey") * 10 + 2).otherwise(3)
    symbols = rows.select(F.col("s_suppkey").alias("symbol_id"), F.when(F.col("s_suppkey") % 2 == 0, "struct").otherwise("method").alias("kind"), F.col("s_nationkey").cast("long").alias("unit_id"), F.col("n_regionkey").cast("long").alias("package_index"), F.lit(None).cast("long").alias("owned_scope_id"))
    return symbols, rows.select(scope.cast("long").alias("scope_id"), name.alias("name"), F.col("s_suppkey").alias("symbol_id"), F.col("s_suppkey").alias("ordinal"))


_DECLARED = f"""
segment(i, name) as (values {', '.join(f"({i}, '{x}')" for i, x in enumerate(_SEGMENTS))}),
declared as (select s_suppkey, segment.name, s_nationkey, n_regionkey, case when s_suppkey % 3 = 0 then n_nationkey * 10 + 1 when s_suppkey % 3 = 1 then n_regionkey * 10 + 2 else 3 end as scope_id from supplier join nation on n_nationkey = s_nationkey join segment on i = s_suppkey % 5)
"""


@query("," + _DECLARED + """, hits as (select c_custkey as ref_id, s_suppkey as symbol_id, d.s_nationkey = c_nationkey as same_unit, d.n_regionkey = n.n_regionkey as same_package,
  case d.scope_id when c_nationkey * 10 + 1 then 0 when n.n_regionkey * 10 + 2 then 1 else 2 end as depth
  from customer join nation n on n.n_nationkey = c_nationkey join declared d on d.name = c_mktsegment and d.scope_id in (c_nationkey * 10 + 1, n.n_regionkey * 10 + 2, 3) where s_suppkey % 2 = 0)
select ref_id, symbol_id from (select *, row_number() over (partition by ref_id order by depth, same_unit desc, same_package desc, symbol_id desc) as place from hits) where place = 1""")
def lexical_shadowing(spark, sf_dir):
    s = Star(spark, sf_dir)
    symbols, scope_symbol = _declared(s)
    up = s.nation.select((F.col("n_nationkey") * 10 + 1).cast("long").alias("scope_id"), (F.col("n_regionkey") * 10 + 2).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"))
    up = up.unionAll(s.region.select((F.col("r_regionkey") * 10 + 2).cast("long"), F.lit(3).cast("long"), F.lit(0).cast("long")))
    refs = s.customer.join(s.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ref_id"), (F.col("c_nationkey") * 10 + 1).cast("long").alias("scope_id"), F.col("c_mktsegment").alias("name"), F.lit("types").alias("kinds"), F.col("c_nationkey").alias("ref_unit"), F.col("n_regionkey").alias("ref_package")
    )
    return N.lexical(refs, N.scope_chain(up, refs.select("scope_id")), scope_symbol, symbols)


@query("""select s_suppkey as ref_id, s_suppkey * 10 + 7 as symbol_id from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""", star=False)
def qualified_path(spark, sf_dir):
    s = Star(spark, sf_dir)
    none, world = F.lit(None).cast("long"), F.lit(3).cast("long")
    sid = lambda c, t: (F.col(c).cast("long") * 10 + t)
    names = (
        s.region.select(world.alias("scope_id"), F.col("r_name").alias("name"), sid("r_regionkey", 5).alias("symbol_id"), F.lit(0).cast("long").alias("ordinal"), F.lit("module").alias("kind"), sid("r_regionkey", 2).alias("owned_scope_id"))
        .unionAll(s.nation.select(sid("n_regionkey", 2), "n_name", sid("n_nationkey", 6), F.lit(0).cast("long"), F.lit("module"), sid("n_nationkey", 1)))
        .unionAll(s.supplier.select(sid("s_nationkey", 1), "s_name", sid("s_suppkey", 7), F.lit(0).cast("long"), F.lit("struct"), none))
    )
    symbols = names.select("symbol_id", "kind", F.lit(0).cast("long").alias("unit_id"), F.lit(0).cast("long").alias("package_index"), "owned_scope_id")
    refs = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(s.region, F.col("n_regionkey") == F.col("r_regionkey"))
    refs = refs.select(F.col("s_suppkey").alias("ref_id"), sid("s_nationkey", 1).alias("scope_id"), F.array("r_name", "n_name", "s_name").alias("parts"), F.lit("types").alias("kinds"), F.lit(0).alias("ref_unit"), F.lit(0).alias("ref_package"))
    chain = refs.select("scope_id", F.col("scope_id").alias("ancestor_id"), F.lit(0).alias("depth")).distinct()
    return N.qualified(refs, chain, 3, names, symbols)


@query("""with recursive hop as (select p_partkey as id, p_partkey as here from part union all select h.id, n.p_partkey from hop h join part p on p.p_partkey = h.here and p.p_partkey % 4 <> 0 join part n on n.p_partkey = h.here + 1)
select id as symbol_id, max(here) as target_id from hop group by id""", star=False)
def alias_chase(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    alias = F.col("p_partkey") % 4 != 0
    return N.chase(part.select(F.col("p_partkey").alias("symbol_id"), F.when(alias, "type_alias").otherwise("struct").alias("kind"), F.when(alias, F.col("p_partkey") + 1).alias("type_of")))


@query("""with recursive items as (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag),
n as (select l_orderkey * 8 + l_linenumber as id, l_orderkey, l_linenumber, l_partkey from items where l_returnflag = 'N'),
reach as (select l_orderkey as owner, id as field_id, id as here from n where l_linenumber <= 2 union select r.owner, r.field_id, b.id from reach r join n a on a.id = r.here join n b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1)
select distinct -owner as owner, field_id, l_partkey as type_id from reach join n on n.id = reach.here""", star=False)
def field_closure(spark, sf_dir):
    """Lines of kind field nest the next line of their order; orders (negative ids) own the first two."""
    line = Star(spark, sf_dir).lineitem.where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    nested = line.select(F.col("id").alias("src"), "l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber")).join(line.select("l_orderkey", "l_linenumber", F.col("id").alias("dst")), ["l_orderkey", "l_linenumber"])
    rel = line.where("l_linenumber <= 2").select((-F.col("l_orderkey")).alias("src"), F.lit("has_field").alias("relation"), F.col("id").alias("dst"))
    rel = rel.unionAll(nested.select("src", F.lit("has_field").alias("relation"), "dst")).unionAll(line.select(F.col("id").alias("src"), F.lit("type_of").alias("relation"), F.col("l_partkey").alias("dst")))
    return Graph(line, rel).field_types().where("owner < 0")


@query("," + _DECLARED + """, calls as (select c_custkey, c_mktsegment, n_name as a, case when c_custkey % 3 = 0 then 'A' else 'B' end as b from customer join nation on n_nationkey = c_nationkey),
scores as (select c_custkey, s_suppkey, (n_name = a)::int + (case when s_suppkey % 2 = 0 then 'A' else 'B' end = b)::int as score from calls join declared d on d.name = c_mktsegment join nation n on n.n_nationkey = d.s_nationkey),
best as (select *, max(score) over (partition by c_custkey) as top, count(*) over (partition by c_custkey) as n from scores)
select c_custkey as call_id, min(s_suppkey) as symbol_id from best where score = top group by c_custkey having count(*) = 1 and (min(score) > 0 or min(n) = 1)""")
def overload_rank(spark, sf_dir):
    s = Star(spark, sf_dir)
    _, names = _declared(s)
    two = lambda c, n: F.when(F.col(c) % n == 0, "A").otherwise("B")
    calls = s.customer.join(s.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("call_id"), F.col("c_mktsegment").alias("name"), F.array("n_name", two("c_custkey", 3)).alias("types"))
    own = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol_id"), F.array("n_name", two("s_suppkey", 2)).alias("types"))
    return N.overloads(calls, own.join(names.select("symbol_id", "name"), "symbol_id"))


@query("""select user_id as scope_id, event_type as name, min(event_id) as symbol_id, coalesce(arg_min(case when value < 20 then null when value < 60 then 'struct' else 'function' end, event_id) filter (value >= 20), 'unknown') as declared_kind
from events group by user_id, event_type""", star=False)
def symbol_dedupe(spark, sf_dir):
    kind = F.when(F.col("value") < 20, "unknown").when(F.col("value") < 60, "struct").otherwise("function")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("scope_id"), F.col("event_type").alias("name"), kind.alias("kind"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("symbol_id"))
    return N.declare(rows).select("scope_id", "name", "symbol_id", "declared_kind")


@query("""with new as (select c_custkey, c_nationkey, 'new' as state from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_mktsegment = 'BUILDING' and r_name = 'ASIA')
select c_custkey, c_nationkey, 'old' as state from customer where c_nationkey not in (select c_nationkey from new) union all select * from new""", star=False)
def unit_upsert(spark, sf_dir):
    s = Star(spark, sf_dir)
    asia = s.nation.join(s.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    new = s.customer.where("c_mktsegment = 'BUILDING'").join(asia, "c_nationkey", "left_semi")
    rows = lambda df, state: df.select("c_custkey", "c_nationkey", F.lit(state).alias("state"))
    return R.replace_units(rows(s.customer, "old"), rows(new, "new"), "c_nationkey")


@query(f"select k as kind, s as set_name from (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{s}{chr(39)})' for s, ks in KIND_SETS.items() if s != 'all' for k in ks)}) t(k, s)", star=False)
def symbol_kind_sets(spark, sf_dir):
    kinds = R.literal_table(spark, [(k,) for k in KIND_SETS["all"]], "kind string")
    sets = R.literal_table(spark, [(s,) for s in KIND_SETS if s != "all"], "set_name string")
    return kinds.join(F.broadcast(sets), N.in_set(F.col("kind"), F.col("set_name"))).select("kind", "set_name")


# hierarchy and text

_FILES = "files as (select page_id as unit_id, regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', '') as path from pages where url is not null)"


def _files(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("url is not null")
    return pages.select(F.col("page_id").alias("unit_id"), F.regexp_replace(F.regexp_replace("url", "^[A-Za-z]+://", ""), "[?#].*$", "").alias("path"))


def _roots(files: DataFrame) -> DataFrame:
    two = files.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("host"), F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("deep"))
    return two.select(F.explode(F.array(F.col("host"), F.when(F.col("deep").rlike("/(en|fr)$"), F.col("deep")))).alias("package_root")).where("package_root is not null and package_root <> ''").distinct()


_ROOTS = "roots as (select distinct package_root from (select regexp_extract(path, '^([^/]+)/', 1) as package_root from files union all select regexp_extract(path, '^([^/]+/(en|fr))/', 1) from files) where package_root <> '')"


@query(f"with {_FILES}, {_ROOTS} select unit_id, path, arg_max(package_root, length(package_root)) as package_root from files left join roots on path like package_root || '/%' group by unit_id, path".replace("arg_max(package_root, length(package_root))", "arg_max(package_root, length(package_root))"), star=False)
def longest_prefix_owner(spark, sf_dir):
    files = _files(spark, sf_dir)
    return M.owners(files, _roots(files)).select("unit_id", "path", "package_root")


@query(f"""with {_FILES}, owned as (select unit_id, regexp_extract(path, '^([^/]+)/', 1) as package_root, string_split(regexp_extract(path, '^[^/]+/(.*)/[^/]*$', 1), '/') as physical from files where path like '%/%'),
named as (select *, list_filter(physical, lambda x: x not in ('', 'es')) as names, list_filter(range(1, len(physical) + 1), lambda i: physical[i] not in ('', 'es')) as places from owned),
total as (select package_root, count(*) as files from owned group by 1),
steps as (select unit_id, package_root, names, unnest(range(1, len(names) + 1)) as d from named),
placed as (select unit_id, package_root, d, names[d] as name, array_to_string(names[1:d - 1], '/') as above from steps),
here as (select package_root, above, name, count(*) as here from placed group by all),
beside as (select *, sum(here) over (partition by package_root, above) - here as siblings from here),
good as (select unit_id, min(d) filter (siblings >= floor(greatest(files * 0.05, 1)) and here / (here + siblings) <= 0.8) as d from placed join beside using (package_root, above, name) join total using (package_root) group by unit_id),
pick as (select n.*, coalesce(g.d, 1) as d from named n join good g using (unit_id))
select n.unit_id, p.names[p.d] as module_name, n.package_root || '/' || array_to_string(p.physical[1:p.places[p.d]], '/') as module_root from named n left join pick p using (unit_id)""", star=False)
def module_boundary(spark, sf_dir):
    files = _files(spark, sf_dir).where("path like '%/%'").withColumn("package_root", F.regexp_extract("path", "^([^/]+)/", 1))
    return M.modules(files, ("es",)).select("unit_id", "module_name", "module_root")


@query(f"""with {_FILES}, dirs as (select unit_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from files where path like '%/%'),
up as (select unit_id, array_to_string(string_split(dir, '/')[1:i], '/') as prefix from dirs, unnest(range(1, len(string_split(dir, '/')) + 1)) as t(i))
select prefix, count(*) as files from up where prefix <> '' group by prefix""", star=False)
def directory_file_counts(spark, sf_dir):
    return _files(spark, sf_dir).select(F.explode(T.ancestors(F.col("path"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("files"))


@query(f"""with {_FILES} select unit_id, regexp_extract(path, '([^/]*)$', 1) as name, case when path like '%/%' then regexp_extract(path, '^(.*)/[^/]*$', 1) end as parent,
nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1), '') as ext,
case when regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^.+\\.[^.]*$') then regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', 1) else regexp_extract(path, '([^/]*)$', 1) end as stem from files""", star=False)
def path_parts(spark, sf_dir):
    p = F.col("path")
    return _files(spark, sf_dir).select("unit_id", T.file_name(p).alias("name"), T.parent_dir(p).alias("parent"), T.extension(p).alias("ext"), T.file_stem(p).alias("stem"))


@query("select page_id, regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') as id from pages", star=False)
def sanitize_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_id(F.col("url")).alias("id"))


@query("select event_id, props->>'$.k' as k from events", star=False)
def json_name(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) as children from lineitem group by l_orderkey", star=False)
def array_children_ordered(spark, sf_dir):
    kids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(kids, ",").alias("children"))


@query("select n_nationkey, r_name || '.' || n_name as qualified from nation join region on r_regionkey = n_regionkey", star=False)
def qualified_names(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.nation.join(s.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", T.qualified_name(F.col("r_name"), F.lit(None).cast("string"), F.col("n_name")).alias("qualified"))


@query("""select unit_id, dense_rank() over (order by first) - 1 as package_index from (select c_custkey as unit_id, min(c_custkey) over (partition by c_nationkey) as first from customer)""", star=False)
def package_index(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").cast("string").alias("package_root"))
    return M.package_index(rows).select("unit_id", "package_index")


@query("""select l_orderkey * 8 + l_linenumber as block_id, case when l_returnflag = 'N' then cast(row_number() over (partition by l_orderkey, l_returnflag = 'N' order by l_linenumber) - 1 as varchar) else l_returnflag end as name from lineitem""", star=False)
def positional_names(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("block_id"), F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("ordinal"), F.lit("field").alias("kind"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("name"))
    return B.positional_names(rows).select("block_id", "name")


@query("select owner, member, b.kind as member_kind from (select parent_id as owner, block_id as member from block) m join block b on b.block_id = m.member join block o on o.block_id = m.owner where o.kind = 'func' and b.kind in ('parameter', 'return')")
def member_attachment(spark, sf_dir):
    return B.members(Star(spark, sf_dir).block()).where("owner_kind = 'func'").select("owner", "member", "member_kind")


@query("select block_id, block_id in (select parent_id from block where parent_id is not null) as is_inline from block where kind = 'module'")
def inline_modules(spark, sf_dir):
    return B.inline_modules(Star(spark, sf_dir).block())


@query("""select unit_id, file_path || ':' || unit_id as location, coalesce(package_name, '<unknown_package>') || '::' || coalesce(module_name, '<root>') as module_key from unit_meta""")
def node_columns(spark, sf_dir):
    meta = Star(spark, sf_dir).unit_meta()
    return meta.select("unit_id", T.location(F.col("file_path"), F.col("unit_id")).alias("location"), T.module_key(F.col("package_name"), F.col("module_name")).alias("module_key"))


for more in (generated, names):
    QUERIES |= more.QUERIES
    ORACLES |= more.ORACLES
ORACLES["pagerank_joins_10"] = ORACLES["pagerank_influence_10"]

HEADLINE = (
    "related_one_hop", "related_two_hop_types", "contracts_bag_union", "relation_stats", "edges_visible", "type_dep_suppressed", "component_package", "component_module", "weighted_adjacency", "pagerank_influence_10",
    "topk_with_coverage", "ambiguity_precedence", "lexical_shadowing", "qualified_path", "alias_chase", "longest_prefix_owner", "symbol_dedupe", "array_children_ordered",
    "source_calls",
)
