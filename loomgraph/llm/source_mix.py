"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of the whole
table; a target stops at `cap` times its source's words and the excess is shared again by weight (water filling,
solved in closed form over the sorted caps).

Sampling: the whole part of target over source words is certain for every document of the source, as whole copies. The words
that are left, `rest`, are sampled with unequal probabilities: a document's inclusion probability is
min(1, pull * size), proportional to its words, with the source's `pull` such that the expected words are `rest` (solved in closed form over
the source's distinct sizes; documents of probability 1 are certain copies too). Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and taken in that order until `rest` is filled, the sample size being fixed in
words. The last document is taken if that comes nearer. u is a digest of id and text, so reruns agree.

The cut is found without ordering a whole source: two rounds of 4096-cell sums narrow it to one cell, whose rows are
then ranked. Documents that tie (equal id and text) at the cut share what is left evenly, in words.

A null text has size 0, a null source is a source of its own, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORDS = "[^\\x20\\x09-\\x0D]+"
CAP = 3
WEIGHTS = (1, 2, 3)
CELLS = 4096


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "") -> DataFrame:
    """(doc_id, source, size long, u double in (0, 1)); another `seed` gives other u."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text), F.lit(seed)))
    u = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("u"))


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`sizes(source, size)` per row -> one row a source: source, source_size, target, copies (certain), rest (words), pull.

    The windows without a partition run over one row a source, that of a source over its distinct sizes.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights)) + 1).cast("long")).withColumn("top", F.col("source_size") * cap)
    by_cap = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("top").over(below), F.lit(0))) / (F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(below), F.lit(0)))
    # the level rises while a source below its fair share is capped, and falls after: the highest one balances
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    target = F.least(F.col("top").cast("double"), F.col("level") * F.col("w"))
    size = F.col("source_size")
    per = per.withColumn("target", target).withColumn("copies", F.when(size > 0, F.least(F.lit(cap), F.floor(F.try_divide(F.col("target"), size)))).otherwise(0).cast("long"))
    per = per.withColumn("rest", F.col("target") - F.col("copies") * size)
    return per.join(_pulls(sizes, per), F.col("source").eqNullSafe(F.col("key")), "left").select(per["source"], "source_size", "target", "copies", "rest", "pull")


def _pulls(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """(key, pull): with the k largest sizes certain, the others' words must fill what is left; the highest such pull is the one."""
    counts = sizes.groupBy("source", "size").agg(F.count("*").alias("n")).where("size > 0")
    exact = lambda c: c.cast("decimal(38,0)")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    above = F.sum(exact(F.col("size")) * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1))
    squares = F.sum(exact(F.col("size")) * F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("size"))
    counts = counts.select("source", F.coalesce(above, F.lit(0)).cast("double").alias("above"), squares.cast("double").alias("squares"))
    goal = per.select(F.col("source").alias("key"), "rest")
    both = counts.join(goal, counts["source"].eqNullSafe(goal["key"]))
    return both.groupBy("key").agg(F.max((F.col("rest") - F.col("above")) / F.col("squares")).alias("pull"))


def _ranked(rows: DataFrame) -> DataFrame:
    """z in [0, 1] orders as the random odds over the inclusion odds do."""
    p = F.least(F.lit(1.0), F.col("pull") * F.col("size"))
    up, down = F.col("u") * (1 - p), p * (1 - F.col("u"))
    return rows.withColumn("z", up / (up + down))


def _same(a: DataFrame, b: DataFrame, *names: str):
    out = a["source"].eqNullSafe(b["source"])
    for n in names:
        out = out & (a[n] == b[n])
    return out


def _narrow(rows: DataFrame, name: str) -> DataFrame:
    """Sum cells `cell`, find the one per source in which the words reach `rest`; (source, cell, before)."""
    sums = rows.groupBy("source", "rest", "cell").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    hit = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    return materialize(hit.select("source", "cell", (F.col("upto") - F.col("words")).alias("before")), name)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) for every document."""
    rows = materialize(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    goal = materialize(targets(rows, cap, weights), "mix-targets")
    live = goal.where("rest > 0 and pull > 0")
    near = _ranked(rows.join(live, _same(rows, live)).select(rows["source"], "size", "u", "rest", "pull"))
    cell = lambda x: F.least(F.floor(x), F.lit(CELLS - 1)).cast("long")
    near = near.withColumn("cell", cell(F.col("z") * CELLS))
    one = _narrow(near, "mix-cell1")
    within = near.join(one, _same(near, one, "cell")).select(near["source"], "size", "z", (near["rest"] - one["before"]).alias("rest"), one["before"].alias("had"), near["cell"].alias("outer"))
    within = within.withColumn("cell", cell((F.col("z") * CELLS - F.col("outer")) * CELLS))
    two = _narrow(within, "mix-cell2")
    last = within.join(two, _same(within, two, "cell")).select(within["source"], "size", "z", (within["rest"] - two["before"]).alias("rest"))
    ties = last.groupBy("source", "rest", "z").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("z"))
    ties = ties.withColumn("left", F.col("rest") - (upto - F.col("words"))).where((F.col("left") > 0) & (F.col("left") <= F.col("words")))
    part = F.when(F.col("n") > 1, F.try_divide(F.col("left"), F.col("words"))).when(F.col("left") * 2 >= F.col("words"), 1.0).otherwise(0.0)
    cut = materialize(ties.select("source", F.col("z").alias("cut"), part.alias("part")), "mix-cut")
    plan = materialize(goal.join(cut, _same(goal, cut), "left").select(goal["source"], "source_size", "target", "copies", "pull", "cut", "part"), "mix-plan")
    out = _ranked(rows.join(plan, _same(rows, plan)).select("doc_id", rows["source"], "size", "u", "source_size", "target", "copies", "pull", "cut", "part"))
    extra = F.when(F.col("z") < F.col("cut"), F.col("size")).when(F.col("z") == F.col("cut"), F.floor(F.col("size") * F.col("part"))).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long").alias("taken"))


def mix_sql(docs: str = "documents") -> str:
    """The same rows in DuckDB, by ordering each source outright."""
    return f"""
with rows as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double as u from {docs}),
per as (select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by source asc nulls last) - 1) % {len(WEIGHTS)} as w from rows group by source),
caps as (select *, {CAP} * source_size as cap from per),
levels as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(sum(w) over () - coalesce(sum(w) over (order by cap::double / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as double) as level from caps),
goal as (select source, source_size, least(cap::double, (select max(level) from levels) * w) as target from levels),
plan as (select *, case when source_size > 0 then least({CAP}, cast(floor(target / source_size) as bigint)) else 0 end as copies from goal),
plan2 as (select *, target - copies * source_size as rest from plan),
counts as (select source, size, count(*) as n from rows where size > 0 group by source, size),
sums as (select source, cast(coalesce(sum(size * n) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0) as double) as above,
    cast(sum(size * size * n) over (partition by source order by size) as double) as squares from counts),
pulls as (select s.source, max((p.rest - s.above) / s.squares) as pull from sums s join plan2 p on s.source is not distinct from p.source group by s.source),
odds as (select r.doc_id, r.source, r.size, r.u, p.source_size, p.target, p.copies, p.rest, case when p.rest > 0 and q.pull > 0 then least(1.0::double, q.pull * r.size) end as pi
    from rows r join plan2 p on r.source is not distinct from p.source left join pulls q on r.source is not distinct from q.source),
ranked as (select *, (u * (1 - pi)) / (u * (1 - pi) + pi * (1 - u)) as z from odds),
ties as (select source, rest, z, sum(size) as words, count(*) as n from ranked where z is not null group by source, rest, z),
upto as (select *, sum(words) over (partition by source order by z) as upto from ties),
cut as (select source, z as cut, case when n > 1 then (rest - (upto - words)) / words when (rest - (upto - words)) * 2 >= words then 1.0::double else 0.0::double end as part
    from upto where rest - (upto - words) > 0 and rest - (upto - words) <= words)
select doc_id, size, source_size, target, cast(copies * size + coalesce(case when z < cut then size when z = cut then floor(size * part) else 0 end, 0) as bigint) as taken
from ranked left join cut on ranked.source is not distinct from cut.source"""
