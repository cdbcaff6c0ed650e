"""Exact top-k inner-product search: columnar branch and bound.

Vectors are stored dimension by dimension. A query adds up its score block of dimensions by block; after each
block the candidates whose score so far plus the largest possible rest (the product of the remaining masses,
by Cauchy-Schwarz) falls below the k-th best are compacted away. The first bounds come from a few vectors that the driver has compared
with all queries of a pass.

Queries are taken in passes of at most `queries_per_pass` vectors, a bounded broadcast; each pass is a job of its own whose result is written. Each task holds a block
of candidates, keeps its own best for every query, and a ranked window merges the tasks' lists.

Vectors that are null or hold a null or non-finite component, and rows with a null vec_id, take no part. Components are integers: floor(scale * x), whatever their size
(beyond 1.7e308 the largest double counts). Where sums could pass 2**62 they are taken in exact integers; they order by up to 38 digits, and the column
score holds the nearest long. Every query row has its own list, repeated rows too, and every row but the query's own is a candidate: of rows that are equal to the
query's one is left out. Ties go to the smaller vec_id. Vectors of different length are compared over the shorter one; an empty vector scores 0 with all. Without queries or vectors there are no rows.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table, work_dir

TOP_K = 20
SCALE = 64
BLOCK_DIMS = 16
CANDIDATE_BLOCK = 8192
QUERIES_PER_PASS = 16384
SEEDS = 2048
WIDE = float(2**24)  # rows with a component from here on are scored in exact integers
_SCHEMA = "qid long, vec_id long, score decimal(38,0)"
_MOST = 10**38 - 1


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id long, v array<double>, whole numbers) of the rows that take part."""
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    most = 1.7e308
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), x)))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine))
        .select("vec_id", F.transform("v", lambda x: whole(x * scale)).alias("v"))
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows padded with zeros to `dims` (or cut to it: a product with zeros adds nothing)."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    if len(sizes) and (sizes == dims).all():
        return flat[ends[0] : ends[-1]].reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        b = min(b, a + dims)
        out[i, : b - a] = flat[a:b]
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, best: list, block: int = BLOCK_DIMS, seeds: np.ndarray | None = None) -> None:
    """Merge one candidate block into `best`: per query a pair (scores, ids), best first, ties to the smaller id; `seeds`: k others reach that score.

    Exact as long as no sum passes 2**62.
    """
    dims = q.shape[1]
    exact = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(c).max(initial=0))) * max(1, dims) < 2**52
    kind = np.float64 if exact else np.int64
    cuts = list(range(0, dims, block)) + [dims]
    cols = np.ascontiguousarray(c.T).astype(kind)  # vertical layout: one row per dimension
    qk = q.astype(kind)
    mass = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    c_mass = np.vstack([mass(cols), np.zeros((1, cols.shape[1]))]) if dims else np.zeros((1, cols.shape[1]))
    q_mass = np.vstack([mass(qk.T), np.zeros((1, len(q)))]) if dims else np.zeros((1, len(q)))
    first = cuts[1] if len(cuts) > 1 else 0
    for lo in range(0, len(q), 256):  # the first block of dimensions for many queries at once
        start = qk[lo : lo + 256, :first] @ cols[:first]
        for row in range(start.shape[0]):
            i = lo + row
            have_s, have_i = best[i]
            floor = have_s[k - 1] if len(have_s) >= k else None
            if seeds is not None and (floor is None or seeds[i] > floor):
                floor = seeds[i]
            part, alive, at = start[row], None, first
            for nxt in [*cuts[2:], None]:
                if floor is not None:
                    rest = c_mass[at] if alive is None else c_mass[at][alive]
                    keep = part + q_mass[at, i] * rest * (1 + 1e-9) >= floor - 0.5
                    if not keep.all():
                        alive = np.flatnonzero(keep) if alive is None else alive[keep]
                        part = part[keep]
                if nxt is None or not len(part):
                    break
                seg = cols[at:nxt] if alive is None else cols[at:nxt, alive]
                part = part + qk[i, at:nxt] @ seg
                at = nxt
            if not len(part):
                continue
            got = part.astype(np.int64)
            who = ids if alive is None else ids[alive]
            if len(got) > 4 * k:
                edge = np.partition(got, len(got) - k)[len(got) - k]
                top = got >= edge
                got, who = got[top], who[top]
            s, w = np.concatenate([have_s, got]), np.concatenate([have_i, who])
            order = np.lexsort((w, -s))[:k]
            best[i] = (s[order], w[order])


def _exact_scores(rows: np.ndarray, vector: np.ndarray) -> list[int]:
    """Inner products in integers of any size."""
    at = np.flatnonzero(vector)
    one = [int(x) for x in vector[at]]
    return [sum(int(x) * y for x, y in zip(row, one) if x) for row in rows[:, at]]


def _merge(have: list[tuple[int, int]], scores: list[int], ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Of (-score, id) the k least."""
    return sorted(have + [(-s, i) for s, i in zip(scores, ids.tolist())])[:k]


def _searcher(shared, k: int):
    """Each query's k best of a task's candidates, the query's own row among them if it is one."""

    def run(batches):
        q_ids, q, seeds = shared.value
        none = np.zeros(0, np.int64)
        wide_q = np.abs(q).max(axis=1, initial=0) >= WIDE
        plain = np.flatnonzero(~wide_q)
        best = [(none, none)] * len(plain)
        large: dict[int, list[tuple[int, int]]] = {}
        ids, rows = [], []

        def flush():
            if not ids:
                return
            who, c = np.concatenate(ids), np.concatenate(rows)
            ids.clear()
            rows.clear()
            wide_c = np.abs(c).max(axis=1, initial=0) >= WIDE
            small = ~wide_c
            search_block(q_ids[plain], q[plain], who[small], c[small], k, best, seeds=None if seeds is None else seeds[plain])
            for j in np.flatnonzero(wide_c):
                for i, s in zip(plain.tolist(), _exact_scores(q[plain], c[j])):
                    large[i] = _merge(large.get(i, []), [s], who[j : j + 1], k)
            for i in np.flatnonzero(wide_q).tolist():
                large[i] = _merge(large.get(i, []), _exact_scores(c, q[i]), who, k)

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column("vec_id").to_numpy())
            rows.append(_matrix(batch.column("v"), q.shape[1]))
            held += batch.num_rows
            if held >= CANDIDATE_BLOCK:
                flush()
                held = 0
        flush()
        kind = pa.decimal128(38, 0)
        for lo in range(0, len(plain), 4096):
            part = best[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(plain[lo : lo + 4096], [len(w) for _, w in part])), pa.array(np.concatenate([w for _, w in part])), pa.array(np.concatenate([s for s, _ in part])).cast(kind)],
                names=["qid", "vec_id", "score"],
            )
        found = [(i, w, Decimal(max(-_MOST, min(_MOST, -s)))) for i, got in large.items() for s, w in got]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], kind)], names=["qid", "vec_id", "score"])

    return run


def _seeds(q: np.ndarray, some: np.ndarray, k: int) -> np.ndarray | None:
    """Per query a score that k of the vectors `some` reach."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(some).max(initial=0)) * max(1, q.shape[1])
    if len(some) < k or bound >= 2**52:
        return None
    out = np.empty(len(q))
    for lo in range(0, len(q), 1024):
        out[lo : lo + 1024] = np.partition(q[lo : lo + 1024] @ some.T, len(some) - k, axis=1)[:, len(some) - k]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, queries_per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """`queries(vec_id, v)` against `vectors(vec_id, v)`, both from `quantized` -> query_id, rank, vec_id, score; every query is one of the vectors."""
    spark = vectors.sparkSession
    stored = materialize(queries.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "topk-queries")
    passes = max(1, -(-stored.count() // queries_per_pass))
    passes = passes if passes == 1 else 2 * passes
    dealt = stored.withColumn("pass", F.pmod(F.xxhash64("row"), F.lit(passes)))
    some = vectors.select("v").limit(SEEDS).toArrow()
    path, found = f"{work_dir(spark)}/topk-{uuid.uuid4().hex}", None
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    for p in range(passes):
        mine = dealt.where(F.col("pass") == p).select("vec_id", "v").toArrow()
        if not mine.num_rows:
            continue
        col = mine.column("v").combine_chunks()
        dims = int(np.diff(col.offsets.to_numpy()).max(initial=0))
        ids, q = mine.column("vec_id").to_numpy(), _matrix(col, dims)
        # the query's own row is one of the k + 1 best, or no better than these
        seeds = _seeds(q, _matrix(some.column("v").combine_chunks(), dims), k + 1)
        shared = spark.sparkContext.broadcast((ids, q, seeds))
        own = [max(-_MOST, min(_MOST, sum(int(x) ** 2 for x in row))) if max(np.abs(row), default=0) >= WIDE else int((row.astype(np.int64) ** 2).sum()) for row in q]
        asked = spark.createDataFrame(pa.table({"qid": pa.array(range(len(ids)), pa.int64()), "query_id": pa.array(ids), "own": pa.array([Decimal(x) for x in own], pa.decimal128(38, 0))}))
        got = vectors.select("vec_id", "v").mapInArrow(_searcher(shared, k + 1), _SCHEMA)
        got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).join(asked, "qid")
        mirror = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
        first = F.min(F.when(mirror, F.col("rank"))).over(Window.partitionBy("qid"))
        got = got.withColumn("self", first).where(F.col("self").isNull() | (F.col("rank") != F.col("self")))
        got = got.withColumn("rank", F.when(F.col("rank") > F.col("self"), F.col("rank") - 1).otherwise(F.col("rank"))).where(F.col("rank") <= k)
        long = F.greatest(F.lit(Decimal(-(2**63))), F.least(F.lit(Decimal(2**63 - 1)), F.col("score"))).cast("long")
        found = got.select("query_id", "rank", "vec_id", long.alias("score"))
        if passes > 1:
            found.write.mode("append").parquet(path)
    discard(stored) if passes > 1 else None
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found if passes == 1 else spark.read.schema(found.schema).parquet(path)


def search_table(spark, sf_dir: str, chosen: Column) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(chosen))
