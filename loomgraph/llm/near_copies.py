"""Near copies of whole documents: SimHash links, then MinHash candidates for what lies further apart, exact verification on five-word shingles, components.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; the classes are the
connected components of that relation. Words are A-Z lowered runs of non-blanks; fewer than five words make one shingle.

First SimHash, as `simhash_dedup` has it: fingerprints of three-word shingles, linked within two bits by its covering masks. Each link is decided
exactly; the components of those that hold are one text to what follows. At 0.8 some 15 % of a SimHash's bits differ, at any width, which no
few tables cover, so the pairs that are further apart are found by minimum hashes.

Candidates of that second step: `BANDS` keys of `ROWS` minimum hashes each. A pair at similarity 0.8 shares no key with a probability of
(1 - 0.8**5)**32 = 3e-6. Buckets that SimHash made one component are done; every other candidate pair is decided exactly, whatever the size of its bucket:
first all members of a bucket against its pivot, the member whose buckets are the fullest (the text that copies were made from), then,
in buckets that still hold several components, the members of different components against each other. That second
comparison takes a bucket in blocks of `GROUP` members and puts out links only, never pairs. A large group that its pivot joins costs a multiple of its
size; members that share keys without being similar are compared pair by pair, in blocks, which grows with the square of their number.

Texts of the same words are one text. Null and blank texts are one class. The document kept of a class is that of the smallest
id (null ids last); rows equal in id and text count as the same document.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import discard, doc_key, map_batches, materialize, raw_bytes
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 32, 5
GROUP = 1024
SEED = 42
_CHUNK = 1 << 15
_RNG = np.random.default_rng(SEED)
_FLIPS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)
_FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[bytes]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the five-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(SHINGLE, len(words))
    cuts = map(slice, (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, len(words) - width + 1))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS) keys of non-empty sets of hashes."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= _CHUNK:
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        for b in range(BANDS):
            key = np.full(to - at, np.uint64(b + 1))
            for i in range(b * ROWS, (b + 1) * ROWS):
                key = (key ^ np.minimum.reduceat((flat ^ _FLIPS[i]) * _FACTORS[i], starts)) * _MIX
                key ^= key >> np.uint64(29)
            out[at:to, b] = key
        at = to
    return out


def _marks(batches):
    for batch in batches:
        texts = raw_bytes(batch.column("_text"))
        words = [t.lower().split() if t else [] for t in texts]
        sims = np.array([simhash_dedup.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        fps = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) if w else 0 for w in words], np.uint64).view(np.int64)
        sets = [grams(w) for w in words]
        full = [s for s in sets if len(s)]
        sizes = np.array([len(s) for s in sets], np.int64)
        offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)])
        keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band_keys(full).ravel().view(np.int64)))
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(fps), pa.array(sims), pa.array(sizes), keys], names=[*names, "fp", "sim", "n", "keys"])


def _sets(batches):
    for batch in batches:
        sets = [grams(t.lower().split() if t else []) for t in raw_bytes(batch.column("_text"))]
        offsets = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["fp", "grams"])


def _may(a: Column, b: Column) -> Column:
    """Sets of these sizes can be similar enough."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (u, v) with a similarity of 0.8 or more, in whole numbers: 5 both >= 4 (a + b - both)."""
    left = sets.select(F.col("fp").alias("u"), F.col("grams").alias("a"))
    right = sets.select(F.col("fp").alias("v"), F.col("grams").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return materialize(pairs.join(left, "u").join(right, "v").where(both * 9 >= (F.size("a") + F.size("b")) * 4).select("u", "v"), name)


def _open(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(key, fp, n, root): members of buckets that still hold several components."""
    roots = connected_components(found).select(F.col("id").alias("fp"), "root")
    known = rows.select("key", "fp", "n").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = known.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return materialize(known.join(mixed, "key").select("key", "fp", "n", "root"), name)


def _to_pivots(open_: DataFrame) -> DataFrame:
    """(u, v): each member of a bucket with the bucket's pivot, the member whose buckets are the fullest over all its keys.

    A text that many copies were made from shares keys with most of them, the copies with each other fewer.
    """
    sizes = open_.groupBy("key").agg(F.count("*").alias("k"))
    sized = open_.join(sizes, "key")
    liked = sized.groupBy("fp").agg(F.sum("k").alias("liked"))
    sized = sized.join(liked, "fp")
    pivot = F.struct("liked", "fp", "n", "root")
    pivots = sized.groupBy("key").agg(F.max(pivot).alias("p"))
    met = open_.join(pivots, "key").where((F.col("p.root") != F.col("root")) & _may(F.col("n"), F.col("p.n")))
    return met.select(F.least("fp", "p.fp").alias("u"), F.greatest("fp", "p.fp").alias("v")).distinct()


def similar_in(fps: list[int], roots: list[int], sides: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of one group that are similar and join different components; sides: 0 and 1 are compared with each other, 2 with all."""
    n, out = len(fps), []
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    root, side, mark = np.array(roots), np.array(sides), np.zeros(len(flat), np.int64)
    for i in range(n - 1):
        a, rest = sizes[i], sizes[i + 1 :]
        ok = (root[i + 1 :] != root[i]) & (np.minimum(rest, a) * 5 >= np.maximum(rest, a) * 4) & ((side[i + 1 :] != side[i]) | (side[i] == 2))
        others = np.flatnonzero(ok) + i + 1
        if not len(others):
            continue
        own = ids[starts[i] : starts[i] + a]
        mark[own] = 1
        if len(others) * 8 < n - i:
            both = np.array([mark[ids[starts[j] : starts[j] + sizes[j]]].sum() for j in others.tolist()])
        else:
            both = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])[others - i - 1]
        mark[own] = 0
        for j in others[both * 9 >= (sizes[others] + a) * 4].tolist():
            if root[j] != root[i]:
                out.append((fps[i], fps[j]))
                root[root == root[j]] = root[i]
    return out


def _compared(batches):
    held, rows = None, []

    def found():
        got = similar_in(*map(list, zip(*rows))) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in got], pa.int64()), pa.array([max(x) for x in got], pa.int64())], names=["u", "v"])

    for batch in batches:
        groups = zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j")])
        sets = batch.column("grams")
        for r, (group, *row) in enumerate(zip(groups, *[batch.column(c).to_pylist() for c in ("fp", "root", "side")])):
            if group != held:
                yield found()
                held, rows = group, []
            rows.append((*row, sets[r].values.to_numpy()))
    yield found()


def _in_blocks(open_: DataFrame, sets: DataFrame, group: int) -> DataFrame:
    """Similar pairs that join different components of a bucket: buckets are cut into blocks, each pair of blocks is compared in a task; only links come out."""
    sizes = open_.groupBy("key").agg(F.count("*").alias("k"))
    put = open_.join(sizes, "key").withColumn("nb", F.ceil(F.col("k") / group).cast("int"))
    put = put.withColumn("at", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = F.when(F.col("at") == F.col("o"), 2).when(F.col("at") < F.col("o"), 0).otherwise(1).alias("side")
    put = put.select("key", "fp", "root", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), side).join(sets, "fp")
    put = put.select("key", "i", "j", "fp", "root", "side", "grams").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return map_batches(put, _compared, "u long, v long").distinct()


def simhash_pairs(own: DataFrame) -> DataFrame:
    """(u, v): the pairs of `own(fp, sim)` that stand for the SimHash links, one of each link of two fingerprints, and each text with the first of its fingerprint."""
    own = own.select("fp", "sim")
    first = own.groupBy("sim").agg(F.min("fp").alias("first"))
    same = own.join(first, "sim").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    near = simhash_dedup.links(first.select(F.col("sim").alias("fp")))
    near = near.join(first.select(F.col("sim").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("sim").alias("v"), F.col("first").alias("b")), "v").select("a", "b")
    return same.unionAll(near).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def links(own: DataFrame, texts: DataFrame, group: int = GROUP) -> DataFrame:
    """Verified pairs (u, v) that join `own(fp, sim, n, keys)` into the classes of all candidate pairs; `texts(fp, _text)` has every fp once."""
    near = materialize(simhash_pairs(own), "near-simhash")
    rows = own.select("fp", "n", F.explode("keys").alias("key"))
    several = rows.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("key")
    shared = materialize(rows.join(several, "key"), "near-buckets")
    asked = shared.select("fp").unionAll(near.select(F.col("u").alias("fp"))).unionAll(near.select(F.col("v").alias("fp"))).distinct()
    met = texts.join(asked, "fp", "left_semi").select("fp", "_text")
    sets = materialize(map_batches(met, _sets, "fp long, grams array<long>"), "near-sets")
    found = _verified(near, sets, "near-linked")
    rest = _open(shared, found, "near-rest")
    found = found.unionAll(_verified(_to_pivots(rest), sets, "near-found"))
    more = materialize(_in_blocks(_open(rest, found, "near-open"), sets, group), "near-more")
    for df in (near, shared, sets, rest):
        discard(df)
    return found.unionAll(more)


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with one document of each class of near copies."""
    dk, th = doc_key(id_col, text_col)
    rows = docs.select(F.col(id_col).isNull().alias("none"), dk, th, F.col(text_col).alias("_text"))
    marked = map_batches(rows, _marks, "none boolean, dk long, th long, fp long, sim long, n long, keys array<long>")
    own = marked.groupBy("fp").agg(F.min(F.struct("none", "dk", "th")).alias("first"), F.any_value("sim").alias("sim"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    own = materialize(own, "near-distinct")
    texts = rows.dropDuplicates(["dk", "th"]).join(own.select("fp", F.col("first.dk").alias("dk"), F.col("first.th").alias("th")), ["dk", "th"])
    roots = connected_components(links(own.where("n > 0"), texts)).withColumnRenamed("id", "fp")
    known = own.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    firsts = known.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.dk").alias("_loom_dk"), F.col("first.th").alias("_loom_th"))
    keyed = docs.withColumns({"_loom_dk": dk, "_loom_th": th})
    return keyed.join(firsts, ["_loom_dk", "_loom_th"]).dropDuplicates(["_loom_dk", "_loom_th"]).select(*[keyed[c] for c in docs.columns])
