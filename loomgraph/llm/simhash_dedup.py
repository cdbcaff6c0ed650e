"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Every fingerprint is masked by 2**(r+1) - 1 structured masks: bit i has a code m(i) in 1..2**(r+1)-1 and mask v
keeps the bits whose code has an odd number of ones in common with v. Any r differing bits impose r linear
conditions on r+1 unknowns, so some mask v drops all of them: every pair within the radius meets in some table.

Distinct fingerprints only are linked; the classes of equal fingerprints are a plain group-by. A bucket of up to
`bucket_limit` fingerprints compares its pairs; a larger one is split exactly by midpoints: two fingerprints
within two bits share a third within one bit of either, and at most 65 fingerprints share a midpoint.

Null and blank texts have fingerprint zero and are linked as any other; a null doc_id never names a class unless
all ids of the class are null; rows equal in all columns stay rows of the result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, map_batches, materialize, raw_bytes
from .components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
BUCKET_LIMIT = 48
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included; fewer words: of the whole sequence; none: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        cuts = map(slice, starts[at:to].tolist(), ends[at + SHINGLE - 1 : to + SHINGLE - 1].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        got = np.array([fingerprint(t) for t in raw_bytes(batch.column("_text"))], np.uint64).view(np.int64)
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
        names = [name for name in batch.schema.names if name != "_text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(got)], names=[*names, "fp"])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id long, dk, th, fp long) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *doc_key(id_col, text_col), F.col(text_col).alias("_text"))
    return map_batches(rows, _fingerprints, "doc_id long, dk long, th long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks; codes go round 1..2**(radius+1)-1, so each mask keeps about (1/2 + a little) of the bits."""
    top = 2 ** (radius + 1)
    masks = []
    for v in range(1, top):
        bits = sum(1 << i for i in range(64) if bin((i % (top - 1) + 1) & v).count("1") % 2)
        masks.append(bits - 2**64 if bits >= 2**63 else bits)
    return masks


def links(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints `fps(fp)` into the same classes as all pairs within `radius` bits."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    masks = covering_masks(radius)
    spread = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    rows = fps.select("fp", spread.alias("b")).select("fp", "b.t", "b.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("k")).where("k > 1")
    shared = materialize(rows.join(sizes, ["t", "key"]), "simhash-buckets")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    small = (
        shared.where(F.col("k") <= bucket_limit).groupBy("t", "key").agg(F.collect_list("fp").alias("all"))
        .select("all", F.explode("all").alias("u"))
        .select("u", F.explode(F.filter("all", lambda b: (b > F.col("u")) & near(F.col("u"), b))).alias("v"))
    )
    large = shared.where(F.col("k") > bucket_limit)
    signed = [(1 << i) - 2**64 if i == 63 else 1 << i for i in range(64)]
    free = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(b).cast("long") for i, b in enumerate(signed) if not (m >> i) & 1]) for m in masks]), F.col("t") + 1)
    stars = (
        large.select("fp", F.explode(free).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).distinct()
        .groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    )
    if radius == 2:
        stars = stars.select(F.col("all")[0].alias("u"), F.explode(F.slice("all", 2, 64)).alias("v"))
    else:
        stars = stars.select("all", F.explode("all").alias("u")).select("u", F.explode(F.filter("all", lambda b: (b > F.col("u")) & near(F.col("u"), b))).alias("v"))
    return small.unionAll(stars).distinct()


def classify(marked: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Distinct fp -> class root and the class's smallest (doc_id, dk, th): `fp, root, first`."""
    own = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "dk", "th")).alias("first"))
    own = materialize(own, "simhash-distinct")
    roots = connected_components(links(own.select("fp"), radius, bucket_limit))
    known = own.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    tops = known.groupBy("root").agg(F.min("first").alias("first"))
    return known.select("fp", "root").join(tops, "root")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, is_representative."""
    marked = materialize(fingerprints(docs, text_col, id_col), "simhash-docs")
    classes = classify(marked, radius, bucket_limit)
    return marked.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(~F.col("first.none"), F.col("first.dk")).alias("component_id"),
        ((F.col("dk") == F.col("first.dk")) & (F.col("th") == F.col("first.th"))).alias("is_representative"),
    )


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """`docs` with one document of each class: that of the smallest id (null ids last; equal rows once)."""
    marked = materialize(fingerprints(docs, text_col, id_col), "simhash-docs")
    firsts = classify(marked, radius).select("first.dk", "first.th").distinct()
    dk, th = doc_key(id_col, text_col)
    keyed = docs.withColumns({"_loom_dk": dk, "_loom_th": th})
    kept = keyed.join(firsts.select(F.col("dk").alias("_loom_dk"), F.col("th").alias("_loom_th")), ["_loom_dk", "_loom_th"])
    return kept.dropDuplicates(["_loom_dk", "_loom_th"]).select(*[kept[c] for c in docs.columns])
