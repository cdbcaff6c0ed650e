"""Benchmark decontamination: item-sized windows, SimHash candidates, exact verification.

A window of as many words as an item has is compared with it by weighted Jaccard similarity of five-word shingles
(weight: how often a shingle occurs); 0.8 or more is a hit. Fewer than five words make one shingle. A text shorter than
an item is compared with it as one window.

Candidates: windows and items have 256-bit SimHashes; 16 blocks of 16 bits are indexed with all values within 3 bits,
so by the pigeonhole rule every pair within 63 bits meets in some block. At similarity 0.8 the expected distance is 39 bits
with a deviation under 6; pairs that meet are verified exactly. Windows that share no shingle with any
item of their size have similarity 0 and are skipped before hashing, which loses nothing.

Items are taken in blocks of `ITEMS_PER_PASS` or `PASS_BYTES`, each a bounded broadcast (but for an item that is longer by itself); the corpus is read once for each block.
Items and texts may have any length: sums over long windows slide, and similarities are counted up and down as a window slides.
Words are A-Z lowered runs of non-blanks. Null or wordless texts and items never match; repeated items and repeated document rows all report; an empty table gives no rows;
result: one row for a document row and item, the best window, the first among equals.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, map_batches, raw_bytes

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_RADIUS = 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
ITEMS_PER_PASS = 2048
PASS_BYTES = 32 << 20
CHUNK = 4096  # windows or shingles hashed at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes]) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def votes(grams: list[bytes]) -> np.ndarray:
    """Per shingle 256 votes of +1 or -1."""
    raw = b"".join(xxhash.xxh3_128_digest(g, seed) for g in grams for seed in (0, 1))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(grams), 32), axis=1)
    return bits.astype(np.int32) * 2 - 1


def vote_sum(grams: list[bytes]) -> np.ndarray:
    total = np.zeros(256, np.int64)
    for lo in range(0, len(grams), CHUNK):
        total += votes(grams[lo : lo + CHUNK]).sum(0)
    return total


def packed(total: np.ndarray) -> np.ndarray:
    """Vote sums (n, 256) -> fingerprints (n, 16) of 16-bit blocks."""
    return np.packbits(total > 0, axis=1).view(np.uint16).reshape(len(total), BLOCKS)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(c, b[g]) for g, c in a.items() if g in b)
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


class Index:
    """Fingerprints of items by block values within `BLOCK_RADIUS` bits, and the items' shingles."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, t.lower().split()) for i, t in items if t and t.split()]
        self.bags = [Counter(shingles(w)) for _, w in self.items]
        self.sizes = [len(w) for _, w in self.items]
        self.words = {w: n + 1 for n, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        by_key: dict[int, set[int]] = defaultdict(set)
        for n, (_, ws) in enumerate(self.items):
            ids = np.array([self.words[w] for w in ws], np.uint64)
            for k in set(self.keys(ids).tolist()):
                by_key[k].add(len(ws))
        self.key_sizes = {k: tuple(v) for k, v in by_key.items()}
        self.sorted_keys = np.array(sorted(by_key), np.uint64)
        self.short = {len(ws) for _, ws in self.items if len(ws) < SHINGLE}
        self.prints = packed(np.array([vote_sum(shingles(w)) for _, w in self.items], np.int64).reshape(-1, 256)) if self.items else np.zeros((0, BLOCKS), np.uint16)
        flips = np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(16), r)], np.uint16)
        self.posts = []
        for b in range(BLOCKS):
            values = (self.prints[:, b][:, None] ^ flips[None, :]).ravel()
            owners = np.repeat(np.arange(len(self.items), dtype=np.int32), len(flips))
            order = np.argsort(values, kind="stable")
            self.posts.append((np.searchsorted(values[order], np.arange(65537)), owners[order]))

    @staticmethod
    def keys(ids: np.ndarray, width: int = SHINGLE) -> np.ndarray:
        """A 64-bit key for each run of `width` word numbers (shorter: of all); 0 where a word is unknown."""
        width = min(width, len(ids))
        n = len(ids) - width + 1
        key, known = np.full(n, np.uint64(width)), np.ones(n, bool)
        for k in range(width):
            part = ids[k : k + n]
            key = (key ^ part) * _MIX
            key ^= key >> np.uint64(29)
            known &= part > 0
        return np.where(known, key | np.uint64(1), np.uint64(0))

    def near(self, prints: np.ndarray) -> list[np.ndarray]:
        """Per window the items within RADIUS bits."""
        out = []
        for p in prints:
            met = np.unique(np.concatenate([self.posts[b][1][self.posts[b][0][v] : self.posts[b][0][int(v) + 1]] for b, v in enumerate(p)]))
            if len(met):
                met = met[np.bitwise_count(self.prints[met] ^ p).sum(axis=1) <= RADIUS]
            out.append(met)
        return out

    def hits(self, text: bytes | None) -> list[tuple[int, float, int, int]]:
        """(item position, similarity, first word, words) of one text's best windows."""
        words = text.lower().split() if text else []
        n = len(words)
        if not n or not self.items:
            return []
        ids = np.fromiter((self.words.get(w, 0) for w in words), np.uint64, n)
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> ranges of starts
        longer: set[int] = set()  # sizes of items that the whole text may still be similar to
        for width in {SHINGLE, *self.short}:
            if n < width:
                continue
            keys = self.keys(ids, width)
            at = np.flatnonzero(keys)
            if len(at):
                place = np.searchsorted(self.sorted_keys, keys[at])
                place[place == len(self.sorted_keys)] = 0
                at = at[self.sorted_keys[place] == keys[at]]
            for j in at.tolist():
                for size in self.key_sizes[int(keys[j])]:
                    if size <= n and (size >= SHINGLE) == (width == SHINGLE) and (size >= SHINGLE or size == width):
                        windows[size].append((max(0, j - max(0, size - SHINGLE)), min(j, n - size)))
                    elif size > n >= SHINGLE and n - SHINGLE + 1 >= SIMILARITY * (size - SHINGLE + 1) - 1e-9:
                        longer.add(size)
        best: dict[int, tuple[float, int, int]] = {}
        for size, ranges in windows.items():
            ranges.sort()
            merged: list[list[int]] = []
            for a, b in ranges:
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                self._windows(words, size, a, b, best, {size})
        if longer:
            self._windows(words, n, 0, 0, best, longer)
        return [(k, *v) for k, v in sorted(best.items())]

    def _windows(self, words, size, a, b, best, item_sizes):
        """Windows of `size` words that start at a to b, chunk by chunk; a window's vote sum is the one before less what left, plus what came."""
        span, width = min(SHINGLE, size), max(1, size - SHINGLE + 1)
        grams = lambda lo, hi: [b" ".join(words[i : i + span]) for i in range(lo, hi)]
        total = None
        for lo in range(a, b + 1, CHUNK):
            hi = min(b, lo + CHUNK - 1)
            if width <= CHUNK:
                sums = np.vstack([np.zeros((1, 256), np.int32), np.cumsum(votes(grams(lo, hi + width)), axis=0, dtype=np.int32)])
                sums = sums[width:] - sums[:-width]
            else:
                if total is None:
                    total = np.zeros(256, np.int64)
                    for at in range(lo, lo + width, CHUNK):
                        total += votes(grams(at, min(at + CHUNK, lo + width))).sum(0)
                last = hi + 1 if hi < b else hi
                moves = votes(grams(lo + width, last + width)) - votes(grams(lo, last)) if last > lo else np.zeros((0, 256), np.int32)
                sums = total + np.vstack([np.zeros((1, 256), np.int64), np.cumsum(moves, axis=0, dtype=np.int64)])
                total, sums = sums[-1], sums[: hi - lo + 1]
            met: dict[int, list[int]] = defaultdict(list)
            for s, near in enumerate(self.near(packed(sums)), lo):
                for k in near.tolist():
                    if self.sizes[k] in item_sizes:
                        met[k].append(s)
            for k, starts in met.items():
                self._compare(words, span, width, starts, k, best, size)

    def _compare(self, words, span, width, starts, k, best, size):
        """Weighted Jaccard of item k and the windows at `starts`, counted on as the window slides."""
        bag = self.bags[k]
        items, now, both, count = sum(bag.values()), -1, 0, {}
        for s in starts:
            if now < 0 or s - now > width:
                count, both, now = {}, 0, s
                todo = [(1, i) for i in range(s, s + width)]
            else:
                todo = [x for i in range(now, s) for x in ((-1, i), (1, i + width))]
                now = s
            for way, i in todo:
                g = b" ".join(words[i : i + span])
                most = bag.get(g)
                if most is not None:
                    c = count.get(g, 0)
                    count[g] = c + way
                    if (c < most) if way > 0 else (c <= most):
                        both += way
            sim = both / (width + items - both)
            if sim >= SIMILARITY and (k not in best or sim > best[k][0]):
                best[k] = (sim, s, size)


_BUILT: dict[str, Index] = {}


def _finder(shared, tag: str):
    def run(batches):
        if tag not in _BUILT:
            _BUILT.clear()
            _BUILT[tag] = Index(shared.value)
        index = _BUILT[tag]
        for batch in batches:
            rows, hits = [], []
            for r, text in enumerate(raw_bytes(batch.column("_text"))):
                for k, sim, at, size in index.hits(text):
                    rows.append(r)
                    hits.append((index.items[k][0], sim, at, size))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            took = batch.take(pa.array(rows, pa.int64()))
            cols = list(zip(*hits)) if hits else [[], [], [], []]
            new = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[took.column(i) for i in keep], *new], names=[*[batch.schema.names[i] for i in keep], "item_id", "similarity", "start_word", "n_words"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, dk, th (the row's key), item_id, similarity, start_word, n_words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total, size = items.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    passes = max(1, -(-total // items_per_pass), -(-(size or 0) // PASS_BYTES))
    passes = passes if passes == 1 else 2 * passes
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *doc_key(id_col, text_col), F.col(text_col).alias("_text"))
    out = []
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p).orderBy("i", "t").toArrow()
        payload = list(zip(part.column("i").to_pylist(), [t.encode() for t in part.column("t").to_pylist()]))
        shared = spark.sparkContext.broadcast(payload)
        out.append(map_batches(rows, _finder(shared, f"{id(shared)}-{xxhash.xxh3_64_hexdigest(repr(payload))}"), "doc_id long, dk long, th long, item_id long, similarity double, start_word long, n_words long"))
    return reduce(DataFrame.unionAll, out)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` without the documents that hold an item."""
    bad = contaminated(docs, benchmark, text_col, id_col).select(F.col("dk").alias("_loom_dk"), F.col("th").alias("_loom_th")).distinct()
    dk, th = doc_key(id_col, text_col)
    keyed = docs.withColumns({"_loom_dk": dk, "_loom_th": th})
    return keyed.join(bad, ["_loom_dk", "_loom_th"], "left_anti").select(*[keyed[c] for c in docs.columns])
