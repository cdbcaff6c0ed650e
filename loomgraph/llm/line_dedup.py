"""Line dedup: exact copies by hash, near copies by a segment-partition edit join.

Lines are normalised (A-Z lowered, blanks collapsed); blank lines never take part. Lines that are equal are copies, whatever their length; of those of at least `min_bytes`
two are also linked if their edit distance, in UTF-8 bytes, is `threshold` or less (shorter ones would be linked with almost anything).
A line of length l is cut into threshold + 1 segments; an
edit script of `threshold` edits leaves one untouched, so the partner holds it at one of a few places that
depend on both lengths. Lines are indexed under (l, segment number, segment), and probe with their own substrings under
every length from l - threshold to l. A segment's key is a polynomial of its bytes modulo 2^64, taken from sums up to each place for many lines at once; equal
segments have equal keys, and unequal ones that share one cost a comparison only. Keys that only one line holds go, by an aggregate that is summed up before the shuffle, so
that a key of a third of all lines is no row more than others; (key, line) pairs of the keys that are left come by a semi-join, the bytes of each line
that is in a pair once, and pairs are verified by banded bit-parallel edit distance on what common ends leave.

Both joins are preceded by a bitmap of fixed size (`BITS`) over the wanted keys or lines, which keeps most others from being
shuffled while those are few; it drops none that is wanted, and full of ones it merely lets all through.

A key held by many lines is cut into blocks of `GROUP` lines or `GROUP_BYTES` bytes, and each pair of blocks is a task of its own: no group is
collected whole and none is capped. Before edit distance, byte-class histograms discard pairs that differ by more
than 2 * threshold counts, which no pair within the threshold does. A task reports the links that join its
lines into classes, not all pairs.

The first line of each class (smallest doc_id, nulls last, then line number) stays; the others are removed, also
within a document. Null texts have no lines. Rows equal in id and text count as one document and are treated alike. Lines are told apart by
128 bits of hash. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, map_batches, materialize, raw_bytes
from .components import connected_components

THRESHOLD = 2
MIN_BYTES = 20
GROUP, GROUP_BYTES = 1024, 8 << 20
BITS = 1 << 27  # of a bitmap: 16 MB
CHUNK = 1 << 16  # bytes of lines whose keys are taken at once
_SHORT = 1 << 20  # lines that a task remembers not to report again
_UNEVEN = (b"\t", b"\x0b", b"\x0c", b"\r", b"  ", b" \n", b"\n ")
_IS = [bytes(49 if x == c else 48 for x in range(256)) for c in range(256)]


def normal_lines(text: bytes | None, min_bytes: int) -> list[tuple[int, bytes]]:
    """(line number, normalised line) of the lines that take part."""
    if not text:
        return []
    text = text.lower()
    if not (any(x in text for x in _UNEVEN) or text[:1] == b" " or text[-1:] == b" "):  # nothing to collapse
        return [(n, line) for n, line in enumerate(text.split(b"\n")) if len(line) >= min_bytes]
    out = []
    for n, line in enumerate(text.split(b"\n")):
        if len(line) >= min_bytes:
            line = b" ".join(line.split())
            if len(line) >= min_bytes:
                out.append((n, line))
    return out


def segments(size: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of the threshold + 1 segments of a line of `size` bytes."""
    parts = threshold + 1
    base, extra = divmod(size, parts)
    out, at = [], 0
    for i in range(parts):
        length = base + (i >= parts - extra)
        out.append((at, length))
        at += length
    return out


def plan(size: int, threshold: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """Columns seed, start, stop, role of a line's keys; role 0: index, 1: probe only."""
    got = known.get((size, threshold))
    if got is None:
        got = [(size * 16 + i, p, p + n, 0) for i, (p, n) in enumerate(segments(size, threshold))]
        for gap in range(min(threshold, size) + 1):
            for i, (p, n) in enumerate(segments(size - gap, threshold)):
                right = threshold - i
                for at in range(max(0, p - i, p + gap - right), min(size - n, p + i, p + gap + right) + 1):
                    if gap or at != p:  # an index key is a probe of its own length as well
                        got.append(((size - gap) * 16 + i, at, at + n, 1))
        if len(known) > 100_000:
            known.clear()
        got = known[size, threshold] = np.array(got, np.int64)
    return got


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 to base ** n modulo 2^64."""
    got = known.get(base)
    if got is None or len(got) <= n:
        got = known[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, CHUNK), base, np.uint64))])
    return got[: n + 1]


def _mixed(sums: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    h = sums + seeds.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    return (h ^ h >> np.uint64(31)).view(np.int64)


def _polynomial(part: bytes) -> int:
    """Of a segment of any length, a stretch at a time."""
    total = 0
    for at in range(0, len(part), CHUNK):
        stretch = np.frombuffer(part, np.uint8, min(CHUNK, len(part) - at), at)
        total += int((stretch * _powers(_BASE, CHUNK)[: len(stretch)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return total & 0xFFFFFFFFFFFFFFFF


def _keys_of(lines: list[bytes], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, each one's line and role."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    distinct, which = np.unique(sizes, return_inverse=True)
    plans = [plan(n, threshold) for n in distinct.tolist()]
    counts = np.fromiter(map(len, plans), np.int64, len(plans))
    seeds, starts, stops, roles = np.ascontiguousarray(np.concatenate(plans).T)
    per = counts[which]
    owners = np.repeat(np.arange(len(lines)), per)
    at = np.arange(len(owners)) - np.repeat(np.cumsum(per) - per - (np.cumsum(counts) - counts)[which], per)
    if len(lines) == 1 and sizes[0] > CHUNK:
        sums = np.array([_polynomial(lines[0][a:b]) for a, b in zip(starts.tolist(), stops.tolist())], np.uint64)
    else:
        body = np.frombuffer(b"".join(lines), np.uint8)
        upto = np.concatenate([[np.uint64(0)], np.cumsum(body * _powers(_BASE, len(body))[:-1], dtype=np.uint64)])
        first = (np.cumsum(sizes) - sizes)[owners]
        begin = first + starts[at]
        sums = (upto[first + stops[at]] - upto[begin]) * _powers(pow(_BASE, -1, 1 << 64), len(body))[begin]
    return _mixed(sums, seeds[at]), owners, roles[at].astype(np.int8)


def line_keys(lines: list[bytes], threshold: int):
    """Yields (first line, lines, keys, each one's line among them, role) for lines of `CHUNK` bytes, or one line."""
    at = 0
    while at < len(lines):
        to, size = at + 1, len(lines[at])
        while to < len(lines) and size + len(lines[to]) <= CHUNK:
            size += len(lines[to])
            to += 1
        yield (at, to, *_keys_of(lines[at:to], threshold))
        at = to


def within(a: bytes, b: bytes, threshold: int) -> bool:
    """Edit distance <= threshold: common ends are stripped, the rest by bit-parallel columns kept to the band."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > threshold:
        return False
    lo, hi = 0, min(len(a), len(b))
    step = 64
    while lo + step <= hi and a[lo : lo + step] == b[lo : lo + step]:
        lo += step
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end, most = 0, hi - lo
    while end + step <= most and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
        end += step
    while end < most and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if not a or not b:
        return len(a) + len(b) <= threshold
    n, width = len(a), 2 * threshold + 1
    # Band of diagonals -t..t: bit d of level e is set if diagonal d reaches the column with e errors (Wu-Manber in a band).
    full, turned, places = (1 << width) - 1, a[::-1], {}
    levels = [((1 << (e + 1)) - 1) << threshold for e in range(threshold + 1)]  # column 0: the first bytes of a deleted
    for j, byte in enumerate(b):
        at = places.get(byte)
        if at is None:
            at = places[byte] = int(turned.translate(_IS[byte]), 2)  # bit i: a[i] is this byte
        same = (at >> (j - threshold) if j >= threshold else at << (threshold - j)) & full
        inside = (1 << max(0, min(width, n - j + threshold))) - 1  # rows 0 to n of a
        if j + 1 < threshold:
            inside &= -1 << (threshold - j - 1)
        old, below_old, below_new, levels = levels, 0, 0, []
        for e, before in enumerate(old):
            now = before & same
            if e:  # a substitution stays on the diagonal, a byte of b goes one down, a byte of a one up
                now |= below_old | below_old >> 1 | below_new << 1
            below_old, below_new = before, now & inside & full
            levels.append(below_new)
        if not levels[-1]:
            return False
    last = n - len(b) + threshold
    return 0 <= last < width and bool(levels[-1] >> last & 1)


def _halves(digests: list[bytes]) -> list[np.ndarray]:
    """The last and the first eight bytes."""
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64)
    return [both[1::2], both[::2]]


def _occurrences(batches):
    for batch in batches:
        digests, nums, counts = [], [], []
        for text in raw_bytes(batch.column("_text")):
            lines = normal_lines(text, 1)
            counts.append(len(lines))
            for n, line in lines:
                digests.append(xxhash.xxh3_128_digest(line))
                nums.append(n)
        at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        yield pa.RecordBatch.from_arrays([batch.column("dk").take(at), batch.column("th").take(at), pa.array(nums, pa.int32()), *map(pa.array, _halves(digests))], names=["dk", "th", "ln", "h1", "h2"])


def _new_lines(batches, min_bytes: int):
    """Lists of (digest, line) of a batch, without lines that this task has lately seen."""
    done: set[bytes] = set()
    for batch in batches:
        out = []
        if len(done) > _SHORT:
            done.clear()
        for text in raw_bytes(batch.column("_text")):
            for _, line in normal_lines(text, min_bytes):
                d = xxhash.xxh3_128_digest(line)
                if d not in done:
                    done.add(d)
                    out.append((d, line))
        yield out


def _keys(min_bytes: int, threshold: int):
    def run(batches):
        for new in _new_lines(batches, min_bytes):
            h1 = _halves([d for d, _ in new])[0]
            for lo, hi, keys, owners, roles in line_keys([line for _, line in new], threshold):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(h1[lo:hi][owners]), pa.array(roles)], names=["key", "h1", "role"])

    return run


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of the last bits of `column`: at most BITS / 8 bytes, whatever the table."""
    at = F.col(column).bitwiseAND(F.lit(BITS - 1)) + 1
    got = df.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    out = np.zeros((-(-BITS // 32768), 4096), np.uint8)
    for b, bits in zip(got.column("b").to_pylist(), got.column("bits").to_pylist()):
        out[b - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _met(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _pairs(min_bytes: int, threshold: int, shared):
    """(key, h1, h2, size) of lines and those of their keys that the bitmap lets through."""

    def run(batches):
        bits = shared.value
        for new in _new_lines(batches, min_bytes):
            lines = [line for _, line in new]
            halves, sizes = _halves([d for d, _ in new]), np.fromiter(map(len, lines), np.int64, len(lines))
            for lo, _, keys, owners, _ in line_keys(lines, threshold):
                hit = _met(bits, keys)
                at = owners[hit] + lo
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[hit], *[h[at] for h in halves], sizes[at])], names=["key", "h1", "h2", "size"])

    return run


def _bytes(min_bytes: int, shared):
    """(h1, h2, line) of the lines that the bitmap lets through."""

    def run(batches):
        bits = shared.value
        for lines in _new_lines(batches, min_bytes):
            h1, h2 = _halves([d for d, _ in lines])
            hit = np.flatnonzero(_met(bits, h1))
            yield pa.RecordBatch.from_arrays([pa.array(h1[hit]), pa.array(h2[hit]), pa.array([lines[i][1] for i in hit.tolist()], pa.binary())], names=["h1", "h2", "line"])

    return run


def links_in(ids: list, lines: list[bytes], sides: list[int], threshold: int) -> list[tuple]:
    """Links that join the lines of one group into classes; sides: 0 and 1 are compared with each other, 2 with all."""
    n = len(ids)
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    if n > 24:
        sizes = np.fromiter(map(len, lines), np.int64, n)
        hist = np.zeros((n, 32), np.int16)
        for i, line in enumerate(lines):
            hist[i] = np.minimum(np.bincount(np.frombuffer(line, np.uint8) & 31, minlength=32), 32767)
        side = np.array(sides)
    for i in range(n - 1):
        if n > 24:
            ok = (np.abs(sizes[i + 1 :] - sizes[i]) <= threshold) & ((side[i + 1 :] != side[i]) | (side[i] == 2))
            near = np.flatnonzero(ok)
            if len(near):
                near = near[np.abs(hist[i + 1 + near] - hist[i]).sum(axis=1) <= 2 * threshold]
            others = (near + i + 1).tolist()
        else:
            others = [j for j in range(i + 1, n) if sides[i] == 2 or sides[i] != sides[j]]
        for j in others:
            a, b = top(i), top(j)
            if a != b and within(lines[i], lines[j], threshold):
                root[b] = a
                out.append((ids[i], ids[j]))
    return out


def _verify(threshold: int):
    def run(batches):
        held: tuple | None = None
        ids, lines, sides = [], [], []

        def found():
            got = links_in(ids, lines, sides, threshold) if len(ids) > 1 else []
            ends = [pa.array([(x[i][0] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + (x[i][1] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") for x in got], pa.binary()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["u", "v"])

        for batch in batches:
            groups = zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j")])
            for group, *row in zip(groups, *[batch.column(c).to_pylist() for c in ("h1", "h2", "line", "side")]):
                if group != held:
                    yield found()
                    held, ids, lines, sides = group, [], [], []
                ids.append((row[0], row[1]))
                lines.append(row[2])
                sides.append(row[3])
        yield found()

    return run


def near_links(rows: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, group: int = GROUP) -> DataFrame:
    """Edges (u, v) between lines, by the 16 bytes of their hashes; `rows(_text)`."""
    spark = rows.sparkSession
    texts = rows.select("_text")
    keys = map_batches(texts, _keys(min_bytes, threshold), "key long, h1 long, role byte")
    held = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("role").alias("r")).where("a <> b and r = 0").select("key")
    held = materialize(held, "line-keys")  # keys that two lines hold, one of them as its own segment
    pairs = map_batches(texts, _pairs(min_bytes, threshold, spark.sparkContext.broadcast(bitmap(held, "key"))), "key long, h1 long, h2 long, size long")
    pairs = materialize(pairs.join(held, "key", "left_semi").distinct(), "line-pairs")
    wanted = materialize(pairs.select("h1", "h2").distinct(), "line-wanted")
    bodies = map_batches(texts, _bytes(min_bytes, spark.sparkContext.broadcast(bitmap(wanted, "h1"))), "h1 long, h2 long, line binary")
    bodies = materialize(bodies.join(wanted, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.any_value("line").alias("line")), "line-bytes")
    blocks = F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("size") / GROUP_BYTES)).cast("int")
    put = pairs.join(pairs.groupBy("key").agg(blocks.alias("nb")), "key")
    put = put.withColumn("at", F.pmod(F.xxhash64("h1"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = F.when(F.col("at") == F.col("o"), 2).when(F.col("at") < F.col("o"), 0).otherwise(1).alias("side")
    put = put.select("key", "h1", "h2", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), side).join(bodies, ["h1", "h2"])
    put = put.select("key", "i", "j", "h1", "h2", "line", "side").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "h1", "h2")
    return map_batches(put, _verify(threshold), "u binary, v binary").distinct()


def kept_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(dk, th, kept array<int>): the numbers of the lines that a document keeps, of those that are not blank."""
    rows = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("_text"))
    place = F.struct((F.col("dk") == -(2**63)).alias("none"), "dk", "th", "ln")
    seen = map_batches(rows, _occurrences, "dk long, th long, ln int, h1 long, h2 long")
    lines = materialize(seen.groupBy("h1", "h2").agg(F.min(place).alias("first")), "lines")
    roots = materialize(connected_components(near_links(rows, threshold, min_bytes)), "line-roots")
    half = lambda at: F.conv(F.hex(F.substring("id", at, 8)), 16, -10).cast("long")
    tied = lines.join(roots.select(half(1).alias("h1"), half(9).alias("h2"), "root"), ["h1", "h2"], "left")
    alone = tied.where("root is null").select("first")
    led = tied.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first")
    return alone.unionAll(led).select("first.*").groupBy("dk", "th").agg(F.sort_array(F.collect_list("ln")).alias("kept"))


def _cleaner(text_col: str):
    def run(batches):
        for batch in batches:
            texts, removed, totals = [], [], []
            for text, kept in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column("_loom_kept").to_pylist()):
                kept = set(kept or ())
                raw = text.split(b"\n") if text is not None else []
                gone = [n for n, line in enumerate(raw) if n not in kept and line.strip()]  # blank lines stay
                removed.append(gone)
                totals.append(len(raw))
                out = set(gone)
                texts.append(text if not gone else b"\n".join(x for n, x in enumerate(raw) if n not in out))
            names = [n for n in batch.schema.names if n not in ("_loom_kept", text_col)]
            new = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(totals, pa.int64()), "removed": pa.array(removed, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new.values()], names=[*names, *new])

    return run


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """`docs` with its text cleaned, n_lines (before) and removed array<int> (line numbers from 0);
    columns of docs so named are replaced."""
    docs = docs.drop("n_lines", "removed")
    kept = kept_lines(docs, text_col, id_col, threshold, min_bytes)
    dk, th = doc_key(id_col, text_col)
    keyed = docs.withColumns({"_loom_dk": dk, "_loom_th": th})
    both = keyed.join(kept.select(F.col("dk").alias("_loom_dk"), F.col("th").alias("_loom_th"), F.col("kept").alias("_loom_kept")), ["_loom_dk", "_loom_th"], "left").select(*[keyed[c] for c in docs.columns], "_loom_kept")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)
    return map_batches(both, _cleaner(text_col), f"{ddl}, `{text_col}` string, n_lines long, removed array<int>")
