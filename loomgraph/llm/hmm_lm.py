"""A hidden Markov language model over whole texts.

Tokens are A-Z lowered runs of non-blanks, then one end. A token belongs to a class: the most frequent words and the end
have classes of their own, all others the class of their last two bytes.

Training: Baum-Welch over classes, every one of the `rounds` over all training texts, whole. Partitions return expected counts,
which are summed by class with an aggregate. One more round is by word: its forward-backward pass gives the expected
count of every training word in every state, and, beside start and moves,

    emission(word | s) = (count(word, s) + 1/2 share(s | class)) / (count(s) + 1/2 sum over classes of share(s | class) * words),

where a class's words are its distinct training words and, for classes of endings, one unknown word. Scoring is the scaled forward recursion
over whole texts with these emissions. Texts of any length are laid out step by step; what is longer than `BATCH` tokens
is taken in stretches whose first alphas are kept and whose rest is computed again on the way back, so nothing is cut.

Only tables of fixed size are broadcast: the dictionary of the `DICTIONARY` most frequent words with their emissions, and the states'
parameters. The counts of all other words are summed by a window over the word (none of them is frequent: each has less than a
`DICTIONARY`-th of all tokens) and go back to their texts by a join, so the vocabulary may grow with the corpus. Their shares of states are kept in
steps of 1/65535.

Null texts are empty: one token, the end. Rows of the same id or text are scored apart, and all count in training. Without training texts all words
are unknown and the states are uniform. An empty table gives no rows. Nothing depends on partitions but the order of sums of doubles.
"""

from __future__ import annotations

import ctypes
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize

STATES = 8
OWN_CLASSES = 8192
ENDINGS = 512
DICTIONARY = 262_144
ROUNDS = 7  # by class; one more by word
PRIOR = 200.0
FLUSH = 400_000
BATCH = 400_000
HOLD = 4_000_000
RESCALE = 16
TURN = 2048
PIECE = 4 << 20  # bytes of text whose words are held at a time
END = ""


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), b""]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """`tokens` of many texts, one after the other, and how many each text has."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(texts, "", " "))  # the blank cuts off the end
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten().cast(pa.string()), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _pieces(batches):
    """The batches in slices of about `PIECE` bytes of text, whole rows, so that few words are held at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _counter(batches):
    held, size = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

    for batch in _pieces(batches):
        seen = pc.value_counts(_words(batch.column("_text"))[0])
        held.append(pa.table([seen.field(0), seen.field(1)], names=["token", "n"]))
        size += len(seen)
        if size > FLUSH * 3 // 2:
            held = [summed()]
            size = len(held[0])
            if size > FLUSH:
                yield from held.pop().to_batches()
                size = 0
    if held:
        yield from summed().to_batches()


class Vocabulary:
    """The dictionary (place 0: the end) and what is known of each class."""

    def __init__(self, top: pa.Array, counts: np.ndarray, ends: int, n: int, v: int, own: int = OWN_CLASSES):
        self.words = pa.concat_arrays([pa.array([END]), top])
        self.size, self.own = len(top), own
        counts = np.concatenate([[ends], counts]).astype(np.float64)
        self.logs = np.append(np.log10(counts + 0.5), 0.0)  # the last: of a word that the dictionary lacks
        self.known = np.append(counts > 0, False)
        self.cls = np.where(np.arange(len(counts)) > own, self.endings(self.words), np.arange(len(counts))).astype(np.uint16)
        self.n, self.v = n, v
        self.classes = 1 + own + ENDINGS
        self.mass = np.zeros(self.classes)
        self.distinct = np.zeros(self.classes)
        single = 1 + min(own, len(top))
        self.mass[:single] = counts[:single] + 0.5
        self.distinct[:single] = 1

    def places(self, words: pa.Array) -> np.ndarray:
        """Places in the dictionary, else -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def endings(self, words: pa.Array) -> np.ndarray:
        """Classes by the last two bytes."""
        tails = pc.binary_slice(words.cast(pa.binary()), -2).dictionary_encode()
        classes = np.array([1 + self.own + crc32(t) % ENDINGS for t in tails.dictionary.to_pylist()], np.int64)
        return classes[tails.indices.to_numpy()]

    def add_endings(self, cls: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        """n tokens and v distinct words of each class of an ending; one unknown word besides."""
        self.mass[1 + self.own :], self.distinct[1 + self.own :] = 0.5, 1
        self.mass[cls] += n + 0.5 * v
        self.distinct[cls] += v

    @property
    def log_total(self) -> float:
        return float(np.log10(self.n + 0.5 * (self.v + 1)))


def _endings(shared):
    def run(batches):
        vocabulary = shared.value
        n, v = np.zeros(vocabulary.classes), np.zeros(vocabulary.classes)
        for batch in batches:
            words = batch.column("token").cast(pa.string())
            own = pc.is_in(words, value_set=vocabulary.words[: vocabulary.own + 1]).to_numpy(zero_copy_only=False)
            classes = np.where(own, 0, vocabulary.endings(words))
            n += np.bincount(classes, batch.column("c").to_numpy(), vocabulary.classes)
            v += np.bincount(classes, minlength=vocabulary.classes)
        at = np.flatnonzero(v[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(v[at])], names=["g", "n", "v"])

    return _released(run)


def _encoder(shared):
    """seq: class of each token; fine: of tokens whose class is an ending, the place in the dictionary or, past it, in `rare`,
    the text's distinct words that the dictionary lacks."""

    def run(batches):
        vocabulary = shared.value
        own, size = vocabulary.own, vocabulary.size
        for batch in _pieces(batches):
            words, sizes = _words(batch.column("_text"))
            first = np.cumsum(sizes) - sizes
            at = vocabulary.places(words)
            out = np.flatnonzero(at < 0)
            logs, known = np.add.reduceat(vocabulary.logs[at], first), np.add.reduceat(vocabulary.known[at].astype(np.int64), first)
            strangers = words.take(pa.array(out)).dictionary_encode()
            of = np.searchsorted(first, out, side="right") - 1  # the text of each
            one = max(1, len(strangers.dictionary))
            pairs, place = np.unique(of * one + strangers.indices.to_numpy(), return_inverse=True)  # a text and a word
            classes = vocabulary.cls[at]
            classes[out] = vocabulary.endings(strangers.dictionary)[strangers.indices.to_numpy()]
            rare = np.concatenate([[0], np.cumsum(np.bincount(pairs // one, minlength=len(sizes)))])
            at[out] = size + 1 + place - rare[of]
            coarse = classes > own
            fines = np.add.reduceat(coarse.astype(np.int64), first)
            lists = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), strangers.dictionary.take(pa.array(pairs % one)))
            keep = [n for n in batch.schema.names if n != "_text"]
            new = [pa.array(sizes), pa.array(known), pa.array(logs), _binaries(classes.astype("<u2"), sizes), _binaries(at[coarse].astype("<u4"), fines), lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *new], names=[*keep, "n_tokens", "n_inside", "logs", "seq", "fine", "rare"])

    return _released(run)


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values as bytes, so many to a row."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.array(offsets, pa.int32()).buffers()[1], pa.py_buffer(values)])


_SPACE: dict[tuple[str, int], np.ndarray] = {}


def _space(name: str, rows: int, k: int) -> np.ndarray:
    """A work array that is used again from batch to batch of a task."""
    got = _SPACE.get((name, k))
    if got is None or len(got) < rows:
        got = _SPACE[name, k] = np.empty((-(-rows // 50_000) * 50_000, k))
    return got[:rows]


def _give_back() -> None:
    """Work arrays, Arrow's spare memory and what the C library holds of freed arrays, which it keeps up to 32 MB each."""
    _SPACE.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _released(run):
    """Gives spare memory back when a task ends: its Python worker stays."""

    def whole(batches):
        rows = run(batches)
        try:
            yield from rows
        finally:
            rows.close()
            del rows
            _give_back()

    return whole


def _add_by_symbol(out: np.ndarray, ids: np.ndarray, shares: np.ndarray) -> None:
    """Adds the rows of each id to its column of `out` (states, ids). Takes the place of the emissions of `posteriors`, which are done with when it yields."""
    size = out.shape[1]
    rows = max(TURN, 4 * size)
    for lo in range(0, len(ids), rows):
        part = ids[lo : lo + rows].astype(np.intp)
        columns = _space("shown", len(part), len(out)).reshape(len(out), -1)
        for at in range(0, len(part), TURN):  # few rows at a time, which stay in the cache
            columns[:, at : at + TURN] = shares[lo + at : lo + min(at + TURN, len(part))].T
        for sums, column in zip(out, columns):
            sums += np.bincount(part, column, size)


class Packed:
    """Sequences, longest first, laid out step by step: the tokens of step t are the rows off[t] to off[t] + live[t]."""

    def __init__(self, seqs: list[np.ndarray]):
        sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
        longest, n = int(sizes[0]), int(sizes.sum())
        live = np.searchsorted(-sizes, -np.arange(longest), side="left")
        off = np.concatenate([[0], np.cumsum(live)])
        first = np.cumsum(sizes) - sizes
        step = np.arange(n) - np.repeat(first, sizes)
        self.pos = off[step] + np.repeat(np.arange(len(seqs)), sizes)  # of the tokens, text by text
        self.flat = np.concatenate(seqs)
        self.ids = self.laid_out(self.flat)
        self.first, self.sizes, self.last = first, sizes, off[sizes - 1] + np.arange(len(seqs))
        self.live, self.off, self.longest = [*live.tolist(), 0], off.tolist(), longest
        self.turns = np.flatnonzero(np.diff(live)) + 1  # steps with fewer sequences than the one before

    def runs(self, a: int, b: int) -> list[tuple[int, int, int, int]]:
        """Of the steps a to b, ranges with as many sequences in each step, their number and the first row."""
        cuts = [a, *self.turns[np.searchsorted(self.turns, a, side="right") : np.searchsorted(self.turns, b)].tolist(), b]
        return [(s, e, self.live[s], self.off[s]) for s, e in zip(cuts, cuts[1:])]

    def laid_out(self, flat: np.ndarray) -> np.ndarray:
        """What the tokens have, text by text, as rows of the layout."""
        out = np.empty(len(flat), flat.dtype)
        out[self.pos] = flat
        return out

    def stretches(self) -> list[tuple[int, int]]:
        """Ranges of steps of at most `BATCH` tokens (or one step)."""
        out, at = [], 0
        while at < self.longest:
            to = int(np.searchsorted(self.off, self.off[at] + BATCH, side="right")) - 1
            to = min(self.longest, max(at + 1, to))
            out.append((at, to))
            at = to
        return out


def batches_of(seqs: list[np.ndarray]):
    """Places of sequences of like length, longest first, `BATCH` tokens at a time."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    held, size = [], 0
    for i in order:
        if held and size + len(seqs[i]) > BATCH:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(seqs[i])
    if held:
        yield held


class Hmm:
    """start (k), move (k, k), emit (symbols, k): emit[g] is what the states give to symbol g."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def fresh(cls, mass: np.ndarray, states: int, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        share = mass / mass.sum()
        emit = share[:, None] * np.exp(rng.normal(0, 0.8, (len(mass), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    def _lift(self) -> tuple[np.ndarray, np.ndarray]:
        """Emissions over their mean, so that products stay near one, and log10 of the mean."""
        mean = self.emit.mean(1)
        mean[mean <= 0] = 1.0
        return self.emit / mean[:, None], np.log10(mean)

    def _alphas(self, pack: Packed, lift: np.ndarray, a: int, b: int, before: np.ndarray | None, logs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, dict]:
        """Emissions and alphas of the steps a to b, and by what some steps were scaled."""
        live, off, base = pack.live, pack.off, pack.off[a]
        size, k = off[b] - base, lift.shape[1]
        shown = np.take(lift, pack.ids[base : off[b]], axis=0, out=_space("shown", size, k), mode="clip")
        out, scales = _space("alphas", size, k), {}
        for s, e, n, o in pack.runs(a, b):
            rows = slice(o - base, o - base + (e - s) * n)
            before = None if before is None else before[:n]
            for t, x, now in zip(range(s, e), shown[rows].reshape(e - s, n, k), out[rows].reshape(e - s, n, k)):
                if before is not None:
                    np.dot(before, self.move, out=now)
                    np.multiply(now, x, out=now)
                else:
                    np.multiply(self.start, x, out=now)
                if t % RESCALE == RESCALE - 1:
                    scale = np.maximum(now.sum(1), 1e-300)
                    now /= scale[:, None]
                    scales[t] = scale
                    if logs is not None:
                        logs[:n] += np.log10(scale)
                before = now
        return shown, out, scales

    def _forward(self, pack: Packed, lift: np.ndarray, mean: np.ndarray, keep: bool):
        """log10 likelihoods, the last alphas' sums, the alphas before each stretch and (`keep`) the last stretch's arrays."""
        logs, sums, edges, got = np.zeros(len(pack.sizes)), np.zeros(len(pack.sizes)), [], None
        for a, b in pack.stretches():
            edges.append((a, b, None if got is None else got[1][pack.off[a - 1] - got[3] :].copy()))
            base = pack.off[a]
            got = (*self._alphas(pack, lift, a, b, edges[-1][2], logs), base)
            ends = np.flatnonzero((pack.last >= base) & (pack.last < pack.off[b]))
            sums[ends] = got[1][pack.last[ends] - base].sum(1)
        logs = logs + np.log10(np.maximum(sums, 1e-300)) + np.add.reduceat(mean[pack.flat], pack.first)
        return logs, sums, edges, got if keep else None

    def log10_likelihood(self, seqs: list[np.ndarray], lifted: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Scaled forward recursion over whole sequences, many at a time; `lifted` may stand for the model's emissions."""
        out = np.zeros(len(seqs))
        lift, mean = lifted or self._lift()
        for part in batches_of(seqs):
            out[part] = self._forward(Packed([seqs[i] for i in part]), lift, mean, False)[0]
        return out

    def posteriors(self, pack: Packed, lift: np.ndarray, mean: np.ndarray):
        """Yields (first row, ids, state shares) for stretches of a layout, from the last to the first; then returns sums: start, move, log-likelihood."""
        k = len(self.start)
        logs, sums, edges, got = self._forward(pack, lift, mean, True)
        back, moves, starts, ahead, carried = np.ascontiguousarray(self.move.T), np.zeros((k, k)), np.zeros(k), None, None
        live, off = pack.live, pack.off
        for a, b, before in reversed(edges):
            shown, alphas, scales, base = got if got is not None else (*self._alphas(pack, lift, a, b, before, None), off[a])
            got = None
            share = _space("share", len(alphas), k)  # betas at first
            ends = np.flatnonzero((pack.last >= base) & (pack.last < off[b]))
            share[pack.last[ends] - base] = 1 / np.maximum(sums[ends], 1e-300)[:, None]
            if carried is not None:
                last = off[b - 1] - base
                share[last : last + len(carried)] = carried
            for t, scale in scales.items():
                shown[off[t] - base : off[t] - base + live[t]] /= scale[:, None]
            for s, e, n, o in reversed(pack.runs(a, b)):
                rows = slice(o - base, o - base + (e - s) * n)
                before = off[s - 1] - base
                rest = share[rows].reshape(e - s, n, k)
                to = share[before : before + n] if s > a else np.empty((n, k))
                for now, beta, to in zip(shown[rows].reshape(e - s, n, k)[::-1], rest[::-1], [*rest[-2::-1], to] if e - s > 1 else [to]):
                    np.multiply(now, beta, out=now)
                    np.dot(now, back, out=to)
                carried = to
            np.multiply(alphas, share, out=share)
            n0 = live[a]
            steps = np.array(live[a:b])
            if b - a > 1:
                prev = np.arange(n0, len(alphas)) - np.repeat(steps[:-1], steps[1:])
                for lo in range(0, len(prev), 8 * TURN):
                    at = prev[lo : lo + 8 * TURN]
                    moves += np.take(alphas, at, axis=0, out=_space("before", len(at), k), mode="clip").T @ shown[n0 + lo : n0 + lo + len(at)]
            if ahead is not None:
                last = off[b - 1] - base
                moves += alphas[last : last + len(ahead)].T @ ahead
            ahead = shown[:n0].copy() if a else None
            if not a:
                starts += share[:n0].sum(0)
            yield base, pack.ids[base : off[b]], share
        return starts, moves * self.move, float(logs.sum())

    def expected(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (start, move, emit) and the log-likelihood of whole sequences, by forward-backward."""
        k = len(self.start)
        starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape[::-1]), 0.0
        lift, mean = self._lift()
        for part in batches_of(seqs):
            run = self.posteriors(Packed([seqs[i] for i in part]), lift, mean)
            while True:
                try:
                    _, ids, share = next(run)
                except StopIteration as done:
                    s, m, logs = done.value
                    break
                _add_by_symbol(emits, ids, share)
            starts, moves, total = starts + s, moves + m, total + logs
        return starts, moves, emits.T, total

    def state_shares(self, seqs: list[np.ndarray]):
        """Yields (place, shares (tokens, k)): the states' posterior shares of each sequence."""
        lift, mean = self._lift()
        for part in batches_of(seqs):
            pack = Packed([seqs[i] for i in part])
            whole = _space("whole", len(pack.ids), len(self.start))
            for base, ids, share in self.posteriors(pack, lift, mean):
                whole[base : base + len(ids)] = share
            flat = whole[pack.pos]
            for i, a, n in zip(part, pack.first, pack.sizes):
                yield i, flat[a : a + n]

    @classmethod
    def from_counts(cls, starts, moves, emits, mass) -> Hmm:
        share = mass / mass.sum()
        emit = emits + PRIOR * share[:, None]
        move = moves + 0.1
        start = starts + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _expectation(shared, states: int):
    def run(batches):
        model = shared.value
        starts, moves, emits, held, size = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit), [], 0

        def flush():
            nonlocal starts, moves, emits
            s, m, e, _ = model.expected(held)
            starts, moves, emits = starts + s, moves + m, emits + e
            held.clear()

        for batch in batches:
            for seq in batch.column("seq"):
                held.append(np.frombuffer(seq.as_buffer(), "<u2"))
                size += len(held[-1])
                if size >= HOLD:
                    flush()
                    size = 0
        if held:
            flush()
        at = np.flatnonzero(emits.any(1))
        ids = np.concatenate([at, np.arange(-states - 1, 0)])
        rows = np.vstack([emits[at], moves, starts[None, :]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(rows[:, s]) for s in range(states)]], names=["g", *[f"s{s}" for s in range(states)]])

    return _released(run)


def _summed(got: DataFrame, key: str, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sums = got.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols]).toArrow()
    return sums.column(key).to_numpy(), np.column_stack([sums.column(c).to_numpy() for c in cols]) if sums.num_rows else np.zeros((0, len(cols)))


def baum_welch_round(model: Hmm, seqs: DataFrame, mass: np.ndarray) -> Hmm:
    """One round over `seqs(seq)`: expected counts are summed over partitions by class."""
    states = len(model.start)
    shared = seqs.sparkSession.sparkContext.broadcast(model)
    cols = [f"s{s}" for s in range(states)]
    got = map_batches(seqs.select("seq"), _expectation(shared, states), "g int, " + ", ".join(f"{c} double" for c in cols))
    g, rows = _summed(got, "g", cols)  # classes + states + 1 rows at most
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((len(mass), states))
    for i, row in zip(g.tolist(), rows):
        if i >= 0:
            emits[i] = row
        elif i == -1:
            starts = row
        else:
            moves[i + states + 1] = row
    shared.unpersist()
    return Hmm.from_counts(starts, moves, emits, mass)


def _in_texts(batch, own: int):
    """Of a batch of coded texts: classes and places of tokens in the dictionary, or past it."""
    out = []
    for seq, fine in zip(batch.column("seq"), batch.column("fine")):
        classes = np.frombuffer(seq.as_buffer(), "<u2")
        at = classes.astype(np.uint32)
        at[classes > own] = np.frombuffer(fine.as_buffer(), "<u4")
        out.append((classes, at))
    return out


def _held_texts(batches, own: int, *more: str):
    """Lists of ((classes, places), other columns) of about `HOLD` tokens, so that texts of like length meet."""
    held, size = [], 0
    for batch in batches:
        for row in zip(_in_texts(batch, own), *[batch.column(c) for c in more]):
            held.append(row)
            size += len(row[0][0])
            if size >= HOLD:
                yield held
                held, size = [], 0
    if held:
        yield held


def _dictionary_counts(shared, states: int):
    """Expected counts of start (g = -1), move (below) and dictionary words by place; those of classes of endings by the places past the dictionary."""

    def run(batches):
        model, own, size = shared.value
        lift, mean = model._lift()
        sums, starts, moves = np.zeros((states, size + 2 + ENDINGS)), np.zeros(states), np.zeros((states, states))
        for texts in _held_texts(batches, own):
            texts = [t for (t,) in texts]
            for part in batches_of([c for c, _ in texts]):
                pack = Packed([texts[i][0] for i in part])
                places = pack.laid_out(np.concatenate([texts[i][1] for i in part]))
                run = model.posteriors(pack, lift, mean)
                while True:
                    try:
                        base, ids, share = next(run)
                    except StopIteration as done:
                        starts, moves = starts + done.value[0], moves + done.value[1]
                        break
                    at = places[base : base + len(ids)]
                    fine = np.where(at <= size, at, size + 1 + ENDINGS)  # words past the dictionary are left to their own pass: the last column
                    _add_by_symbol(sums, fine, share)
                    ends = np.flatnonzero(ids > own)
                    _add_by_symbol(sums[:, size + 1 : -1], ids[ends].astype(np.int64) - own - 1, share[ends])
        at = np.flatnonzero(sums[:, :-1].any(0))
        g = np.concatenate([at, np.arange(-states - 1, 0)])
        rows = np.hstack([sums[:, at], moves.T, starts[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), *[pa.array(rows[s]) for s in range(states)]], names=["g", *[f"s{s}" for s in range(states)]])

    return _released(run)


def _pack(shares: np.ndarray) -> list[np.ndarray]:
    """Rows of shares as numbers of 16 bits, four to a long."""
    units = np.rint(np.clip(shares, 0, 1) * 65535).astype(np.uint64)
    units = np.pad(units, ((0, 0), (0, -units.shape[1] % 4)))
    return [(units[:, i] << 48 | units[:, i + 1] << 32 | units[:, i + 2] << 16 | units[:, i + 3]).view(np.int64) for i in range(0, units.shape[1], 4)]


def _unpacked(packed: Column, i: int) -> Column:
    return F.shiftrightunsigned(packed, 48 - 16 * (i % 4)).bitwiseAND(F.lit(65535))


def _rare_words(shared, states: int):
    """(rid, j, token, n, p0, ...): each text's words past the dictionary; n and the mean shares of states only of training texts."""

    def run(batches):
        model, own, size = shared.value
        lift, mean = model._lift()
        for held in _held_texts(batches, own, "rid", "held_out", "rare"):
            counts = np.array([len(words.values) for *_, words in held])
            first = np.cumsum(counts) - counts
            n, sums = np.zeros(counts.sum(), np.int64), np.zeros((states, counts.sum()))
            learn = [i for i, (*_, out, _) in enumerate(held) if not out.as_py()]
            for part in batches_of([held[i][0][0] for i in learn]):
                part = [learn[i] for i in part]
                pack = Packed([held[i][0][0] for i in part])
                at = np.concatenate([held[i][0][1] for i in part]).astype(np.int64)
                word = pack.laid_out(np.where(at > size, at - size - 1 + np.repeat(first[part], pack.sizes), -1))
                for base, ids, share in model.posteriors(pack, lift, mean):
                    here = word[base : base + len(ids)]
                    past = np.flatnonzero(here >= 0)
                    n += np.bincount(here[past], minlength=len(n))
                    _add_by_symbol(sums, here[past], share[past])
            packs = _pack((sums / np.maximum(n, 1)).T)
            rid = np.repeat(np.array([rid.as_py() for _, rid, *_ in held], np.int64), counts)
            j = np.arange(counts.sum()) - np.repeat(first, counts)
            words = pa.concat_arrays([words.values for *_, words in held])
            for lo in range(0, len(j), 100_000):
                cut = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[cut]), pa.array(j[cut].astype(np.int32)), words[cut], pa.array(n[cut]), *[pa.array(p[cut]) for p in packs]],
                    names=["rid", "j", "token", "n", *[f"p{i}" for i in range(len(packs))]],
                )

    return _released(run)


class Emissions:
    """Emissions of the dictionary's words, and what gives those of other words."""

    def __init__(self, vocabulary: Vocabulary, places: np.ndarray, counts: np.ndarray):
        k = counts.shape[1]
        self.own, self.size = vocabulary.own, vocabulary.size
        whole, starts, moves = np.zeros((self.size + 1 + ENDINGS, k)), np.zeros(k), np.zeros((k, k))
        for g, row in zip(places[places < 0].tolist(), counts[places < 0]):
            if g == -1:
                starts = row
            else:
                moves[g + k + 1] = row
        whole[places[places >= 0]] = counts[places >= 0]
        words, ends = whole[: self.size + 1], whole[self.size + 1 :]
        seen = np.zeros((vocabulary.classes, k))
        single = 1 + min(self.own, self.size)
        seen[:single], seen[1 + self.own :] = words[:single], ends
        total = seen.sum(1, keepdims=True)
        self.share = np.where(total > 0, seen / np.where(total > 0, total, 1), 1 / k)  # of states, by class
        self.norm = seen.sum(0) + 0.5 * (self.share * vocabulary.distinct[:, None]).sum(0)
        emit = (words + 0.5 * self.share[vocabulary.cls]) / self.norm
        self.model = Hmm((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emit)

    def others(self, classes: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        total = shares.sum(1, keepdims=True)
        return (counts[:, None] * np.divide(shares, total, out=np.zeros_like(shares), where=total > 0) + 0.5 * self.share[classes]) / self.norm


def _forward(shared):
    """n_known, logs (of the base score) and forward (of the model) of whole texts."""

    def run(batches):
        emissions = shared.value
        model, size, k = emissions.model, emissions.size, len(emissions.model.start)
        longs, wide = -(-k // 4), model._lift()  # those of a batch's own words stand behind the dictionary's
        for batch in batches:
            texts = _in_texts(batch, emissions.own)
            known, logs = batch.column("n_inside").to_numpy().copy(), batch.column("logs").to_numpy().copy()
            met = batch.column("met")
            each = met.flatten()
            sizes = pc.fill_null(pc.list_value_length(met), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            c = each.field("c").to_numpy(zero_copy_only=False).astype(np.float64)
            packs = [each.field(f"q{i}").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(longs)]
            shares = np.column_stack([(packs[s // 4] >> np.uint64(48 - 16 * (s % 4)) & np.uint64(65535)).astype(np.float64) for s in range(k)]) if len(c) else np.zeros((0, k))
            classes, seqs = np.zeros(len(c), np.int64), []
            for i, (cls, at) in enumerate(texts):
                past = np.flatnonzero(at > size)
                if len(past):
                    place = first[i] + at[past].astype(np.int64) - size - 1
                    classes[place] = cls[past]
                    known[i] += int((c[place] > 0).sum())
                    logs[i] += float(np.log10(c[place] + 0.5).sum())
                    at[past] = size + 1 + place
                seqs.append(at)
            if size + 1 + len(c) > len(wide[1]):
                wide = tuple(np.concatenate([x[: size + 1], np.empty((2 * len(c), *x.shape[1:]))]) for x in wide)
            for x, more in zip(wide, Hmm(model.start, model.move, emissions.others(classes, c, shares))._lift()):
                x[size + 1 : size + 1 + len(c)] = more
            keep = ["doc_id", "held_out", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(known), pa.array(logs), pa.array(model.log10_likelihood(seqs, wide))], names=[*keep, "n_known", "logs", "score"])

    return _released(run)


def train(docs: DataFrame, held_out: Column, text_col: str, id_col: str, states: int, rounds: int, own: int, dictionary: int):
    """(coded texts, vocabulary, class model)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("_text"))
    counts = map_batches(rows.where(~F.col("held_out")).select("_text"), _released(_counter), "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))
    counts = materialize(counts, "lm-counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == END, F.col("c"))), F.lit(0))).first()
    top = counts.where(F.col("token") != END).orderBy(F.desc("c"), "token").limit(dictionary).toArrow()
    vocabulary = Vocabulary(pa.concat_arrays([pa.array([], pa.string()), *top.column("token").cast(pa.string()).chunks]), top.column("c").to_numpy(), ends, n, v, own)
    shared = spark.sparkContext.broadcast(vocabulary)
    tails = map_batches(counts, _endings(shared), "g int, n double, v double").groupBy("g").agg(F.sum("n"), F.sum("v")).toArrow()
    tails = [tails.column(i).to_numpy() for i in range(3)]
    ending = tails[0] > own
    vocabulary.add_endings(*[x[ending] for x in tails])
    discard(counts)
    coded = map_batches(
        rows.withColumn("rid", F.monotonically_increasing_id()), _encoder(shared),
        "doc_id long, held_out boolean, rid long, n_tokens long, n_inside long, logs double, seq binary, fine binary, rare array<string>",
    )
    coded = materialize(coded, "lm-coded")
    shared.unpersist()
    model = Hmm.fresh(vocabulary.mass, states)
    seqs = coded.where(~F.col("held_out")).select("seq")
    for _ in range(rounds if ends else 0):
        model = baum_welch_round(model, seqs, vocabulary.mass)
    return coded, vocabulary, model


def score(
    docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", states: int = STATES, rounds: int = ROUNDS, own: int = OWN_CLASSES, dictionary: int = DICTIONARY
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; learns where `held_out` is false."""
    spark = docs.sparkSession
    coded, vocabulary, model = train(docs, held_out, text_col, id_col, states, rounds, own, dictionary)
    shared = spark.sparkContext.broadcast((model, vocabulary.own, vocabulary.size))
    cols = [f"s{s}" for s in range(states)]
    learn = coded.where(~F.col("held_out")).select("seq", "fine")
    sums = _summed(map_batches(learn, _dictionary_counts(shared, states), "g int, " + ", ".join(f"{c} double" for c in cols)), "g", cols)
    emissions = spark.sparkContext.broadcast(Emissions(vocabulary, *sums))

    packs = [f"p{i}" for i in range(-(-states // 4))]
    rare = map_batches(
        coded.where(F.size("rare") > 0).select("rid", "held_out", "seq", "fine", "rare"), _rare_words(shared, states), "rid long, j int, token string, n long, " + ", ".join(f"{p} long" for p in packs)
    )
    whole = Window.partitionBy("token")
    sums = [F.sum(F.col("n") * _unpacked(F.col(packs[s // 4]), s)).over(whole).alias(f"s{s}") for s in range(states)]
    rare = rare.select("rid", "j", F.sum("n").over(whole).alias("c"), *sums)
    units = [F.coalesce(F.round(F.try_divide(F.col(c) * 65535.0, F.greatest(*cols) if len(cols) > 1 else F.col(c))), F.lit(0.0)).cast("long") for c in cols]
    units += [F.lit(0).cast("long")] * (-states % 4)
    packed = [F.shiftleft(units[i], 48).bitwiseOR(F.shiftleft(units[i + 1], 32)).bitwiseOR(F.shiftleft(units[i + 2], 16)).bitwiseOR(units[i + 3]) for i in range(0, len(units), 4)]
    rare = rare.select("rid", F.struct("j", "c", *[p.alias(f"q{i}") for i, p in enumerate(packed)]).alias("w"))
    met = rare.groupBy("rid").agg(F.sort_array(F.collect_list("w")).alias("met"))  # a text's own words
    texts = coded.join(met, "rid", "left").select("doc_id", "held_out", "n_tokens", "n_inside", "logs", "seq", "fine", "met")
    out = map_batches(texts, _forward(emissions), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * vocabulary.log_total).alias("base_score"), "score",
    )
