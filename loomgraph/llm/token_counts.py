"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A leaf covers up to `LEAF` pre-tokens (its characters and tokens) when it is built; inner nodes hold the sums of their children.
An edit (start, stop, insert; code points of the text as it was) re-encodes only the leaves that it touches, plus
boundary context: scanning starts at the last leaf boundary whose pre-tokens cannot have looked at an edited
character, and goes on until a pre-token ends on an old leaf boundary past the edit. The scanner keeps nothing but
its position, so from there on old leaves stay valid. Leaves are found by descent, what was scanned anew is dealt over the leaves that it replaces (some may
become larger, or empty), and the sums on their paths to the root are updated: an edit costs its own leaves times the tree's height. Only where leaves would grow past
`GROWN` times their size, after large insertions, is the tree built anew.

Results equal a full encoding of the edited text (tests). Null texts are empty; an edit outside the text is clamped;
edits apply in order of position, and one that begins inside the one before it begins at its end; one that ends before it starts only inserts. Repeated rows are edited
each for itself, texts of any length whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import map_batches

LEAF = 32
GROWN = 4
LOOKAHEAD = 3  # characters past its end that the pattern may look at
CACHE = 400_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of the 50k byte-level vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a privacy scrub replaces: long hex keys, addresses of machines and people, long digit runs.
SCRUB = re.compile(r"(?P<key>\b[0-9a-f]{32,}\b)|(?P<ip>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<mail>[\w.+-]+@[\w-]+\.[\w.-]+)|(?P<number>\b\d{9,}\b)")


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of single pre-tokens, remembered up to a bound."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary
        self.scan = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        got = list(map(known.get, pieces))
        if None in got:
            if len(known) > CACHE:
                known.clear()
            for i, n in enumerate(got):
                if n is None:
                    got[i] = n = len(self.encode(pieces[i]))
                    if len(pieces[i]) <= 64:
                        known[pieces[i]] = n
        return got


class Tree:
    """Sums over leaves in a heap whose leaves are filled up to a power of two, so that positions are found by descent."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.used, self.n = len(chars), 1
        while self.n < self.used:
            self.n *= 2
        n, rest = self.n, [0] * (self.n - self.used)
        self.chars, self.tokens = [0] * n + chars + rest, [0] * n + tokens + rest
        for sums in (self.chars, self.tokens):
            for i in range(n - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.n : self.n + self.used], self.tokens[self.n : self.n + self.used]

    def find(self, pos: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character `pos`; past the end the number of leaves and of characters."""
        if pos >= self.chars[1]:
            return self.used, self.chars[1]
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if pos >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.n, start

    def start(self, leaf: int) -> int:
        if leaf >= self.used:
            return self.chars[1]
        i, start = leaf + self.n, 0
        while i > 1:
            if i % 2:
                start += self.chars[i - 1]
            i //= 2
        return start

    def update(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.n
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def replace(self, swaps: list[tuple[int, int, list[int], list[int]]]) -> Tree:
        """Leaves i to j - 1 hold `lens` characters and `sums` tokens from now on; the tree, or a new one if leaves would grow too large."""
        if any(len(lens) > GROWN * (j - i) for i, j, lens, _ in swaps):
            chars, tokens = self.leaves()
            for i, j, lens, sums in reversed(swaps):
                chars[i:j], tokens[i:j] = lens, sums
            full = [x for x, c in enumerate(chars) if c]
            return Tree([chars[x] for x in full], [tokens[x] for x in full])
        for i, j, lens, sums in swaps:
            for x in range(i, j):  # the pieces dealt evenly
                a, b = (x - i) * len(lens) // (j - i), (x - i + 1) * len(lens) // (j - i)
                self.update(x, sum(lens[a:b]), sum(sums[a:b]))
        return self

    @property
    def total(self) -> int:
        return self.tokens[1]


def leaves_of(counter: Counter, text: str) -> tuple[list[int], list[int], int]:
    pieces = counter.scan.findall(text)
    counts = counter.counts(pieces)
    at = range(0, len(pieces), LEAF)
    return [len("".join(pieces[i : i + LEAF])) for i in at], [sum(counts[i : i + LEAF]) for i in at], len(pieces)


def edit(counter: Counter, text: str, tree: Tree, edits: list[tuple[int, int, str]]) -> tuple[str, Tree, int]:
    """The edited text, its tree and how many characters were encoded anew."""
    size, clean = len(text), []
    for a, b, put in sorted(edits):
        a = max(clean[-1][1] if clean else 0, min(a, size))
        clean.append((a, max(a, min(b, size)), put))
    if not clean:
        return text, tree, 0
    parts, last = [], 0
    for a, b, put in clean:
        parts += [text[last:a], put]
        last = b
    new = "".join([*parts, text[last:]])
    swaps: list[tuple[int, int, list[int], list[int]]] = []  # old leaves [i, j) and what replaces them
    moved, redone, k = 0, 0, 0
    while k < len(clean):
        a, b, put = clean[k]
        i, first = tree.find(max(0, a - LOOKAHEAD))
        if swaps and i < swaps[-1][1]:
            i = swaps[-1][1]
            first = tree.start(i)
        at = start = first + moved
        shift = moved + len(put) - (b - a)
        done_at, k = b + shift, k + 1
        lens: list[int] = []
        pieces: list[str] = []
        j = tree.used
        pos = at
        while pos < len(new):
            m = counter.scan.match(new, pos)
            pieces.append(m.group())
            pos = m.end()
            while k < len(clean) and pos + LOOKAHEAD > clean[k][0] + shift:  # the scan ran into the next edit
                a2, b2, put2 = clean[k]
                shift += len(put2) - (b2 - a2)
                done_at, k = b2 + shift, k + 1
            if pos >= done_at:
                hit, bound = tree.find(pos - shift)
                if bound == pos - shift:
                    j = hit
                    break
        counts = counter.counts(pieces)
        cut = range(0, len(pieces), LEAF)
        lens = [len("".join(pieces[x : x + LEAF])) for x in cut]
        swaps.append((i, j, lens, [sum(counts[x : x + LEAF]) for x in cut]))
        redone += pos - start
        moved = shift
    return new, tree.replace(swaps), redone


def scrub_edits(text: str) -> list[tuple[int, int, str]]:
    if not any(map(text.__contains__, "0123456789@")) and not re.search("[a-f]{32}", text):
        return []
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in SCRUB.finditer(text)]


_BUILT = "n_tokens long, n_pretokens long, leaf_chars array<int>, leaf_tokens array<int>"


def _builder(path: str, text_col: str):
    def run(batches):
        counter = Counter(path)
        for batch in batches:
            got = [leaves_of(counter, t or "") for t in batch.column(text_col).to_pylist()]
            new = [pa.array([sum(t) for _, t, _ in got], pa.int64()), pa.array([n for *_, n in got], pa.int64()), pa.array([c for c, *_ in got], pa.list_(pa.int32())), pa.array([t for _, t, _ in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "n_tokens", "n_pretokens", "leaf_chars", "leaf_tokens"])

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def build_trees(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with n_tokens, n_pretokens and the leaves of its tree (leaf_chars, leaf_tokens)."""
    docs = docs.drop("n_tokens", "n_pretokens", "leaf_chars", "leaf_tokens")
    return map_batches(docs, _builder(vocabulary, text_col), f"{_ddl(docs)}, {_BUILT}")


def _editor(path: str, text_col: str, edits_col: str | None):
    def run(batches):
        counter = Counter(path)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            trees = zip(batch.column("leaf_chars").to_pylist(), batch.column("leaf_tokens").to_pylist())
            asked = batch.column(edits_col).to_pylist() if edits_col else [None] * len(texts)
            new, total, redone, n_edits, sizes, chars, tokens = [], [], [], [], [], [], []
            for text, (c, t), e in zip(texts, trees, asked):
                text = text or ""
                e = scrub_edits(text) if edits_col is None else [(x["start"], x["stop"], x["insert"] or "") for x in e or ()]
                out, tree, n = edit(counter, text, Tree(c, t), e)
                new.append(out)
                total.append(tree.total)
                redone.append(n)
                n_edits.append(len(e))
                sizes.append(len(out))
                lc, lt = tree.leaves()
                chars.append(lc)
                tokens.append(lt)
            keep = [n for n in batch.schema.names if n not in ("leaf_chars", "leaf_tokens", text_col, edits_col)]
            extra = {text_col: pa.array(new, pa.string()), "n_edits": pa.array(n_edits, pa.int64()), "edited_tokens": pa.array(total, pa.int64()), "edited_chars": pa.array(sizes, pa.int64()), "reencoded_chars": pa.array(redone, pa.int64()), "leaf_chars": pa.array(chars, pa.list_(pa.int32())), "leaf_tokens": pa.array(tokens, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *extra.values()], names=[*keep, *extra])

    return run


def apply_edits(trees: DataFrame, text_col: str = "text", edits_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Trees after edits: edits_col holds array<struct<start:int, stop:int, insert:string>>; None: the privacy scrub's edits.

    The text becomes the edited text; n_tokens stays that of the text before; edited_tokens, edited_chars, n_edits,
    reencoded_chars and the new leaves are added.
    """
    trees = trees.drop("n_edits", "edited_tokens", "edited_chars", "reencoded_chars")
    rest = trees.drop("leaf_chars", "leaf_tokens", text_col, *([edits_col] if edits_col else []))
    out = f"{_ddl(rest)}, `{text_col}` string, n_edits long, edited_tokens long, edited_chars long, reencoded_chars long, leaf_chars array<int>, leaf_tokens array<int>"
    return map_batches(trees, _editor(vocabulary, text_col, edits_col), out)
