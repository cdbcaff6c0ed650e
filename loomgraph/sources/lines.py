"""Lines that are whole declarations at the top of a file, many at once.

A line's shape is what stays of it when its names are taken out. One line of a shape is read by the scanner, with made-up names; where each fact's texts and
places come from is then known for all lines of that shape, whose names Arrow takes out. The facts are those of the scanner, because

* words that the scanner compares with anything (`RESERVED`) are part of the shape, as are numbers; lines with quotes, comments, attributes or other characters than `_PLAIN` have none;
* a shape is only used if its brackets close, it ends with `}` or `;`, and the scanner asked for no token behind it.

Everything else is read by the scanner from there to the start of a later line at the top of the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .frontends import Fact, braces

BLOCK = 1 << 21  # bytes that are split into lines at once
SHAPES, WORDS, LONG = 64, 48, 2000  # shapes that are kept; names and bytes of a line that has one
RUN = 64  # lines that make a change from the scanner worth it
_PLAIN = re.compile(r"[A-Za-z0-9_ \t{}()\[\]<>:;,.&=*+|!?%^~-]+")
_MADE = re.compile(r"zq(\d+)zq")


def _compared() -> frozenset[str]:
    """All words in the scanner's code and tables."""
    out: set[str] = set()

    def see(x) -> None:
        if isinstance(x, str):
            out.update(re.findall(r"\w+", x))
        elif isinstance(x, dict):
            see(list(x.items()))
        elif isinstance(x, (tuple, list, set, frozenset)):
            for y in x:
                see(y)
        elif isinstance(x, braces.Spec):
            see(list(vars(x).values()))
        elif hasattr(x, "co_consts"):
            see(x.co_consts)
        elif getattr(x, "__module__", None) == braces.__name__ and isinstance(x, type):
            see([y for y in vars(x).values() if not isinstance(y, str)])
        elif hasattr(x, "__code__"):
            see(x.__code__.co_consts)

    see([x for name, x in vars(braces).items() if name not in ("_TOKENS", "_CHAR") and not name.startswith("__")])
    return frozenset(out)


RESERVED = _compared()
_RESERVED = pa.array(sorted(RESERVED))


class _Watched(list):
    """Tokens of which `n` belong to the line; `beyond` collects what is asked for behind them."""

    def __getitem__(self, i):
        last = (len(self) if i.stop is None else i.stop) - 1 if isinstance(i, slice) else i
        if last >= self.n or last < 0:
            self.beyond.append(last)
        return super().__getitem__(i)


def _scanned(line: str, language: str) -> list[Fact] | None:
    """The root and the line's facts, places counted from 2 and lines from 2, or None if they may depend on what follows."""
    s = braces.Scanner.__new__(braces.Scanner)
    s.begin(f";\n{line}\n; ;", language)
    s.read(0, 1, 1, None)
    n = len(s.toks) - 2
    closers = sum(t.kind == "op" and t.text in ")]}" for t in s.toks)
    if n < 2 or s.toks[n - 1].text not in ("}", ";") or s.open < len(s.toks) or closers != len(s.close):
        return None
    s.toks = _Watched(s.toks)
    s.toks.n, s.toks.beyond = n, []
    s.body(1, len(s.toks), 0, "root", [], n - 1)
    return s.out if s.toks.beyond == [n] and all(f.line == 2 for f in s.out[1:]) else None


@dataclass
class Shape:
    pattern: str
    facts: list[Fact]  # with made-up names
    rows: list[tuple]  # what is above each
    ends: list[int]  # of the made-up names

    def place(self, p: int) -> tuple[int, int]:
        """A place in the made-up line as a number and how many names' lengths to add to it."""
        k = sum(e <= p - 2 for e in self.ends)
        return p - 2 - sum(len(f"zq{j}zq") for j in range(k)), k


def _parts(text: str) -> list[str | int] | None:
    """A dotted text as names by number and fixed words."""
    out = [int(m.group(1)) if (m := _MADE.fullmatch(x)) else x for x in text.split(".")]
    return None if any(isinstance(x, str) and "zq" in x for x in out) else out


def _texts(f: Fact) -> list[str]:
    return [x for x in (f.name, f.callee, *f.types, *f.contracts, *f.decorators) if x is not None]


def learn(line: str, language: str, above: Callable) -> Shape | None:
    """The shape of a line, if it has one."""
    if len(line) > LONG or "zq" in line or not _PLAIN.fullmatch(line):
        return None
    words = [t for t in braces.lex(line) if t.kind == "word" and t.text not in RESERVED]
    if not 0 < len(words) <= WORDS:
        return None
    made, pattern, at, ends = "", "^", 0, []
    for k, t in enumerate(words):
        made, pattern, at = made + line[at : t.start] + f"zq{k}zq", pattern + re.escape(line[at : t.start]) + f"(?P<w{k}>[A-Za-z_][A-Za-z0-9_]*)", t.end
        ends.append(len(made))
    made, pattern = made + line[at:], pattern + re.escape(line[at:]) + "$"
    facts, own = _scanned(made, language), _scanned(line, language)
    if facts is None or own is None or any(_parts(x) is None for f in facts[1:] for x in _texts(f)):
        return None
    shape = Shape(pattern, facts, above(facts), ends)
    # the scanner's own reading of this line must be the same
    long = np.cumsum([0, *(len(t.text) for t in words)])
    back = lambda x: None if x is None else ".".join(words[p].text if isinstance(p, int) else p for p in _parts(x))
    where = lambda p: shape.place(p)[0] + int(long[shape.place(p)[1]]) + 2
    real = [
        Fact(f.kind, back(f.name), f.symbol_kind, f.parent, where(f.start), where(f.end), f.line, [back(x) for x in f.types], [back(x) for x in f.contracts], [back(x) for x in f.decorators], back(f.callee), f.names_symbol)
        for f in facts[1:]
    ]
    return shape if real == own[1:] else None


def _list(parts: list[pa.Array], m: int, kind: pa.DataType) -> pa.Array:
    n = len(parts)
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(m + 1, np.int32)), pa.array([], kind))
    return pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * n), pa.concat_arrays(parts).take(pa.array(np.arange(m * n).reshape(n, m).T.ravel())))


def _columns(unit: int, shape: Shape, first: np.ndarray, start: np.ndarray, line: np.ndarray, words: list[pa.Array]) -> Iterator[list[pa.Array]]:
    """Each fact of a shape for all its lines, of which `first` are the places of the first facts."""
    m = len(first)
    long = np.concatenate([np.zeros((1, m), np.int64), np.cumsum([pc.utf8_length(w).to_numpy() for w in words], axis=0)])
    fixed = lambda x, kind: pa.repeat(pa.scalar(x, kind), m)
    string = pa.string()

    def text(x: str | None) -> pa.Array:
        if x is None:
            return fixed(None, string)
        parts = [words[p] if isinstance(p, int) else fixed(p, string) for p in _parts(x)]
        return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, ".")

    def local(i: int | None) -> pa.Array:
        return fixed(None, pa.int32()) if i is None else fixed(0, pa.int32()) if i == 0 else pa.array(first + (i - 1), pa.int32())

    def place(p: int) -> pa.Array:
        at, k = shape.place(p)
        return pa.array(start + at + long[k], pa.int32())

    for i, f, scope, func, holder, chain, up, lookup in shape.rows[1:]:
        yield [
            fixed(unit, pa.int64()), local(i), local(f.parent), fixed(f.kind, string), text(f.name), fixed(f.symbol_kind, string), place(f.start), place(f.end), pa.array(line, pa.int32()),
            *(_list([text(x) for x in xs], m, string) for xs in (f.types, f.contracts, f.decorators)), text(f.callee), fixed(f.names_symbol, pa.bool_()), local(scope), local(func), local(holder),
            _list([local(x) for x in chain], m, pa.int32()) if chain else fixed(None, pa.list_(pa.int32())), fixed(up, string), local(lookup),
        ]


def _matched(lines: pa.Array, shapes: list[Shape], language: str, above: Callable) -> tuple[int, list[tuple[Shape, np.ndarray, list[pa.Array]]]]:
    """How many lines from the first on have a shape or are blank, and by shape which these are and their names."""
    rest = np.flatnonzero(~pc.match_substring_regex(lines, r"^[ \t]*$").to_numpy(zero_copy_only=False))
    out, todo = [], list(shapes)
    while len(rest):
        if not todo:
            shape = learn(lines[int(rest[0])].as_py(), language, above)
            if shape is None:
                break
            shapes.append(shape)
            todo.append(shape)
        shape = todo.pop(0)
        got = pc.extract_regex(lines.take(pa.array(rest)), shape.pattern)
        fits = pc.is_valid(got)
        words = [got.field(k) for k in range(got.type.num_fields)]
        for w in words:
            fits = pc.and_(fits, pc.invert(pc.is_in(w, _RESERVED)))
        ok = fits.to_numpy(zero_copy_only=False)
        if ok.any():
            out.append((shape, rest[ok], [w.filter(fits) for w in words]))
            rest = rest[~ok]
    order = {id(s): len(at) for s, at, _ in out}
    shapes.sort(key=lambda s: -order.get(id(s), 0))
    del shapes[SHAPES:]
    return int(rest[0]) if len(rest) else len(lines), out


def read(unit: int, content: bytes, language: str, above: Callable) -> Iterator[list[tuple] | list[pa.Array]]:
    """Facts of an ASCII file: lists of what `above(facts, first, root)` gives, and columns of what lines of one shape give."""
    shapes: list[Shape] = []
    root = Fact("root", None, "file", -1, 0, len(content), 1)
    head = above([root])
    yield head
    at, line, first, size = 0, 1, 1, 1 << 12
    text = None
    while at < len(content):
        block = content[at : at + BLOCK]
        if at + len(block) < len(content):
            block = block[: block.rfind(b"\n") + 1]
        rows = block.decode("ascii").split("\n")
        if len(block) and at + len(block) < len(content):
            rows.pop()  # what follows the last line break is the next block's
        run = 0
        if rows:
            lines = pa.array(rows, pa.string())
            run, found = _matched(lines, shapes, language, above)
            starts = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in rows])])
            counts = np.zeros(len(rows) + 1, np.int64)
            for shape, which, _ in found:
                counts[which + 1] = len(shape.facts) - 1
            firsts = first + np.cumsum(counts)
            for shape, which, words in found:
                n = int(np.searchsorted(which, run))
                if n and len(shape.facts) > 1:
                    yield from _columns(unit, shape, firsts[which[:n]], starts[which[:n]], line + which[:n], [w.slice(0, n) for w in words])
            at, line, first = int(starts[run]), line + run, int(firsts[run])
            if run == len(rows):
                continue
        size = min(size * 2, braces.WINDOW) if run < RUN else 1 << 12
        text = text or content.decode("ascii")
        s = braces.Scanner.__new__(braces.Scanner)
        while True:
            s.begin(text, language)
            s.out, s.before = [], first
            s.read(at, line, 0, size)
            if len(s.toks) < size:
                s.body(0, len(s.toks), 0, "root")
                yield above(s.out, first, head[0])
                return
            ends: list[tuple[int, int]] = []
            s.body(0, len(s.toks), 0, "root", ends, min(s.open, len(s.toks) - braces.AHEAD))
            begins = lambda i: text.rfind("\n", 0, s.toks[i].start) + 1  # noqa: E731, B023
            end = next(((begins(i), s.toks[i].line, n) for i, n in reversed(ends) if begins(i) > at and not text[begins(i) : s.toks[i].start].strip()), None)
            if end:
                break
            size *= 2
        yield above(s.out[: end[2]], first, head[0])
        at, line, first = end[0], end[1], first + end[2]
