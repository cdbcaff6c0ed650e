"""Lines of one shape read at once: the facts of the scanner."""

import random
import time

import pytest

from loomgraph.plans import project
from loomgraph.sources import lines
from loomgraph.sources.frontends import braces

from .test_pieces import ITEMS

WHOLE = ["pub fn o%d(buyer: C%d, seller: r0::n1::S%d) -> Home { r0::n1::make(); seller.sell(); }", "pub struct S%d { pub home: Home }", "impl Sells for S%d { fn sell(&self) { make(); } }", "pub fn p%d<T: B>(x: T) { self::q(x); }", "class A%d extends B { f(c: D) { g(); } }", "int m%d(int a) { return h(a); }", "", "  "]


def rows(text, language, by_lines=True, monkeypatch=None):
    out = [r for b in project._parser([project.pa.RecordBatch.from_pydict({"unit_id": [3], "content": [text.encode()], "lang": [language]})]) for r in b.to_pylist()]
    return sorted(out, key=lambda r: r["local_id"])


def scanned(text, language):
    facts = project._placed(braces.Scanner(text, language).run())
    names = [c.split()[0] for c in project._FACTS.split(", ")]
    return [dict(zip(names, (3, i, f.parent, f.kind, f.name, f.symbol_kind, f.start, f.end, f.line, f.types, f.contracts, f.decorators, f.callee, f.names_symbol, *near))) for i, f, *near in facts]


@pytest.mark.parametrize("language", ITEMS)
def test_lines_are_the_whole(language, monkeypatch):
    monkeypatch.setattr(braces, "AHEAD", 420)
    rng = random.Random(5)
    names = ["a", "self", "fn", "new", "match", "Self", "z9", "where", "struct", "_x", "if", "make"]
    for round_ in range(40):
        monkeypatch.setattr(lines, "BLOCK", rng.choice((300, 5000, 1 << 21)))
        texts = []
        for _ in range(rng.randrange(250)):
            item = rng.choice(WHOLE if round_ % 2 or rng.random() < 0.7 else [x for x in ITEMS[language] if round_ % 3 or x not in ("}", ")")])
            while "%d" in item:
                item = item.replace("%d", str(rng.randrange(10 ** rng.randrange(1, 6))), 1)
            if rng.random() < 0.1:
                item = item.replace("seller", rng.choice(names)).replace("Home", rng.choice(names)).replace("make", rng.choice(names))
            texts.append(item)
        text = "\n".join(texts) + rng.choice(("", "\n", "\nmod open { fn f() {"))
        assert rows(text, language) == scanned(text, language)


def test_the_scanner_reads_one_line_of_a_shape(monkeypatch):
    asked, scan = [], lines._scanned
    monkeypatch.setattr(lines, "_scanned", lambda line, language: asked.append(line) or scan(line, language))
    monkeypatch.setattr(braces.Scanner, "run", lambda self: 1 / 0)
    text = "\n".join(WHOLE[0].replace("%d", str(i)) for i in range(20000))
    began = time.process_time()
    assert len(rows(text, "rust")) == 1 + 6 * 20000 and len(asked) == 2
    assert time.process_time() - began < 20


def test_what_depends_on_the_next_line_has_no_shape():
    for line in ("foo(a);", "let x = 1", "fn a() {", "}", "struct A { x: B } }", "a('x');", "fn f() { g(\"x\"); }"):
        assert lines.learn(line, "rust", project._placed) is None
    assert {"fn", "self", "match", "dyn", "new", "Self", "let", "where", "for"} <= lines.RESERVED and not {"seller", "Home"} & lines.RESERVED
