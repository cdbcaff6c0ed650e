"""Files read in pieces: the facts of the whole file, whatever the window."""

import random
import tracemalloc

import pytest

from loomgraph.plans import project
from loomgraph.sources.frontends import braces

ITEMS = {
    "rust": ["use a::{b as c, d};", "pub struct S%d { pub home: Home, x: Vec<T> }", "impl Sells for S%d { fn sell(&self) { make(); self.x.y(); } }", "#[test]\nfn skipped() { a(); }", "pub fn o%d<T: B>(x: C, y: r0::n1::S) -> Home { let z: Q = f(); r0::n1::make(); }", "mod m%d { use super::*; fn f() { g::<T>(1) } }", "const X: [u8; 3] = [1, 2, 3];", "enum E { A(u8), B { c: D } }", "trait T { fn t(&self); }", "}", ")", "// a { comment\n", "macro_rules! m { () => {} }"],
    "typescript": ["import {A as B} from './d'", "export class K%d extends L implements M { a: N; f(x: P): Q { return g(x) } }", "const f = (x: T) => { h(x); }", "interface I { a(): B; c: D }", "type U = {x: number} | V;", "@dec\nclass D%d {}", "function* gen(a: B) { yield k.l(); }", "export {B} from './e';", "({}).foo()", "namespace N.M { function q() {} }"],
    "cpp": ["#include <x>\n", "class A%d : public B { C c; void f(D d) { g(); } };", "struct F;", "int main(int a) { auto x = T{}; return h(x); }", "namespace n::m { void k() {} }", "using namespace std;", "enum class E { A, B };", "TEST(a, b) { c(); }"],
    "java": ["import a.b;", "public class A%d extends B implements C { D d; @Override public E f(G g) { return h(g); } }", "record R(int a) { }", "enum E { X, Y }", "interface I { void m(); }"],
}


def facts(scanned):
    return [f for piece in scanned for f in piece]


@pytest.mark.parametrize("language", ITEMS)
def test_pieces_are_the_whole(language, monkeypatch):
    monkeypatch.setattr(braces, "AHEAD", 420)
    rng = random.Random(3)
    cut = 0
    for round_ in range(12):
        items = [x for x in ITEMS[language] if round_ % 3 or x not in ("}", ")")]
        text = "\n".join((x % i if "%d" in x else x) for i, x in ((i, rng.choice(items)) for i in range(rng.randrange(300))))
        text += " mod open { fn f() {" if round_ % 4 == 3 else ""
        whole = braces.Scanner(text, language).run()
        for window in (500, 900, 3000):
            got = list(braces.pieces(text, language, window))
            cut += len(got) > 1
            assert facts(got) == whole
    assert cut > 5


def test_places_above():
    """Scopes, functions, types and chains over pieces as in one."""
    text = "\n".join(f"struct A{i} {{ x: B }}\nimpl T for A{i} {{ fn f(&self) {{ g(); }} }}\nfn o{i}() {{ h(); }}" for i in range(200))
    whole = facts(project._above(iter([braces.Scanner(text, "rust").run()])))
    assert facts(project._above(braces.pieces(text, "rust", 1500))) == whole
    chains = {f.name: chain for i, f, scope, func, holder, chain in whole if chain}
    assert len(chains["o7"]) == 2 and len(chains["f"]) == 3


def test_a_long_file_is_not_held_as_facts():
    text = "\n".join(f"pub fn o{i}(buyer: C{i}, seller: r0::n1::S{i}) -> Home {{ r0::n1::make(); seller.sell(); }}" for i in range(30000))
    tracemalloc.start()
    n = sum(b.num_rows for b in project._parser([project.pa.RecordBatch.from_pydict({"unit_id": [1], "content": [text.encode()], "lang": ["rust"]})]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1 + 6 * 30000 and peak < 100e6
