"""Source code to graph, rendering, command line, scanning, streaming."""

import subprocess
import sys

import pytest

from loomgraph.operators import collect as C
from loomgraph.plans import project, render
from loomgraph.sources import scan
from loomgraph.sources.frontends import Fact, frontend, languages, register
from loomgraph.streaming import upsert

SAME = {
    "python": ("def help(): pass\n", "def help(): pass\n\ndef main():\n    help()\n", "py"),
    "go": ("package a\nfunc help() int { return 1 }\n", "package a\nfunc help() int { return 2 }\nfunc main() { help() }\n", "go"),
    "java": ("class A { int help() { return 1; } }\n", "class B { int help() { return 1; } int main() { return help(); } }\n", "java"),
    "javascript": ("function help() {}\n", "function help() {}\nfunction main() { help(); }\n", "js"),
    "rust": ("fn help() {}\n", "fn help() {}\nfn main() { help(); }\n", "rs"),
    "typescript": ("function help(): void {}\n", "function help(): void {}\nfunction main() { help(); }\n", "ts"),
    "cpp": ("int help() { return 1; }\n", "int help() { return 2; }\nint main() { return help(); }\n", "cpp"),
}


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return str(folder)


def shown(p):
    names = {r.block_id: (r.unit_id, r.name) for r in C.nodes(p.graph).collect()}
    return names, {(names[r.from_id], r.kind, names[r.to_id]) for r in C.edges(p.graph).collect()}


@pytest.mark.parametrize("language", ["python", "go", "rust", "cpp"])
def test_same_file_goes_first(spark, tmp_path, language):
    a, b, ext = SAME[language]
    p = project.load(spark, [write(tmp_path, {f"a.{ext}": a, f"b.{ext}": b})], languages=[language])
    names, edges = shown(p)
    assert len(names) == 3 and edges == {((1, "main"), "call", (1, "help"))}


def names_of(language, text):
    return [(f.kind, f.name) for f in frontend(language)(text)]


def test_frontends_declare():
    assert set(languages()) >= {"python", "rust", "typescript", "javascript", "cpp", "java", "csharp", "go"}
    assert ("func", "main") in names_of("java", SAME["java"][1]) or ("method", "main") in names_of("java", SAME["java"][1])
    assert ("func", "main") in names_of("javascript", SAME["javascript"][1])
    rust = names_of("rust", "#[cfg(test)]\nmod tests { fn t() {} }\npub struct P<T> { a: Vec<T>, pub b: u32 }\nstruct U(i32, P<u8>);\nenum E { A, B(P<u8>) }\ntrait T { fn go(&self) -> E; }\nimpl T for P<u8> { fn go(&self) -> E { E::A } }\ntype Q = P<u8>;\nmacro_rules! m { () => {} }")
    assert ("class", "P") in rust and ("field", "a") in rust and ("field", "b") in rust and ("field", "0") in rust and ("enum", "E") in rust and ("trait", "T") in rust
    assert ("impl", "P") in rust and ("alias", "Q") in rust and ("func", "m") in rust and ("module", "tests") not in rust and rust.count(("method", "go")) == 2
    ts = names_of("typescript", "@Injectable()\nexport class A extends B implements C, D {\n  private x: Map<string, E>;\n  y = 1;\n  constructor(private z: F) {}\n  run(a: G): Promise<H> { this.run(a); return null }\n}\ninterface I { p: J; q(): K }\ntype L = M | N;\nenum O { A, B }\nnamespace S { function t() {} }")
    for want in [("class", "A"), ("field", "x"), ("method", "constructor"), ("method", "run"), ("interface", "I"), ("field", "p"), ("method", "q"), ("alias", "L"), ("enum", "O"), ("module", "S"), ("func", "t"), ("parameter", "a")]:
        assert want in ts, want
    cpp = names_of("cpp", "#include <x>\nnamespace n { struct S; class A : public B { public: int go(int a, const B& b); std::vector<B> items; };\nenum class E { X, Y };\nint run(A* a) { return a->go(1, B()); } }\nTEST(Foo, Bar) { run(0); }\nconcept_t v;")
    for want in [("module", "n"), ("class", "A"), ("method", "go"), ("field", "items"), ("enum", "E"), ("func", "run"), ("parameter", "a")]:
        assert want in cpp, want
    assert ("class", "S") not in cpp and sum(k == "call" for k, _ in cpp) >= 1
    fields = {f.name: f.types for f in frontend("typescript")("class A { a: Promise<B>; b: Array<Set<C>>; c: D<E>; d: F | G }") if f.kind == "field"}
    assert fields == {"a": ["B"], "b": ["C"], "c": ["D", "E"], "d": ["F", "G"]}
    cs = names_of("csharp", "namespace N { class A : B { public int Go(int x) { return Run(x); } } interface I { void P(); } }")
    assert ("class", "A") in cs and ("interface", "I") in cs and ("method", "Go") in cs
    go = names_of("go", "package p\ntype S struct { a int }\ntype I interface { F() }\nfunc (s *S) M() { s.N() }\nfunc F() {}")
    assert ("class", "S") in go and ("method", "M") in go and ("func", "F") in go


@pytest.mark.parametrize("language", ["rust", "typescript", "cpp", "java", "csharp", "go", "javascript", "python"])
def test_frontends_survive_anything(language):
    for text in ("", "{", "}}}", "((", "class", "fn", "impl", "struct A", "@", "/* open", '"open', "#[", "def f(:", "type X =", "a<b<c", "\x00", "é" * 10, "class A {" * 50):
        assert frontend(language)(text)[0].kind == "root"


def test_rust_graph(spark, tmp_path):
    code = {
        "k/Cargo.toml": '[package]\nname = "kit"\n',
        "k/src/shape/mod.rs": "pub trait Shape { fn area(&self) -> f64; }\npub struct Point { x: f64 }\npub struct Holder<T> { inner: T }\n",
        "k/src/draw/mod.rs": "pub struct Disc { at: Point, more: Holder<Point> }\nimpl Shape for Disc { fn area(&self) -> f64 { helper() } }\nfn helper() -> Point { make(1) }\nfn make(n: Disc) -> Point { Point { x: 1.0 } }\n",
    }
    p = project.load(spark, [write(tmp_path, code)], languages=["rust"])
    names, edges = shown(p)
    plain = {(a[1], k, b[1]) for a, k, b in edges}
    assert {("Point", "field", "Disc"), ("Point", "type_arg", "Holder"), ("Holder", "field", "Disc"), ("Shape", "conformance", "Disc"), ("helper", "call", "make"), ("helper", "return", "Point"), ("make", "return", "Point"), ("Disc", "param", "make")} <= plain
    meta = {r.file_path.rsplit("k/", 1)[1]: (r.package_name, r.module_name) for r in p.unit_meta.collect()}
    assert meta == {"src/shape/mod.rs": ("kit", "shape"), "src/draw/mod.rs": ("kit", "draw")}
    nodes, edge = C.nodes(p.graph), C.edges(p.graph)
    text = render.render(nodes, edge, p.unit_meta, 2)
    assert "namespace_kit_draw -> namespace_kit_shape" in text and text.startswith("//") and text.endswith("}\n")
    file_view = render.render(nodes, edge, p.unit_meta, 3, ai=False, flat=False)
    assert 'subgraph cluster_root_0_kit' in file_view and 'shape="box"' in file_view and 'rel="conformance", from="contract", to="conforms"' in file_view
    assert render.render(nodes, edge, p.unit_meta, 0).count("[") == 1
    assert render.render(nodes.limit(0), edge, p.unit_meta) == render.EMPTY
    assert render.block_lines(p.graph, 0).startswith("root:") and render.block_lines(p.graph, 0, "compact").startswith("(root") and "\n" in render.block_lines(p.graph, 0, "flat")


def test_typescript_graph(spark, tmp_path):
    code = {"a.ts": "export interface Store { get(): Item }\nexport class Item {}\nexport class Base {}\nfunction Mark(x: any) {}\n", "b.ts": "@Mark()\nexport class Shop extends Base implements Store {\n  items: Map<string, Item>;\n  main: Item;\n  get(): Item { return helper(); }\n}\nfunction helper(): Item { return new Item(); }\nfunction top(s: Shop): void { helper(); }\n"}
    _, edges = shown(project.load(spark, [write(tmp_path, code)], languages=["typescript"]))
    plain = {(a[1], k, b[1]) for a, k, b in edges}
    assert {("Store", "conformance", "Shop"), ("Base", "specialization", "Shop"), ("Item", "field", "Shop"), ("Mark", "annotation", "Shop"), ("top", "call", "helper"), ("helper", "return", "Item"), ("Shop", "param", "top")} <= plain


def test_member_calls_on_declared_variables(spark, tmp_path):
    text = (
        "struct Other;\nimpl Other { fn go(&self) {} }\nstruct Engine;\nimpl Engine { fn go(&self) {} fn stop(&self) {} }\nstruct Car { engine: Engine, spare: Option<Engine> }\n"
        "impl Car { fn drive(&self) { self.engine.go(); self.engine.fly(); } }\nfn halt(e: &Engine, n: u32) { e.stop(); n.stop(); unknown.stop(); }\nfn both(e: Other) { e.go(); }\n"
    )
    p = project.load(spark, [write(tmp_path, {"a.rs": text})], languages=["rust"])
    block = {r.block_id: r for r in p.graph.block.collect()}
    owner = lambda b: block[block[b].parent_id].name
    got = {(block[r.enclosing_id].name, owner(r.symbol_id), block[r.symbol_id].name) for r in p.calls.collect()}
    assert got == {("drive", "Engine", "go"), ("halt", "Engine", "stop"), ("both", "Other", "go")}


def test_member_calls_on_local_variables(spark, tmp_path):
    text = (
        "struct Other;\nimpl Other { fn go(&self) {} }\nstruct Engine;\nimpl Engine { fn go(&self) {} fn stop(&self) {} }\n"
        "fn made() { let mut a = Engine::new(); a.stop(); let b: Other = pick(); b.go(); if true { let c = Engine {}; c.go(); } let d = find(); d.go(); let n = Engine::new().count(); n.stop(); }\n"
        "fn hidden(e: &Engine) { let x = e.stop(); let e = Other::new(); e.go(); let e = e.stop(); e.go(); if let Some(e) = find() { } }\n"
    )
    p = project.load(spark, [write(tmp_path, {"a.rs": text})], languages=["rust"])
    block = {r.block_id: r for r in p.graph.block.collect()}
    got = sorted((block[r.enclosing_id].name, block[block[r.symbol_id].parent_id].name, block[r.symbol_id].name) for r in p.calls.collect())
    assert got == [("hidden", "Engine", "stop"), ("hidden", "Other", "go"), ("made", "Engine", "go"), ("made", "Engine", "stop"), ("made", "Other", "go")]
    assert "local" not in {r.kind for r in block.values()}
    ts = frontend("typescript")("function f() { const a = new Shop<Item>(1); let b: Map<string, Item> = x\n  var c = new Shop().make(); let { d } = a; const e = () => new Shop() }")
    assert [(f.name, f.types) for f in ts if f.kind == "local"] == [("a", ["Shop"]), ("b", ["string", "Item"]), ("c", []), ("e", [])]


def test_command_line(tmp_path):
    folder = write(tmp_path / "src", {"a.py": SAME["python"][1]})
    out = tmp_path / "o.dot"
    subprocess.run([sys.executable, "-m", "loomgraph", "-d", folder, "--lang", "python", "--top-k", "5", "-o", str(out)], check=True, timeout=240, capture_output=True)
    assert "rel=\"call\"" in out.read_text()


def test_scan(spark, tmp_path):
    root = write(tmp_path, {"a.py": "x", ".hidden.py": "x", "skip/b.py": "x", "keep/c.py": "y", "keep/d.txt": "x", "keep/e.PY": "x", ".gitignore": "skip/\n*.tmp\n!keep\n"})
    found = scan.list_sources([root], languages=["python"])
    assert [p.removeprefix(root) for p in found] == ["/a.py", "/keep/c.py"]
    assert scan.list_sources(files=[found[0], found[0]]) == [found[0]]
    with pytest.raises(ValueError):
        scan.list_sources([root], languages=["go"])
    with pytest.raises(ValueError):
        scan.list_sources([root], [found[0]])
    rows = scan.read_sources(spark, found).orderBy("file_id").collect()
    assert [(r.file_id, r.lang, bytes(r.content), r.size) for r in rows] == [(0, "python", b"x", 1), (1, "python", b"y", 1)] and rows[0].content_hash != rows[1].content_hash


def test_own_frontend():
    register("toy", lambda text: [Fact("root", None, "file", -1, 0, len(text), 1)])
    assert frontend("toy")("x")[0].kind == "root"
    with pytest.raises(ValueError):
        frontend("nothing")


def test_streaming_upsert(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    put = lambda rows: spark.createDataFrame(rows, "unit_id long, name string").coalesce(1).write.mode("append").parquet(source)
    put([(1, "a"), (2, "b")])
    stream = lambda: spark.readStream.schema("unit_id long, name string").parquet(source)
    upsert.follow(stream(), table, f"{tmp_path}/ck").awaitTermination(120)
    put([(2, "c"), (3, "d")])
    upsert.follow(stream(), table, f"{tmp_path}/ck").awaitTermination(120)
    assert sorted(tuple(r) for r in upsert.current(spark, table).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert upsert.current(spark, f"{tmp_path}/none") is None
