"""Paths, imports and modules in the build: names that several modules share must resolve to the one that the path names."""

from pyspark.sql import functions as F

from loomgraph.plans.project import load


def tree(tmp_path, files):
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def links(project, relation):
    """(file of source, source, file of target, target)"""
    block, meta = project.graph.block, project.unit_meta.select("unit_id", "file_name")
    named = block.join(meta, "unit_id").select("block_id", F.concat_ws(":", "file_name", "name").alias("at"))
    hop = project.graph.hop(relation).join(named.withColumnRenamed("block_id", "src").withColumnRenamed("at", "a"), "src").join(named.withColumnRenamed("block_id", "dst").withColumnRenamed("at", "b"), "dst")
    return {(r.a, r.b) for r in hop.select("a", "b").collect()}


def test_rust_paths(spark, tmp_path):
    at = tree(tmp_path, {
        "Cargo.toml": '[package]\nname = "top-crate"\n',
        "src/lib.rs": "pub mod a; pub mod b; pub mod user;\n",
        "src/a.rs": "pub struct Item { pub n: u32 }\npub fn make() {}\nimpl Item { pub fn new() {} }\npub mod inner { pub struct Deep { pub n: u32 }\n pub fn up() { super::make(); self::side(); }\n pub fn side() {} }\n",
        "src/b.rs": "pub struct Item { pub n: u32 }\npub fn make() {}\nimpl Item { pub fn new() {} }\n",
        "src/user.rs": "use crate::a::{self as first, Item as Thing, inner::*};\nuse super::b;\n"
        "pub fn one(x: crate::a::Item) { crate::a::make(); }\npub fn two(x: crate::b::Item) { crate::b::make(); b::Item::new(); }\n"
        "pub fn three(x: Thing, d: Deep) { first::make(); crate::nowhere::make(); }\npub fn four(x: b::Item) { b::make(); side(); }\npub fn five(x: top_crate::a::Item) { top_crate::a::Item::new(); }\n",
    })
    project = load(spark, [at], languages=["rust"])
    calls = {(a.split(":")[1], b) for a, b in links(project, "calls") if ":" in a and a.split(":")[0] in ("user.rs", "a.rs")}
    assert calls == {("one", "a.rs:make"), ("two", "b.rs:make"), ("two", "b.rs:new"), ("three", "a.rs:make"), ("four", "b.rs:make"), ("four", "a.rs:side"), ("five", "a.rs:new"), ("up", "a.rs:make"), ("up", "a.rs:side")}
    types = {(a, b) for a, b in links(project, "type_of") if a.startswith("user.rs")}
    assert types == {("user.rs:x", "a.rs:Item"), ("user.rs:x", "b.rs:Item"), ("user.rs:d", "a.rs:Deep")}
    per = project.graph.param_types().join(project.graph.block.select(F.col("block_id").alias("src"), "name"), "src").join(project.graph.block.select(F.col("block_id").alias("dst"), F.col("unit_id")), "dst")
    files = {r.unit_id: r.file_name for r in project.unit_meta.collect()}
    assert {(r["name"], files[r.unit_id]) for r in per.collect()} == {("one", "a.rs"), ("two", "b.rs"), ("three", "a.rs"), ("four", "b.rs"), ("five", "a.rs")}


def test_imports_of_other_languages(spark, tmp_path):
    at = tree(tmp_path / "ts", {
        "package.json": '{"name": "web"}', "src/a.ts": "export class Item { n: number }\nexport function make(): void {}\n", "src/b.ts": "export class Item { n: number }\nexport function make(): void {}\n",
        "src/lib/index.ts": "export { Item as Both } from '../b';\n", "src/user.ts": "import { Item, make as build } from './a';\nimport * as second from './b';\nimport { Both } from './lib';\n"
        "export function one(x: Item): void { build(); }\nexport function two(x: second.Item): void { second.make(); }\nexport function three(x: Both): void { }\n",
    })
    project = load(spark, [at], languages=["typescript"])
    assert {(a, b) for a, b in links(project, "calls") if a.startswith("user.ts:")} == {("user.ts:one", "a.ts:make"), ("user.ts:two", "b.ts:make")}
    assert {(a, b) for a, b in links(project, "type_of") if a.startswith("user.ts:")} == {("user.ts:x", "a.ts:Item"), ("user.ts:x", "b.ts:Item")}
    at = tree(tmp_path / "py", {
        "pkg/__init__.py": "", "pkg/a.py": "def make():\n    pass\n\nclass Base:\n    def run(self):\n        pass\n", "pkg/b.py": "def make():\n    pass\n\ndef mark(f):\n    return f\n",
        "pkg/user.py": "import pkg.b as second\nfrom .a import make, Base\nfrom . import a\n\nclass Own(Base):\n    @second.mark\n    def go(self):\n        make()\n        second.make()\n        self.run()\n\ndef late():\n    a.make()\n    second.nothing()\n",
        "top.py": "from pkg.b import *\n\ndef main():\n    make()\n",
    })
    project = load(spark, [at], languages=["python"])
    calls = {(a, b) for a, b in links(project, "calls") if a.split(":")[0] in ("user.py", "top.py") and ":" in a}
    assert calls == {("user.py:go", "a.py:make"), ("user.py:go", "b.py:make"), ("user.py:go", "a.py:run"), ("user.py:late", "a.py:make"), ("top.py:main", "b.py:make")}
    assert ("user.py:Own", "a.py:Base") in links(project, "extends") and ("user.py:go", "b.py:mark") in links(project, "uses")
