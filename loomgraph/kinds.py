"""Vocabulary of the program graph. All tables in this module are fixed values."""

from __future__ import annotations

from enum import IntEnum


class ViewDepth(IntEnum):
    PROJECT = 0
    PACKAGE = 1
    MODULE = 2
    FILE = 3


VIEW_ALIASES = {"project": 0, "package": 1, "module": 2, "namespace": 2, "file": 3}

#: block kind -> rank prior
KIND_PRIOR = {
    "root": 0.2, "module": 0.6, "class": 1.0, "trait": 1.0, "interface": 1.0, "func": 1.0, "method": 1.0, "closure": 1.0,
    "impl": 0.8, "enum": 0.8, "alias": 0.6, "const": 0.4, "field": 0.3, "parameter": 0.2, "return": 0.2, "call": 0.1, "scope": 0.1, "undefined": 0.05,
}
BLOCK_KINDS = tuple(KIND_PRIOR)
#: kinds that become rows of `block`
MATERIALIZED = ("root", "module", "func", "method", "call", "class", "trait", "interface", "enum", "const", "impl", "field", "parameter", "return", "alias")
#: kinds that are shown as nodes; methods and fields show through edges
VISIBLE = ("class", "trait", "interface", "enum", "func")
NOMINAL = ("class", "enum")
NEEDS_SYMBOL = ("func", "method")
NO_SYMBOL_BLOCK = ("impl", "return")

#: relation -> its inverse, in enum order; has_parameters and has_return have none
INVERSE = {
    "contains": "contained_by", "contained_by": "contains", "calls": "called_by", "called_by": "calls", "has_field": "field_of", "field_of": "has_field",
    "type_of": "type_for", "type_for": "type_of", "impl_for": "has_impl", "has_impl": "impl_for", "has_method": "method_of", "method_of": "has_method",
    "implements": "implemented_by", "implemented_by": "implements", "uses": "used_by", "used_by": "uses", "extends": "extended_by", "extended_by": "extends",
}
RELATIONS = (
    "unknown", "contains", "contained_by", "has_parameters", "has_return", "calls", "called_by", "has_field", "field_of", "type_of", "type_for",
    "impl_for", "has_impl", "has_method", "method_of", "implements", "implemented_by", "uses", "used_by", "extends", "extended_by",
)
INFLUENCE = {"calls": 1.0, "type_of": 1.0, "implements": 0.8, "uses": 0.35}
ORCHESTRATION = {"called_by": 1.0, "type_for": 1.0, "implemented_by": 0.8, "used_by": 0.35}

#: edge kind -> (reversed for dependency direction, role of from, role of to), in enum order
EDGE_KINDS = {
    "field": (True, "field_type", "container"),
    "nested_field": (True, "type_dep", "container"),
    "type_arg": (True, "type_arg", "generic"),
    "call": (False, "caller", "callee"),
    "param": (True, "input", "func"),
    "return": (False, "func", "output"),
    "conformance": (True, "contract", "conforms"),
    "specialization": (True, "base", "specializes"),
    "type_dep": (False, "source", "type_dep"),
    "impl_arg": (True, "type_arg", "implementation"),
    "annotation": (True, "annotation", "annotates"),
}

SYMBOL_KINDS = (
    "unknown", "unresolved_type", "package", "module", "file", "namespace", "struct", "enum", "function", "method", "closure", "macro", "variable", "field",
    "const", "static", "trait", "interface", "impl", "enum_variant", "primitive", "type_alias", "type_parameter", "generic_type", "composite_type",
)
KIND_SETS = {
    "all": SYMBOL_KINDS,
    "types": ("struct", "enum", "trait", "interface", "function", "const", "static", "primitive", "generic_type", "composite_type", "type_alias", "namespace", "type_parameter"),
    "impl_targets": ("struct", "enum"),
    "callable": ("struct", "enum", "trait", "function", "const"),
    "callable_body": ("function", "method", "closure", "macro"),
    "constructable": ("struct", "enum"),
    "receiver": ("method",),
    "contract": ("interface",),
    "constraint": ("trait",),
    "defined_type": ("struct", "enum", "trait", "type_alias", "interface"),
    "constant": ("const", "static"),
    "call_target": ("struct", "enum", "function", "macro", "const"),
    "alias_link": ("type_alias", "type_parameter"),
}
MEMBER_ORDER = ("method", "function", "field", "variable", "const", "static")

SHAPES = {
    "struct": "box", "enum": "box", "trait": "box", "interface": "box", "type_alias": "box", "module": "folder", "file": "folder", "namespace": "folder",
    "package": "folder", "field": "plaintext", "variable": "plaintext", "const": "diamond", "static": "diamond",
}

LANGUAGES = {
    "rust": {"manifests": ("Cargo.toml",), "extensions": ("rs",), "containers": ("src",)},
    "typescript": {"manifests": ("package.json",), "extensions": ("ts", "mts", "cts"), "containers": ("src", "lib", "dist", "build", "out", "source")},
    "javascript": {"manifests": ("package.json",), "extensions": ("js", "mjs", "cjs"), "containers": ("src", "lib", "dist", "build", "out", "source")},
    "cpp": {
        "manifests": ("CMakeLists.txt",),
        "extensions": ("c", "h", "cpp", "hpp", "cc", "hh", "cxx", "hxx", "c++", "h++", "C", "H", "ipp", "inl", "tpp"),
        "containers": ("src", "source", "sources", "lib", "include", "inc", "headers"),
    },
    "csharp": {"manifests": ("project.csproj",), "extensions": ("cs",), "containers": ("src", "source")},
    "go": {"manifests": ("go.mod",), "extensions": ("go",), "containers": ("cmd", "internal", "pkg")},
    "java": {"manifests": ("pom.xml", "build.gradle"), "extensions": ("java",), "containers": ("src", "main", "java")},
    "python": {"manifests": ("pyproject.toml", "setup.py"), "extensions": ("py", "pyi"), "containers": ("src", "lib", "app", "python")},
}
IGNORE_FILES = (".gitignore", ".ignore", ".rgignore", ".ripignore")


def parse_name(text: str, names) -> str:
    """Snake-case name, whatever its case; ValueError if unknown."""
    low = text.strip().lower()
    if low not in names:
        raise ValueError(f"unknown name {text!r}; known: {', '.join(names)}")
    return low
