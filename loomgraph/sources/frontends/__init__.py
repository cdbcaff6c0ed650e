"""Frontends: source text to facts. A frontend is a function (text) -> list[Fact]; register your own with `register`.

A frontend with an attribute `pieces`, a function (text) -> iterator of lists, is read by it: the same facts in the same order, those of a declaration at
the top of the file in one list, so that a file is never held as facts as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Fact:
    """One block. `types`: what it names as types, own type first, then arguments (class: bases; impl: target).

    An import is a fact of kind `import`, no block: `name` is what it is called here (`*`: everything inside), `types` holds its path. Paths begin with
    `crate`, `self`, `super` (packages and modules) or with HERE and ABOVE (folders) where they are not names.
    """

    kind: str
    name: str | None
    symbol_kind: str | None
    parent: int  # index of the parent fact, -1 for the root
    start: int
    end: int
    line: int
    types: list[str] = field(default_factory=list)
    contracts: list[str] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    callee: str | None = None  # of calls: dotted path
    names_symbol: bool = True


#: parts of a path: the folder of the file, the folder above
HERE, ABOVE = "<here>", "<above>"

Frontend = Callable[[str], list[Fact]]
_KNOWN: dict[str, Frontend] = {}


def register(language: str, frontend: Frontend) -> None:
    _KNOWN[language] = frontend


def frontend(language: str) -> Frontend:
    if not _KNOWN:
        from . import braces, python_ast

        for name in braces.SPECS:
            _KNOWN.setdefault(name, braces.frontend(name))
        _KNOWN.setdefault("python", python_ast.facts)
    if language not in _KNOWN:
        raise ValueError(f"no frontend for {language}")
    return _KNOWN[language]


def languages() -> list[str]:
    frontend("python")
    return sorted(_KNOWN)
