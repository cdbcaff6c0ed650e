"""Python through its own parser: classes, functions, methods, calls, bases. Files that do not parse give their root only."""

from __future__ import annotations

import ast

from . import ABOVE, HERE, Fact


def _path(node: ast.expr) -> str | None:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return None


def _imports(node: ast.Import | ast.ImportFrom) -> list[tuple[str, str]]:
    """(name here, path); relative ones begin with HERE."""
    if isinstance(node, ast.Import):
        return [(a.asname, a.name) if a.asname else (a.name.split(".")[0],) * 2 for a in node.names]
    above = [*([HERE] if node.level else []), *[ABOVE] * (node.level - 1), *(node.module or "").split(".")]
    above = [x for x in above if x]
    return [("*", ".".join(above)) if a.name == "*" else (a.asname or a.name, ".".join([*above, a.name])) for a in node.names]


def facts(text: str) -> list[Fact]:
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    out = [Fact("root", None, "file", -1, 0, len(text), 1)]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    place = lambda n: (starts[n.lineno - 1] + n.col_offset, starts[(n.end_lineno or n.lineno) - 1] + (n.end_col_offset or 0), n.lineno)
    todo: list[tuple[ast.AST, int, bool]] = [(tree, 0, False)]
    while todo:
        node, parent, in_class = todo.pop()
        me, mine = parent, in_class
        if isinstance(node, ast.ClassDef):
            me, mine = len(out), True
            out.append(Fact("class", node.name, "struct", parent, *place(node), types=[p for b in node.bases if (p := _path(b))], decorators=[p for d in node.decorator_list if (p := _path(d.func if isinstance(d, ast.Call) else d))]))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            me, mine = len(out), False
            marks = [p for d in node.decorator_list if (p := _path(d.func if isinstance(d, ast.Call) else d))]
            out.append(Fact("method" if in_class else "func", node.name, "method" if in_class else "function", parent, *place(node), decorators=marks))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            for name, path in _imports(node):
                out.append(Fact("import", name, None, parent, *place(node), types=[path], names_symbol=False))
        elif isinstance(node, ast.Call):
            if name := _path(node.func):
                me = len(out)
                out.append(Fact("call", None, None, parent, *place(node), callee=name, names_symbol=False))
        todo += [(child, me, mine) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out
