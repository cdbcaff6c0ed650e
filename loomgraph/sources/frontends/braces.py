"""A lexer and declaration scanner for languages with braces.

What is read: type, function, method and module declarations, fields, parameters, return types, bases and contracts,
decorators, calls; generic arguments of fields. Test code is skipped as each language marks it. What is not: macros,
templates beyond their names, and types that expressions imply. Unbalanced text ends the open blocks at its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from . import ABOVE, HERE, Fact, Frontend

_CHAR = r"(?P<chr>'(?:\\.[^']*|[^'\\\n])')"
_TOKENS = (
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>r\#*".*?"\#*|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|""" + _CHAR + r"""|(?P<attr>\#!?\[)|(?P<pre>^[ \t]*\#[^\n]*)"""
    r"""|(?P<word>[A-Za-z_$\u0080-\uffff][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|<<|&&|\|\||[-+*/%&|^=!<>]=|.)"""
)
_TOKEN = re.compile(_TOKENS, re.S | re.M | re.X)
#: where single quotes hold whole strings
_QUOTED = re.compile(_TOKENS.replace(_CHAR, r"(?P<chr>'(?:\\.|[^'\\\n])*')"), re.S | re.M | re.X)


@dataclass(frozen=True)
class Spec:
    types: dict  # keyword -> (block kind, symbol kind)
    functions: tuple = ()  # keywords of functions
    colon: bool = False  # `name: Type` (else `Type name`)
    bare: bool = False  # functions without a keyword: name(...) {
    modules: tuple = ()
    base_words: tuple = ()
    contract_words: tuple = ()
    go: bool = False
    returns: bool = True
    typed: bool = True


_CLASS, _ENUM, _FACE, _TRAIT, _ALIAS = ("class", "struct"), ("enum", "enum"), ("interface", "interface"), ("trait", "trait"), ("alias", "type_alias")
SPECS = {
    "rust": Spec({"struct": _CLASS, "union": _CLASS, "enum": _ENUM, "trait": _TRAIT, "type": _ALIAS}, ("fn",), True, modules=("mod",)),
    "typescript": Spec({"class": _CLASS, "interface": _FACE, "enum": _ENUM, "type": _ALIAS}, ("function",), True, True, ("namespace", "module"), ("extends",), ("implements",)),
    "javascript": Spec({"class": _CLASS}, ("function",), True, True, (), ("extends",), typed=False),
    "cpp": Spec({"class": _CLASS, "struct": _CLASS, "union": _CLASS, "enum": _ENUM, "concept": _TRAIT}, (), False, True, ("namespace",), (":",), returns=False),
    "java": Spec({"class": _CLASS, "record": _CLASS, "interface": _FACE, "enum": _ENUM}, (), False, True, (), ("extends",), ("implements",), typed=False),
    "csharp": Spec({"class": _CLASS, "struct": _CLASS, "record": _CLASS, "interface": _FACE, "enum": _ENUM}, (), False, True, ("namespace",), (":",), typed=False),
    "go": Spec({"type": _CLASS}, ("func",), False, go=True, typed=False),
}
_NOT_CALLS = {"if", "for", "while", "switch", "return", "catch", "sizeof", "fn", "function", "func", "new", "else", "await", "typeof", "delete", "throw", "using", "foreach", "synchronized", "super", "do", "in", "of", "as", "case", "let", "const", "var", "static_assert", "decltype", "alignof", "noexcept", "operator", "template", "unsafe", "yield", "not"}
_NOT_CALLS_IN = {"rust": {"match", "loop", "move", "where"}, "go": {"go", "defer", "select", "range"}, "csharp": {"lock", "where"}, "cpp": {"and", "or", "not"}}
#: of the words above those that are plain names
_NAMES_IN = {"rust": {"new", "delete", "func", "function", "of", "case", "do", "throw", "catch", "switch", "using", "foreach", "operator", "template", "not"}, "go": {"new", "delete", "of", "fn", "function", "catch", "throw", "using", "not", "operator", "template"}}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "const", "mut", "pub", "virtual", "inline", "final", "explicit", "constexpr", "mutable", "volatile", "unsigned", "signed", "ref", "dyn", "impl", "export", "default", "crate", "unsafe", "extern", "friend", "typename", "struct", "class", "enum", "out", "params", "in", "get", "set"}
#: macros that declare tests (fixed values)
_TESTS = ("TEST", "TEST_F", "TEST_P", "TYPED_TEST", "TYPED_TEST_P", "BOOST_AUTO_TEST_CASE", "BOOST_TEST_CASE", "CATCH_TEST_CASE", "TEST_CASE", "SCENARIO")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


#: tokens that are held at once, as long as no declaration is longer; tokens that a rule looks ahead where it finds no end
WINDOW, AHEAD = 1 << 16, 1 << 10


@dataclass(slots=True)
class Tok:
    kind: str
    text: str
    start: int
    end: int
    line: int


def lex(text: str, quoted: bool = False, at: int = 0, line: int = 1) -> Iterator[Tok]:
    """Tokens from `at` on, which is in this line."""
    last = at
    for m in (_QUOTED if quoted else _TOKEN).finditer(text, at):
        kind = m.lastgroup
        if kind not in ("skip", "pre"):
            start = m.start()
            line += text.count("\n", last, start)
            last = start
            yield Tok(kind, m.group(), start, m.end(), line)


#: TypeScript types that stand for what they hold (fixed values)
_WRAPPERS = {"Promise", "Array", "ReadonlyArray", "Set", "Map", "WeakMap", "WeakSet", "Generator", "AsyncGenerator", "Iterable", "AsyncIterable", "Iterator", "AsyncIterator"}


def type_names(toks: list[Tok]) -> list[str]:
    """Names in a type expression in order: `Map<K, Vec<T>>` -> [Map, K, Vec, T]; paths give their dotted form."""
    out: list[str] = []
    i = 0
    while i < len(toks):
        if toks[i].kind == "word" and toks[i].text not in _MODIFIERS and not (i and toks[i - 1].text == "'"):
            path = [toks[i].text]
            while i + 2 < len(toks) and toks[i + 1].text in ("::", ".") and toks[i + 2].kind == "word":
                path.append(toks[i + 2].text)
                i += 2
            out.append(".".join(path))
        i += 1
    return out


class Scanner:
    def __init__(self, text: str, language: str):
        self.begin(text, language)
        self.read(0, 1, 0, None)

    def begin(self, text: str, language: str) -> None:
        self.text, self.language, self.spec = text, language, SPECS[language]
        self.not_calls = _NOT_CALLS - _NAMES_IN.get(language, set()) | _NOT_CALLS_IN.get(language, set())
        self.local_words = {"rust": ("let",), "typescript": ("let", "const", "var")}.get(language, ())
        self.out, self.before = [Fact("root", None, "file", -1, 0, len(text), 1)], 0

    def read(self, at: int, line: int, first: int, most: int | None) -> None:
        """The next `most` tokens from `at` on, of which those before `first` are known already."""
        self.toks = list(islice(lex(self.text, self.language in ("typescript", "javascript"), at, line), most))
        self.close, self.open = self._match(first)

    def _match(self, first: int) -> tuple[dict[int, int], int]:
        """Where brackets close, and the first one that stays open."""
        stack, out = [], {}
        for i in range(first, len(self.toks)):
            t = self.toks[i]
            if t.text in _PAIRS and t.kind == "op" or t.kind == "attr":
                stack.append((i, "]" if t.kind == "attr" else _PAIRS[t.text]))
            elif t.kind == "op" and t.text in ")]}":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1] == t.text:
                        out[stack[k][0]] = i
                        del stack[k:]
                        break
        return out, stack[0][0] if stack else len(self.toks)

    def end(self, i: int) -> int:
        return self.close.get(i, len(self.toks) - 1)

    def angle(self, i: int) -> int:
        """Index after a generic list that opens at i, or i."""
        if i >= len(self.toks) or self.toks[i].text != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.toks), i + 400)):
            x = self.toks[j].text
            depth += (x == "<") + 2 * (x == "<<") - (x == ">")
            if x in (";", "{") or depth <= 0:
                return j + 1 if depth <= 0 else i
        return i

    def add(self, kind, name, symbol_kind, parent, a, b, **more) -> int:
        a, b = self.toks[a], self.toks[min(b, len(self.toks) - 1)]
        self.out.append(Fact(kind, name, symbol_kind, parent, a.start, b.end, a.line, **more))
        return self.before + len(self.out) - 1

    def run(self) -> list[Fact]:
        self.body(0, len(self.toks), 0, "root")
        return self.out

    def types(self, toks: list[Tok]) -> list[str]:
        names = type_names(toks)
        while self.language == "typescript" and len(names) > 1 and names[0] in _WRAPPERS:
            names = names[1:]
        return names

    # one sequence of declarations and statements

    def body(self, i: int, stop: int, parent: int, where: str, ends: list[tuple[int, int]] | None = None, most: int = 0) -> None:
        """`ends` collects the places after each declaration, block and statement up to `most`, with the number of facts so far."""
        marks: list[str] = []
        skip_next = False
        while i < stop:
            t = self.toks[i]
            if ends is not None:
                if i > most:
                    return
                if not marks and not skip_next and i and self.toks[i - 1].text in ("}", ";"):
                    ends.append((i, len(self.out)))
            if t.kind == "attr":
                e = self.end(i)
                inside = "".join(x.text for x in self.toks[i + 1 : e])
                skip_next |= inside == "test" or inside.startswith("cfg(test") or inside.startswith("cfg_attr(test,") or inside.endswith("::test")
                i = e + 1
                continue
            if t.text == "@" and i + 1 < stop and self.toks[i + 1].kind == "word":
                j = i + 1
                while j + 2 < stop and self.toks[j + 1].text == "." and self.toks[j + 2].kind == "word":
                    j += 2
                marks.append(self.toks[j].text)
                skip_next |= self.language == "typescript" and self.toks[j].text.lower() in ("test", "it", "describe")
                i = self.end(j + 1) + 1 if j + 1 < stop and self.toks[j + 1].text == "(" else j + 1
                continue
            j = self.declaration(i, stop, parent, where, marks, skip_next)
            if j > i:
                i, marks, skip_next = j, [], False
                continue
            if t.text == "{":
                self.body(i + 1, self.end(i), parent, "code" if where in ("func", "code") else where)
                i = self.end(i) + 1
                marks, skip_next = [], False
                continue
            if t.text in self.local_words and where in ("func", "code"):
                self.local(i, stop, parent)
            if t.kind == "word" and where not in ("class", "interface", "enum"):
                self.call(i, parent)
            if t.text in (";", "}"):
                marks, skip_next = [], False
            i += 1

    def call(self, i: int, parent: int) -> int | None:
        t = self.toks[i]
        j = self.angle(i + 1) if self.language != "rust" else i + 1
        if self.language == "rust" and i + 2 < len(self.toks) and self.toks[i + 1].text == "::" and self.toks[i + 2].text == "<":
            j = self.angle(i + 2)
        macro = self.language == "rust" and j < len(self.toks) and self.toks[j].text == "!"
        j += macro
        if j >= len(self.toks) or self.toks[j].text not in (("(", "[", "{") if macro else ("(",)) or t.text in self.not_calls:
            return None
        path, k = [t.text], i
        while k >= 2 and self.toks[k - 1].text in (".", "::", "->") and self.toks[k - 2].kind == "word":
            path.insert(0, self.toks[k - 2].text)
            k -= 2
        if k >= 1 and self.toks[k - 1].text in (".", "->"):
            path.insert(0, "?")
        return self.add("call", None, None, parent, k, self.end(j), callee=".".join(path), names_symbol=False)

    def local(self, i: int, stop: int, parent: int) -> None:
        """A local variable up to the end of its statement: declared type, or that of a constructor that is the whole value.

        Other values give a variable without a type, which still hides what its name meant before.
        """
        text = lambda k: self.toks[k].text if k < stop else ";"
        at = i + 1 + (text(i + 1) == "mut")
        if at >= stop or self.toks[at].kind != "word" or text(at + 1) not in (":", "="):
            return
        j = at + 1
        while j < stop and text(j) not in ("=", ";", "}"):
            j = self.end(j) + 1 if text(j) in _PAIRS else j + 1
        types = self.types(self.toks[at + 2 : j]) if text(at + 1) == ":" else []
        value = j + 1
        last = value
        while last < stop and text(last) not in (";", "}") and not (self.language == "typescript" and self.toks[last].line > self.toks[last - 1].line and text(last) != "."):
            last = self.end(last) + 1 if text(last) in _PAIRS else last + 1
        if not types and text(j) == "=":
            types = self.constructed(value, last, text)
        self.add("local", self.toks[at].text, "variable", parent, i, max(at, min(last, stop) - 1), types=types, names_symbol=False)

    def constructed(self, i: int, last: int, text) -> list[str]:
        """The type that `new T(...)`, `T { ... }`, `T::new(...)` or `T::default()` makes, if nothing follows."""
        i += made if (made := text(i) == "new" and self.language == "typescript") else 0
        path, j = [], i
        while j < last and self.toks[j].kind == "word":
            path.append(text(j))
            j = self.angle(j + 1)
            if text(j) not in ("::", "."):
                break
            j += 1
        if not path or text(j) not in ("(", "{") or self.end(j) + 1 < last:
            return []
        if made:
            return [".".join(path)]
        if self.language != "rust":
            return []
        if text(j) == "(":
            path = path[:-1] if path[-1] in ("new", "default") else []
        return [".".join(path)] if path and path[-1] not in ("Self", "match", "if", "loop", "unsafe", "while", "for") else []

    def declaration(self, i: int, stop: int, parent: int, where: str, marks: list[str], skip: bool) -> int:
        """Index after a declaration that begins at i, or i."""
        t, spec = self.toks[i], self.spec
        nxt = self.toks[i + 1] if i + 1 < stop else None
        if t.kind != "word":
            return i
        if t.text == {"rust": "use", "cpp": "using"}.get(self.language) and nxt and where in ("root", "module", "func", "code"):
            return self.use(i, stop, parent, skip)
        if self.language in ("typescript", "javascript") and where in ("root", "module") and (t.text == "import" or t.text == "export" and nxt and nxt.text in ("{", "*")):
            return self.module_import(i, stop, parent)
        if self.language == "rust" and t.text == "macro_rules":
            if nxt and nxt.text == "!" and i + 3 < stop:
                e = self.end(i + 3)
                self.add("func", self.toks[i + 2].text, "macro", parent, i, e)
                return e + 1
        if self.language == "rust" and t.text == "impl" and where in ("root", "module", "code", "func"):
            return self.impl(i, stop, parent, skip)
        if self.language == "cpp" and t.text in _TESTS and nxt and nxt.text == "(":
            j = self.end(i + 1) + 1
            return self.end(j) + 1 if j < stop and self.toks[j].text == "{" else j
        if t.text in spec.modules and nxt and nxt.kind == "word" and where in ("root", "module"):
            j = i + 2
            while j < stop and self.toks[j].text in (".", "::") and j + 1 < stop:
                j += 2
            if j < stop and self.toks[j].text == "{":
                if not skip:
                    me = self.add("module", self.toks[j - 1].text, "module" if self.language != "cpp" else "namespace", parent, i, self.end(j))
                    self.body(j + 1, self.end(j), me, "module")
                return self.end(j) + 1
            return j
        if t.text in spec.types and nxt and nxt.kind == "word" and (i == 0 or self.toks[i - 1].text not in (".", "->", "::")):
            return self.type_declaration(i, stop, parent, skip, marks)
        if t.text in spec.functions and nxt:
            j = i + 1
            receiver: list[Tok] = []
            if spec.go and nxt.text == "(":
                receiver, j = self.toks[i + 2 : self.end(i + 1)], self.end(i + 1) + 1
            if j < stop and self.toks[j].text == "*":
                j += 1
            if j < stop and self.toks[j].kind == "word":
                return self.function(i, j, stop, parent, where, marks, skip, method=bool(receiver))
            return i
        if where in ("class", "interface", "impl", "trait", "enum") or spec.bare and where in ("root", "module"):
            return self.member(i, stop, parent, where, marks, skip)
        return i

    def imported(self, name: str, path: list[str], parent: int, a: int, b: int) -> None:
        if path:
            self.add("import", name, None, parent, a, b, types=[".".join(path)], names_symbol=False)

    def use(self, i: int, stop: int, parent: int, skip: bool) -> int:
        """`use a::{b as c, d::*};`, `using a::b;`, `using namespace a;`."""
        everything = self.language == "cpp" and self.toks[i + 1].text == "namespace"
        last = next((k for k in range(i, stop) if self.toks[k].text in (";", "=")), stop)
        if last < stop and self.toks[last].text == "=":  # a type alias
            return i
        if not skip:
            for name, path in self.use_tree(i + 1 + everything, last, [])[0]:
                self.imported("*" if everything else name, path, parent, i, last)
        return last + 1

    def use_tree(self, i: int, stop: int, path: list[str]) -> tuple[list[tuple[str, list[str]]], int]:
        while i < stop:
            x = self.toks[i]
            if x.text == "{":
                out, e, i = [], min(self.end(i), stop), i + 1
                while i < e:
                    got, to = self.use_tree(i, e, path)
                    out, i = out + got, max(to, i + 1)
                return out, e + 1
            if x.text == "*":
                return [("*", path)], i + 1
            if x.text == "as" and i + 1 < stop:
                return [(self.toks[i + 1].text, path)], i + 2
            if x.kind == "word":
                path = path if x.text == "self" and path else [*path, x.text]
                if i + 1 >= stop or self.toks[i + 1].text not in ("::", "as"):
                    return [(path[-1], path)], i + 1
            elif x.text != "::":
                return [], i + 1
            i += 1
        return [], i

    def module_import(self, i: int, stop: int, parent: int) -> int:
        """`import A, {B as C} from "./d"`, `import * as N from "./d"`, `export {B} from "./d"`."""
        e = next((k for k in range(i + 1, min(stop, i + 400)) if self.toks[k].kind in ("str", "chr") or self.toks[k].text in (";", "(")), stop)
        if e >= stop or self.toks[e].kind not in ("str", "chr"):
            return i
        spec = self.toks[e].text[1:-1]
        steps = [x for x in re.sub(r"\.(js|jsx|ts|tsx|mjs)$", "", spec).split("/") if x not in ("", "index")]
        if not steps or steps[0] not in (".", ".."):
            return e + 1  # a package from elsewhere
        base = [HERE, *[ABOVE if x == ".." else x for x in steps if x != "."]]
        k = i + 1
        while k < e:
            x, after = self.toks[k], self.toks[k + 1].text if k + 1 < e else ""
            if x.text == "*":
                self.imported(self.toks[k + 2].text if after == "as" and k + 2 < e else "*", base, parent, i, e)
                k += 3 if after == "as" else 1
            elif x.kind == "word" and x.text not in ("from", "type"):
                alias = self.toks[k + 2].text if after == "as" and k + 2 < e else x.text
                self.imported(alias, [*base, x.text], parent, i, e)
                k += 3 if after == "as" else 1
            else:
                k += 1
        return e + 1

    def impl(self, i: int, stop: int, parent: int, skip: bool) -> int:
        j = self.angle(i + 1)
        head: list[Tok] = []
        while j < stop and self.toks[j].text not in ("{", ";", "where"):
            head.append(self.toks[j])
            j += 1
        while j < stop and self.toks[j].text not in ("{", ";"):
            j += 1
        at = next((k for k, x in enumerate(head) if x.text == "for"), None)
        target, contract = (self.types(head[at + 1 :]), self.types(head[:at])[:1]) if at is not None else (self.types(head), [])
        if not skip:
            me = self.add("impl", target[0] if target else None, "impl", parent, i, self.end(j), types=target, contracts=contract, names_symbol=False)
            if j < stop and self.toks[j].text == "{":
                self.body(j + 1, self.end(j), me, "impl")
        return self.end(j) + 1 if j < stop and self.toks[j].text == "{" else j + 1

    def type_declaration(self, i: int, stop: int, parent: int, skip: bool, marks: list[str]) -> int:
        t, j = self.toks[i], i + 1
        if t.text in ("enum",) and self.toks[j].text in ("class", "struct") and j + 1 < stop:
            j += 1
        kind, symbol = self.spec.types[t.text]
        generic = j + 1
        name, j = self.toks[j].text, self.angle(j + 1)
        generic = (generic, j)
        if self.spec.go:
            what = self.toks[j].text if j < stop else ""
            if what not in ("struct", "interface"):
                return i
            j += 1
        if j < stop and self.toks[j].text == "(" and self.language == "java":  # record header
            j = self.end(j) + 1
        bases: list[str] = []
        contracts: list[str] = []
        if kind == "alias":
            begin = j
            while j < stop and self.toks[j].text != ";" and not (self.language == "typescript" and j > begin + 1 and self.toks[j].line > self.toks[j - 1].line and self.toks[j].text not in ("|", "&", "}", ">")):
                j = self.end(j) + 1 if self.toks[j].text in _PAIRS else j + 1
            if not skip:
                self.add(kind, name, symbol, parent, i, j - 1, types=self.types(self.toks[begin:j]))
            return min(j + 1, stop) if j < stop and self.toks[j].text == ";" else j
        into = None
        while j < stop and self.toks[j].text not in ("{", ";", "("):
            x = self.toks[j]
            if x.text in self.spec.base_words:
                into = bases
            elif x.text in self.spec.contract_words:
                into = contracts
            elif x.text == "where":
                into = None
            elif x.text in ("=",) or x.text == ")" or self.language == "cpp" and x.text in ("*", "&", ","):
                if into is None:
                    return i  # `struct x *p` or a value: no declaration
            elif x.kind == "word" and into is not None and x.text not in _MODIFIERS:
                into.append(x.text)
                k = self.angle(j + 1)
                j = max(j, k - 1)
            elif self.language == "cpp" and x.kind == "word" and into is None and x.text != "final":
                return i  # `struct a b;`
            j += 1
        if kind == "interface" and self.language == "typescript":
            contracts, bases = bases, []
        tuple_body = j < stop and self.toks[j].text == "("
        if j >= stop or self.toks[j].text == ";":
            if self.language == "cpp":
                return j + 1  # forward declaration
            if not skip:
                self.add(kind, name, symbol, parent, i, j, types=bases[:1], contracts=contracts, decorators=list(marks))
            return j + 1
        e = self.end(j)
        if not skip:
            me = self.add(kind, name, symbol, parent, i, e, types=bases[:1], contracts=contracts + bases[1:], decorators=list(marks))
            self.type_parameters(*generic, me)
            if tuple_body:
                if self.spec.typed and self.language == "rust":
                    for n, part in enumerate(self.split(j + 1, e)):
                        self.add("field", str(n), "field", me, part[0], part[-1], types=self.types([self.toks[x] for x in part]), names_symbol=False)
            elif kind == "enum":
                self.enum(j + 1, e, me)
            elif not self.spec.go:
                self.body(j + 1, e, me, "trait" if kind == "trait" else kind)
        return e + 1

    def type_parameters(self, i: int, stop: int, me: int) -> None:
        """`<T: Bound, U extends Base>` between i and stop."""
        if self.language not in ("rust", "typescript") or stop <= i + 2:
            return
        for part in self.split(i + 1, stop - 1):
            toks = [self.toks[k] for k in part]
            if toks[0].kind != "word" or toks[0].text == "const":
                continue
            at = next((n for n, x in enumerate(toks) if x.text in (":", "extends")), None)
            end = next((n for n, x in enumerate(toks) if x.text == "="), len(toks))
            bounds = self.types(toks[at + 1 : end]) if at is not None else []
            self.add("type_parameter", toks[0].text, "type_parameter", me, part[0], part[-1], types=bounds[:1])

    def split(self, i: int, stop: int) -> list[list[int]]:
        """Token indices between top-level commas."""
        out, now, depth = [], [], 0
        while i < stop:
            x = self.toks[i].text
            depth += (x == "<") + 2 * (x == "<<") - (x == ">")
            if x == "," and depth <= 0:
                out.append(now)
                now, depth = [], 0
            elif x in _PAIRS and self.toks[i].kind == "op" or self.toks[i].kind == "attr":
                e = self.end(i)
                if self.toks[i].kind != "attr":
                    now += range(i, min(e + 1, stop))
                i = e
            else:
                now.append(i)
            i += 1
        return [x for x in [*out, now] if x]

    def enum(self, i: int, stop: int, me: int) -> None:
        if self.language in ("java", "csharp"):
            return
        for part in self.split(i, stop):
            words = [k for k in part if self.toks[k].kind == "word"]
            if not words:
                continue
            variant = self.add("field", self.toks[words[0]].text, "enum_variant", me, part[0], part[-1])
            if self.language == "rust" and len(part) > 1 and self.toks[part[1]].text in ("(", "{"):
                for n, inner in enumerate(self.split(part[1] + 1, self.end(part[1]))):
                    toks = [self.toks[k] for k in inner]
                    at = next((k for k, x in enumerate(toks) if x.text == ":"), None)
                    self.add("field", toks[0].text if at else str(n), "field", variant, inner[0], inner[-1], types=self.types(toks[at + 1 :] if at else toks), names_symbol=False)

    def function(self, i: int, name_at: int, stop: int, parent: int, where: str, marks: list[str], skip: bool, method: bool = False) -> int:
        j = self.angle(name_at + 1)
        if j >= stop or self.toks[j].text != "(":
            return i
        e = self.end(j)
        k = e + 1
        ret: list[Tok] = []
        depth = 0
        while k < stop and not (depth <= 0 and self.toks[k].text in ("{", ";", "}", "=>")):
            x = self.toks[k].text
            depth += (x == "<") - (x == ">")
            if x in ("(", "["):
                ret += self.toks[k : self.end(k) + 1]
                k = self.end(k) + 1
                continue
            if self.toks[k].line > self.toks[k - 1].line and self.language == "typescript" and where in ("interface", "class") and self.toks[k].kind == "word" and x not in ("implements", "extends"):
                break
            ret.append(self.toks[k])
            k += 1
        has_body = k < stop and self.toks[k].text == "{"
        last = self.end(k) if has_body else k
        if skip:
            return last + 1 if has_body or k < stop and self.toks[k].text == ";" else k
        is_method = method or where in ("class", "interface", "trait", "impl")
        me = self.add("method" if is_method else "func", self.toks[name_at].text, "method" if is_method else "function", parent, i, last if has_body else max(e, k - 1), decorators=list(marks))
        self.type_parameters(name_at + 1, j, me)
        if self.spec.typed:
            for part in self.split(j + 1, e):
                self.typed_part("parameter", part, me, "variable")
            where_at = next((n for n, x in enumerate(ret) if x.text == "where"), len(ret))
            arrow = next((n for n, x in enumerate(ret[:where_at]) if x.text in ("->", ":")), None)
            names = self.types(ret[arrow + 1 : where_at]) if arrow is not None else []
            if names and self.spec.returns:
                self.add("return", None, None, me, min(e + 1, len(self.toks) - 1), max(e + 1, k - 1), types=names, names_symbol=False)
        if has_body:
            self.body(k + 1, last, me, "func")
            return last + 1
        return k + 1 if k < stop and self.toks[k].text == ";" else k

    def typed_part(self, kind: str, part: list[int], me: int, symbol: str) -> int | None:
        toks = [self.toks[x] for x in part]
        words = [n for n, x in enumerate(toks) if x.kind == "word" and x.text not in _MODIFIERS]
        if not words:
            return None
        equals = next((n for n, x in enumerate(toks) if x.text == "="), len(toks))
        if self.spec.colon:
            at = next((n for n, x in enumerate(toks) if x.text == ":"), None)
            if at is None:
                return self.add(kind, toks[words[0]].text, symbol, me, part[0], part[-1], names_symbol=False)
            before = [n for n in words if n < at]
            name, types = (toks[before[-1]].text if before else None), self.types(toks[at + 1 : equals])
        else:
            inside = [n for n in words if n < equals]
            if len(inside) < 2:
                return self.add(kind, None if kind == "parameter" else toks[words[0]].text, symbol, me, part[0], part[-1], types=self.types(toks[:equals]), names_symbol=False)
            name, types = toks[inside[-1]].text, self.types(toks[: inside[-1]])
        return self.add(kind, name, symbol, me, part[0], part[-1], types=types, names_symbol=False)

    def member(self, i: int, stop: int, parent: int, where: str, marks: list[str], skip: bool) -> int:
        """A field or a function without a keyword, from its first token to the end of the declaration."""
        j, last_word, depth = i, None, 0
        while j < stop:
            x = self.toks[j]
            if x.text in ("struct", "class", "enum", "interface", "union", "record") and j > i and x.text in self.spec.types:
                return i
            if x.text in self.spec.functions and where not in ("class", "interface"):
                return i
            if x.text == "(" and depth <= 0:
                break
            if x.text in (";", "{", "}", "=", ":", "=>") or x.text == "," and depth <= 0:
                break
            depth += (x.text == "<") + 2 * (x.text == "<<") - (x.text == ">")
            if self.language in ("typescript", "javascript") and j > i and x.line > self.toks[j - 1].line:
                break
            if x.kind == "word":
                last_word = j
            j = self.end(j) + 1 if x.text == "[" else j + 1
        if last_word is None or j >= stop:
            return i
        x = self.toks[j]
        if x.text == "(":
            name_at = last_word
            if self.toks[name_at].text in self.not_calls or self.language == "cpp" and self.toks[i].text in self.not_calls:
                return i
            e = self.end(j)
            k = e + 1
            while k < stop and self.toks[k].text not in ("{", ";", "}", "=", "(") and not (self.language in ("typescript", "javascript") and where in ("root", "module") and self.toks[k].line > self.toks[k - 1].line):
                k = self.end(k) + 1 if self.toks[k].text == "[" else k + 1
            body = k < stop and self.toks[k].text == "{"
            plain = where in ("root", "module")
            if plain and (not body or self.language in ("typescript", "javascript")):
                return i
            if not body and where not in ("interface", "class", "trait") or not plain and name_at == i and not body and self.language not in ("typescript",) and where != "interface":
                return i
            if plain and name_at == i and self.language in ("java", "csharp"):
                return i
            return self.function(i, name_at, stop, parent, where, marks, skip)
        if where not in ("class", "interface") or not self.spec.typed:
            return i
        if self.language in ("rust", "typescript"):
            k = j
            depth = 0
            while k < stop and not (depth <= 0 and self.toks[k].text in (";", ",", "}")):
                y = self.toks[k].text
                depth += (y == "<") + 2 * (y == "<<") - (y == ">")
                if self.language == "typescript" and k > j and depth <= 0 and self.toks[k].line > self.toks[k - 1].line and self.toks[k - 1].text not in ("|", "&", ":", "="):
                    break
                k = self.end(k) + 1 if y in _PAIRS and self.toks[k].kind == "op" else k + 1
            if not skip:
                self.typed_part("field", list(range(i, min(k, stop))), parent, "field")
            return k + 1 if k < stop and self.toks[k].text in (";", ",") else max(k, i + 1)
        if self.language == "cpp" and x.text == ":":
            return j + 1  # access label
        if self.language == "cpp" and x.text in (";", "=", "{"):
            k = j
            while k < stop and self.toks[k].text != ";":
                k = self.end(k) + 1 if self.toks[k].text in _PAIRS else k + 1
            if not skip and last_word > i and self.toks[i].text not in ("using", "typedef", "friend", "return"):
                self.typed_part("field", list(range(i, j)), parent, "field")
            return k + 1
        return i


def pieces(text: str, language: str, window: int = WINDOW) -> Iterator[list[Fact]]:
    """The facts of `run()` in order, in lists that a window of tokens gave; it grows where a declaration is longer.

    What ends before the first bracket that stays open, and some way before the window does, does not depend on what follows.
    """
    scanner = Scanner.__new__(Scanner)
    scanner.begin(text, language)
    at, line, first, size = 0, 1, 0, window
    while True:
        scanner.read(at, line, first, size)
        ends: list[tuple[int, int]] = []
        if len(scanner.toks) < size:
            scanner.body(first, len(scanner.toks), 0, "root")
            yield scanner.out
            return
        old = len(scanner.out)
        scanner.body(first, len(scanner.toks), 0, "root", ends, min(scanner.open, len(scanner.toks) - AHEAD))
        if not ends or ends[-1][0] <= first:
            del scanner.out[old:]
            size *= 2
            continue
        cut, n = ends[-1]
        yield scanner.out[:n]
        scanner.out, scanner.before = [], scanner.before + n
        at, line, first, size = scanner.toks[cut - 1].start, scanner.toks[cut - 1].line, 1, window


def frontend(language: str) -> Frontend:
    read = lambda text: Scanner(text, language).run()
    read.pieces = lambda text: pieces(text, language)
    read.by_lines = language
    return read
