"""Source files to a program graph: parse (the only Python step), then joins and windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kinds import LANGUAGES
from ..operators import meta as M
from ..operators import modules as P
from ..operators import resolve as N
from ..operators.graph import Graph
from ..operators.blocks import members
from ..operators.link import Linker
from ..operators.relations import union_all
from ..operators.resolve import chase
from ..session import settle
from ..sources import scan

_FACTS = "unit_id long, local_id int, parent_local int, kind string, name string, symbol_kind string, start_byte int, end_byte int, start_line int, types array<string>, contracts array<string>, decorators array<string>, callee string, names_symbol boolean, scope_local int, func_local int, holder_local int, chain array<int>, parent_kind string, lookup_local int"
SCOPES = ("root", "module", "class", "trait", "interface", "enum", "func", "method", "impl")
FUNCS, HOLDERS = ("func", "method"), ("class", "trait", "interface", "enum", "impl")
TYPED = ("class", "alias", "const", "type_parameter")  # blocks whose type is their symbol's
GLOBAL = 0
IMPORT_ROUNDS = 2
UNIT = 1 << 24
ROWS = 1 << 13  # facts a batch, at least


def _above(pieces, n: int = 0, root: tuple | None = None) -> Iterator[list[tuple]]:
    """Per fact, from place `n` on: its place, the fact, nearest scope, function and type above it, and, for scopes, the chain from itself to the root. Parents come first, in the same piece or as the root."""
    for piece in pieces:
        out: list[tuple] = []
        for i, f in enumerate(piece, n):
            if f.parent < 0:
                root = (i, f, None, None, None, [i])
                out.append(root)
                continue
            _, up, scope, func, holder, _ = above = out[f.parent - n] if f.parent >= n else root
            scope = f.parent if up.kind in SCOPES else scope
            func = f.parent if up.kind in FUNCS else func
            holder = f.parent if up.kind in HOLDERS else holder
            chain = above[5] if scope == f.parent else (out[scope - n] if scope >= n else root)[5]
            out.append((i, f, scope, func, holder, [i, *chain] if f.kind in SCOPES else None))
        n += len(piece)
        yield out


def _names(piece: list[tuple]) -> list[tuple]:
    """What `_above` gives, with the parent's kind and the nearest scope that holds names; only such scopes, modules and the root keep their chains."""
    loud = {0} | {scope for _, f, scope, *_ in piece if f.kind == "import" or f.names_symbol and f.name is not None} | {i for i, f, *_ in piece if f.kind == "module"}
    kinds, nearest = {-1: None, 0: "root"}, {None: None, 0: 0}
    out = []
    for i, f, scope, func, holder, chain in piece:
        kinds[i] = f.kind
        if chain:
            nearest[i] = next(x for x in chain if x in loud)
        out.append((i, f, scope, func, holder, chain if i in loud else None, kinds[f.parent], nearest[scope]))
    return out


def _placed(facts: list, n: int = 0, root: tuple | None = None) -> list[tuple]:
    return _names(next(_above([facts], n, root and root[:6])))


def _parser(batches):
    from ..sources import lines
    from ..sources.frontends import frontend

    strings = pa.list_(pa.string())
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), strings, strings, strings, pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int32())
    names = [c.split()[0] for c in _FACTS.split(", ")]

    def put(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        rows = []
        for place in range(batch.num_rows):
            unit, content, lang = (batch.column(c)[place].as_py() for c in ("unit_id", "content", "lang"))
            read = frontend(lang)
            if getattr(read, "by_lines", None) and (content or b"").isascii():
                pieces = lines.read(unit, content or b"", read.by_lines, _placed)
            else:
                text = (content or b"").decode("utf-8", errors="replace")
                del content
                pieces = map(_names, _above(read.pieces(text) if hasattr(read, "pieces") else iter([read(text)])))
            for piece in pieces:
                if piece and isinstance(piece[0], pa.Array):
                    yield pa.RecordBatch.from_arrays(piece, names=names)
                    continue
                rows += [(unit, i, f.parent, f.kind, f.name, f.symbol_kind, f.start, f.end, f.line, f.types, f.contracts, f.decorators, f.callee, f.names_symbol, *near) for i, f, *near in piece]
                if len(rows) >= ROWS:
                    yield put(rows)
                    rows = []
        if rows:
            yield put(rows)


def parse(files: DataFrame) -> DataFrame:
    """`files(unit_id, content, lang)` -> one row a block, ids unit * 2**24 + place + 1."""
    facts = settle(files.select("unit_id", "content", "lang").mapInArrow(_parser, _FACTS), "facts")
    block_id = lambda c: F.col("unit_id") * UNIT + F.col(c) + 1
    return facts.withColumns({
        "block_id": block_id("local_id"), "parent_id": F.when(F.col("parent_local") >= 0, block_id("parent_local")), "scope_id": block_id("scope_local"),
        "enclosing_id": block_id("func_local"), "holder": block_id("holder_local"), "lookup_id": block_id("lookup_local"), "chain": F.transform("chain", lambda x: F.col("unit_id") * UNIT + x + 1),
    })


def _uid(*columns: str) -> Column:
    return F.xxhash64(*columns)


class Project:
    """`files(unit_id, content, lang)` and `unit_meta`, and what they mean. Each step is taken, and written, when something first asks for it.

    A reference is looked up once a scope that holds names, text and kinds, whatever the number of blocks that make it.
    """

    def __init__(self, files: DataFrame, unit_meta: DataFrame):
        self.files, self.unit_meta = files, unit_meta
        self.where = unit_meta.select("unit_id", "package_index")

    # as written

    @cached_property
    def facts(self) -> DataFrame:
        return parse(self.files)

    @cached_property
    def located(self) -> DataFrame:
        """The blocks without what their names mean."""
        return self.facts.where("kind not in ('local', 'import', 'type_parameter')").select("block_id", "unit_id", "kind", "name", "parent_id", "parent_kind", (F.col("names_symbol") & F.col("name").isNotNull()).alias("names"))

    @property
    def uses(self) -> DataFrame:
        """Types, contracts and decorators as blocks name them, with the kinds that are `wanted` ('' for any)."""
        of = []
        for role, column in (("type", "types"), ("contract", "contracts"), ("decorator", "decorators")):
            rows = self.facts.where("kind <> 'import' and lookup_id is not null")
            rows = rows.select("block_id", "unit_id", "kind", "name", "symbol_kind", (F.col("names_symbol") & F.col("name").isNotNull()).alias("names"), "lookup_id", F.lit(role).alias("role"), F.posexplode(column).alias("place", "full"))
            of.append(rows.withColumn("wanted", F.lit("" if role == "decorator" else "types")))
        return of[0].unionAll(of[1]).unionAll(of[2])

    # names

    @cached_property
    def _roots(self) -> DataFrame:
        return settle(self.facts.where("kind in ('root', 'module')").select("unit_id", F.col("block_id").alias("scope_id"), "kind", "name"), "roots")

    @cached_property
    def _paths(self) -> DataFrame:
        return settle(P.module_paths(self.unit_meta).join(self._roots.where("kind = 'root'").select("unit_id"), "unit_id", "left_semi"), "module-paths")

    @cached_property
    def _modules(self) -> DataFrame:
        return settle(P.module_scopes(self._paths, self._roots.where("kind = 'root'").select("unit_id", "scope_id")), "modules")

    @cached_property
    def declared(self) -> DataFrame:
        """Symbols that can matter to a lookup: types, type parameters, and all whose name is part of a reference; they carry their block's id."""
        facts = self.facts
        texts = facts.select(F.explode(F.concat("types", "contracts", "decorators", F.array("callee"))).alias("full")).where("full is not null").distinct()
        said = texts.select(F.explode(F.split("full", "\\.")).alias("name")).distinct()
        named = facts.where("names_symbol and name is not null and scope_id is not null").select(
            F.col("block_id").alias("symbol_id"), "name", F.col("symbol_kind").alias("kind"), F.col("kind").alias("block_kind"), "unit_id", "scope_id", F.col("local_id").cast("long").alias("ordinal"))
        kept = F.col("block_kind").isin(*HOLDERS, "type_parameter")
        named = named.where(kept).unionAll(named.where(~kept).join(said, "name", "left_semi").select(*named.columns))
        return settle(named.join(self.where, "unit_id").select("symbol_id", "name", "kind", "block_kind", "unit_id", "package_index", "scope_id", "ordinal"), "declared")

    @cached_property
    def _own_names(self) -> DataFrame:
        """(scope_id, name, symbol_id, ordinal) without imports; what is declared at the top of files or in modules is global as well."""
        declared = self.declared
        shared = declared.join(self._roots.select("scope_id"), "scope_id", "left_semi").select(F.lit(GLOBAL).cast("long").alias("scope_id"), "name", "symbol_id", F.col("symbol_id").alias("ordinal"))
        return settle(declared.select("scope_id", "name", "symbol_id", "ordinal").unionAll(shared).unionByName(P.module_symbols(self._modules, GLOBAL)[1]), "scope-symbols")

    @cached_property
    def symbols(self) -> DataFrame:
        own = self.declared.select("symbol_id", "name", "kind", "unit_id", "package_index", F.when(F.col("kind") != "field", F.col("symbol_id")).alias("owned_scope_id"))
        return settle(own.unionByName(P.module_symbols(self._modules, GLOBAL)[0]), "symbols")

    @cached_property
    def _packages(self) -> DataFrame:
        return self._modules.where("path = ''").select("package_index", F.col("scope_id").alias("package_scope"))

    @cached_property
    def _chained(self) -> DataFrame:
        return settle(self.facts.where("chain is not null").select("unit_id", F.col("block_id").alias("scope_id"), "chain"), "chained")

    @cached_property
    def chain(self) -> DataFrame:
        """A scope that holds names, the ones around it, its package, all."""
        chained = self._chained
        inner = chained.select("scope_id", F.posexplode("chain").alias("depth", "ancestor_id"))
        around = chained.join(self.where, "unit_id").join(self._packages, "package_index").where(~F.array_contains("chain", F.col("package_scope")))
        around = around.select("scope_id", F.size("chain").alias("depth"), F.col("package_scope").alias("ancestor_id"))
        outer = chained.select("scope_id", (F.size("chain") + 1).alias("depth"), F.lit(GLOBAL).cast("long").alias("ancestor_id"))
        return settle(inner.unionByName(around).unionByName(outer).withColumn("place", F.lit(0).cast("long")), "scope-chains")

    @cached_property
    def _inline(self) -> DataFrame:
        inner = self._chained.select("scope_id", F.posexplode("chain").alias("depth", "ancestor_id"))
        return P.inline_names(inner, self._roots.where("kind = 'module'").select(F.col("scope_id").alias("ancestor_id"), "name"))

    @cached_property
    def scope_symbol(self) -> DataFrame:
        """Names by scope with what is imported there."""
        imports = settle(self.facts.where("kind = 'import'").select("block_id", "unit_id", "scope_id", "name", F.split(F.col("types")[0], "\\.").alias("parts")), "imports")
        names = self._own_names
        for _ in range(0 if imports.isEmpty() else IMPORT_ROUNDS):  # what is imported may itself be an import
            refs = imports.join(self.where.withColumnRenamed("package_index", "ref_package"), "unit_id").select(F.col("block_id").alias("ref_id"), "scope_id", "parts", F.lit(None).cast("string").alias("kinds"), F.col("unit_id").alias("ref_unit"), "ref_package")
            hit = settle(self._by_path(refs, names).withColumnRenamed("ref_id", "block_id"), "import-hits")
            met = imports.join(hit, "block_id")
            bound = met.where("name <> '*'").select("scope_id", "name", "symbol_id", F.col("block_id").alias("ordinal"))
            opened = met.where("name = '*'").select("scope_id", "symbol_id").join(self.symbols.select("symbol_id", F.col("owned_scope_id").alias("inside")), "symbol_id").select("scope_id", "inside")
            inside = opened.join(names.withColumnRenamed("scope_id", "inside"), "inside").select("scope_id", "name", "symbol_id", "ordinal")
            names = settle(self._own_names.unionAll(bound).unionAll(inside).groupBy("scope_id", "name", "symbol_id").agg(F.max("ordinal").alias("ordinal")), "scope-symbols")
        return names

    def _by_path(self, refs: DataFrame, names: DataFrame) -> DataFrame:
        """`refs(ref_id, scope_id, parts, kinds, ref_unit, ref_package)`: paths from a module or package, or from a name in scope: (ref_id, symbol_id)."""
        at = refs.join(self._paths.select(F.col("unit_id").alias("ref_unit"), "path", "folder"), "ref_unit").join(self._inline, "scope_id", "left").join(self._packages.withColumnRenamed("package_index", "ref_package"), "ref_package", "left")
        from_package = P.anchored(F.col("parts"), F.concat("path", F.coalesce("inline", F.array().cast("array<string>"))), F.col("folder"))
        at = at.select("ref_id", "scope_id", F.coalesce(from_package, "parts").alias("parts"), "kinds", "ref_unit", "ref_package", F.when(from_package.isNotNull(), F.col("package_scope")).alias("start"))
        return N.qualified(at, self.chain, GLOBAL, names, self.symbols)

    def _meaning(self, asked: DataFrame) -> DataFrame:
        """`asked(lookup_id, unit_id, full, wanted)`, no row twice -> (lookup_id, full, wanted, symbol_id).

        Paths are followed; one that leads nowhere known goes by its last name, unless it begins at a module or is a call's.
        """
        refs = asked.join(self.where, "unit_id").select(
            _uid("lookup_id", "full", "wanted").alias("ref_id"), F.col("lookup_id").alias("scope_id"), "full", "wanted", F.split("full", "\\.").alias("parts"), F.when(F.col("wanted") != "", F.col("wanted")).alias("kinds"),
            F.col("unit_id").alias("ref_unit"), F.col("package_index").alias("ref_package"))
        refs = settle(refs, "asked")
        by_path = settle(self._by_path(refs.where("size(parts) > 1").select("ref_id", "scope_id", "parts", "kinds", "ref_unit", "ref_package"), self.scope_symbol), "path-hits")
        rest = refs.where((F.size("parts") == 1) | (F.col("wanted") != "call_target") & ~P.is_anchored(F.col("parts"))).join(by_path, "ref_id", "left_anti")
        by_name = N.lexical(rest.select("ref_id", "scope_id", F.element_at("parts", -1).alias("name"), "kinds", "ref_unit", "ref_package"), self.chain, self.scope_symbol, self.symbols)
        return settle(refs.select("ref_id", F.col("scope_id").alias("lookup_id"), "full", "wanted").join(by_path.unionAll(by_name), "ref_id").drop("ref_id"), "meanings")

    @cached_property
    def meanings(self) -> DataFrame:
        """Of the uses."""
        return self._meaning(self.uses.select("lookup_id", "unit_id", "full", "wanted").distinct())

    def bound(self, role: str, *kinds: str) -> DataFrame:
        """The uses of a role, by blocks of these kinds or all, with the symbol that each means."""
        uses = self.uses.where(F.col("role") == role)
        uses = uses.where(F.col("kind").isin(*kinds)) if kinds else uses
        return uses.join(self.meanings, ["lookup_id", "full", "wanted"]).where("symbol_id <> block_id").drop("lookup_id", "full", "wanted")

    def own_type(self, *kinds: str) -> DataFrame:
        return self.bound("type", *kinds).where("place = 0").withColumnRenamed("symbol_id", "type_symbol_id")

    # calls

    @cached_property
    def _impl_target(self) -> DataFrame:
        return settle(self.own_type("impl").select(F.col("block_id").alias("holder"), F.col("type_symbol_id").alias("target")), "impl-targets")

    @cached_property
    def calls(self) -> DataFrame:
        """(call_id, enclosing_id, symbol_id): a bare name lexically; self and this in the own type; Type.name in that type; variables in their declared type."""
        facts, size, first = self.facts, F.size("parts"), F.col("parts")[0]
        self_words = first.isin("self", "this", "Self", "cls")
        callee, before = F.element_at("parts", -1), F.array_join(F.slice("parts", F.lit(1), size - 1), ".")
        calls = facts.where("callee is not null and lookup_id is not null").select("block_id", "unit_id", "lookup_id", "callee", F.split("callee", "\\.").alias("parts"), "enclosing_id", "holder", "start_byte")
        bare = calls.where(size == 1)
        dotted = calls.where((size >= 2) & (first != "?") & (~self_words | F.col("holder").isNull())).withColumn("before", before)
        asked = bare.unionAll(dotted.drop("before")).select("lookup_id", "unit_id", F.col("callee").alias("full"), F.lit("call_target").alias("wanted"))
        asked = asked.unionAll(dotted.where(~self_words).select("lookup_id", "unit_id", "before", F.lit("defined_type")))
        answers = self._meaning(asked.distinct())
        meant = lambda wanted, full, symbol: answers.where(F.col("wanted") == wanted).select("lookup_id", F.col("full").alias(full), F.col("symbol_id").alias(symbol))
        target = meant("call_target", "callee", "symbol_id")
        types = self.meanings.where("wanted = 'types'").select("lookup_id", F.col("full").alias("type"), F.col("symbol_id").alias("receiver_id"))
        holder_type = facts.where(F.col("kind").isin("class", "trait", "interface", "enum")).select(F.col("block_id").alias("holder"), F.col("block_id").alias("target")).unionAll(self._impl_target)
        mine = ["block_id", "enclosing_id", "unit_id"]
        # the type of a parameter, local variable or own field receives the calls on it; of the variables the last before the
        # call counts, which hides a type of its name even if its own type is unknown
        variable = facts.where("kind in ('parameter', 'local', 'field') and name is not null").select(F.col("block_id").alias("variable_id"), "kind", F.col("parent_id").alias("owner"), F.col("name").alias("variable"), "end_byte", "lookup_id", F.get("types", F.lit(0)).alias("type"))
        on_local = calls.where((size == 2) & ~self_words).select("block_id", F.col("enclosing_id").alias("owner"), first.alias("variable"), "start_byte")
        on_local = on_local.join(variable.where("kind <> 'field'").drop("kind"), ["owner", "variable"]).where("end_byte <= start_byte")
        on_local = on_local.groupBy("block_id").agg(F.max(F.struct("variable_id", "lookup_id", "type")).alias("v")).select("block_id", "v.lookup_id", "v.type")
        on_local = on_local.join(types, ["lookup_id", "type"], "left").select("block_id", F.lit(True).alias("is_variable"), "receiver_id")
        dotted = dotted.join(target, ["lookup_id", "callee"], "left").select(*mine, "lookup_id", "before", callee.alias("name"), self_words.alias("on_self"), "symbol_id")
        dotted = settle(dotted.join(on_local, "block_id", "left"), "dotted-calls")
        typed = dotted.where("not on_self and is_variable is null and symbol_id is null").drop("receiver_id").join(meant("defined_type", "before", "receiver_id"), ["lookup_id", "before"])
        fields = variable.where("kind = 'field'").join(types, ["lookup_id", "type"]).groupBy("owner", "variable").agg(F.min_by("receiver_id", "variable_id").alias("receiver_id"))
        on_self = calls.where(self_words & F.col("holder").isNotNull()).select(*mine, size.alias("n"), callee.alias("name"), F.col("parts")[1].alias("variable"), "holder").join(holder_type, "holder").drop("holder").withColumnRenamed("target", "owner")
        on_field = on_self.where("n = 3").join(fields, ["owner", "variable"])
        wanted = [dotted.where("is_variable and receiver_id is not null"), typed, on_self.where("n = 2").withColumnRenamed("owner", "receiver_id"), on_field]
        wanted = union_all([x.select(*mine, "receiver_id", "name") for x in wanted])
        key = ["receiver_id", "name", "unit_id"]
        asked = settle(wanted.select(*key).distinct().join(self.where, "unit_id").withColumn("ref_id", _uid(*key)), "members-asked")
        members_up = self._impl_target.select(F.col("target").alias("scope_id"), F.col("holder").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"))
        bases_up = self.own_type("class").select(F.col("block_id").alias("scope_id"), F.col("type_symbol_id").alias("parent_id"), F.lit(1).cast("long").alias("ordinal"))
        identity = self.symbols.select("symbol_id", F.col("symbol_id").alias("target_id"))
        found = N.members(asked.select("ref_id", "receiver_id", "name", F.col("unit_id").alias("ref_unit"), F.col("package_index").alias("ref_package")), identity, self.symbols, members_up.unionAll(bases_up), self.scope_symbol)
        found = settle(asked.join(found, "ref_id").select(*key, "symbol_id"), "members")
        hits = [bare.join(target, ["lookup_id", "callee"]), dotted.where("is_variable is null and symbol_id is not null"), wanted.join(found, key)]
        return settle(union_all([x.select(F.col("block_id").alias("call_id"), "enclosing_id", "symbol_id") for x in hits]), "calls")

    # tables

    @cached_property
    def _per(self) -> DataFrame:
        """(block_id, own_type, arguments, met, marks): what blocks name, as symbols in order."""
        bound = self.bound("type").unionAll(self.bound("contract")).unionAll(self.bound("decorator"))
        listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", "symbol_id")))), lambda x: x["symbol_id"])
        role, later = F.col("role"), F.col("place") > 0
        per = bound.groupBy("block_id").agg(
            F.min(F.when((role == "type") & ~later, F.col("symbol_id"))).alias("own_type"), listed((role == "type") & later).alias("arguments"), listed(role == "contract").alias("met"), listed(role == "decorator").alias("marks")
        )
        return settle(per, "bound-uses")

    @cached_property
    def symbol(self) -> DataFrame:
        none = F.array().cast("array<long>")
        symbol = self.facts.where("names_symbol and name is not null").join(self._per, "block_id", "left").select(
            F.col("block_id").alias("symbol_id"), F.col("symbol_kind").alias("kind"), F.when(F.col("kind").isin(*TYPED), F.col("own_type")).alias("type_of"),
            F.when(F.col("kind") != "type_parameter", F.col("block_id")).alias("block_id"), F.col("block_id").alias("owned_scope_id"), F.coalesce("met", none).alias("nested_types"), F.coalesce("marks", none).alias("decorators"),
        )
        return settle(symbol, "symbol-table")

    @cached_property
    def block(self) -> DataFrame:
        """Without type_deps."""
        none = F.array().cast("array<long>")
        block = self.facts.where("kind not in ('local', 'import', 'type_parameter')").join(self._per, "block_id", "left").select(
            "block_id", "unit_id", "kind", "name", "parent_id", F.col("local_id").cast("long").alias("ordinal"), F.when(F.col("names_symbol") & F.col("name").isNotNull(), F.col("block_id")).alias("symbol_id"), "symbol_kind",
            F.col("own_type").alias("type_ref"), F.col("own_type").alias("type_symbol_id"), F.col("start_line").cast("long").alias("start_line"), F.when(F.size("arguments") > 0, F.col("arguments")).alias("nested_types"), F.coalesce("marks", none).alias("decorators"),
        )
        return settle(block, "blocks")

    @cached_property
    def target(self) -> DataFrame:
        """(symbol_id, kind, type_of, block_id) of the symbols that a name can lead to, as in the symbol table."""
        of = self.own_type(*TYPED).where("names").select(F.col("block_id").alias("symbol_id"), F.col("type_symbol_id").alias("type_of"))
        return settle(self.declared.join(of, "symbol_id", "left").select("symbol_id", "kind", "type_of", F.when(F.col("block_kind") != "type_parameter", F.col("symbol_id")).alias("block_id")), "targets")

    @cached_property
    def typed(self) -> DataFrame:
        """(block_id, unit_id, kind, name, type_symbol_id) of blocks that have a type."""
        return self.own_type().where("kind not in ('local', 'import', 'type_parameter')").select("block_id", "unit_id", "kind", "name", "type_symbol_id")

    @cached_property
    def argued(self) -> DataFrame:
        """(block_id, nested_types) of blocks whose type has arguments."""
        rows = self.bound("type").where("place > 0 and kind not in ('local', 'import', 'type_parameter')")
        return rows.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol_id"))), lambda x: x["symbol_id"]).alias("nested_types"))

    @cached_property
    def linker(self) -> ProjectLinker:
        return ProjectLinker(self)

    @cached_property
    def graph(self) -> Graph:
        relation = settle(self.linker.relations(), "relation", "relation")
        block = settle(self.block.join(self.linker.type_deps(), "block_id", "left"), "blocks")
        return Graph(block, relation, self.unit_meta, True)


class ProjectLinker(Linker):
    """The rules of the linker over what a project has resolved so far: uses are taken as they are, not from tables of all blocks and symbols."""

    def __init__(self, project: Project):
        self.project = project

    block = property(lambda self: self.project.located)
    calls = property(lambda self: self.project.calls)
    scope_symbol = property(lambda self: self.project.scope_symbol)

    @cached_property
    def impls(self) -> DataFrame:
        p = self.project
        own = p.own_type("impl").select("block_id", F.col("type_symbol_id").alias("target_symbol"))
        contract = p.bound("contract", "impl").groupBy("block_id").agg(F.min_by("symbol_id", "place").alias("contract_symbol"))
        later = p.bound("type", "impl").where("place > 0").groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol_id"))), lambda x: x["symbol_id"]).alias("target_args"))
        return settle(own.join(contract, "block_id", "full").join(later, "block_id", "full"), "impls")

    @cached_property
    def chased(self) -> DataFrame:
        """Only symbols that stand for another."""
        return settle(chase(self.project.target).where("symbol_id <> target_id"), "chased")

    @cached_property
    def owner(self) -> DataFrame:
        return self.project.target.where("block_id is not null").select("symbol_id", F.col("block_id").alias("at"), F.col("kind").alias("at_kind"))

    @cached_property
    def member(self) -> DataFrame:
        return members(self.block)

    def _to_block(self, df: DataFrame, symbol_col: str, follow: bool = True) -> DataFrame:
        if follow:
            moved = self.chased.select(F.col("symbol_id").alias(symbol_col), F.col("target_id").alias("_t"))
            df = df.join(moved, symbol_col, "left").withColumn("_t", F.coalesce("_t", symbol_col))
        else:
            df = df.withColumn("_t", F.col(symbol_col))
        return df.join(self.owner.select(F.col("symbol_id").alias("_t"), F.col("at").alias("dst"), F.col("at_kind").alias("dst_kind")), "_t").drop("_t")

    def _scopes_of(self, *kinds: str) -> DataFrame:
        return self.block.where(F.col("kind").isin(*kinds) & F.col("names")).select(F.col("block_id").alias("src"), F.col("block_id").alias("scope_id"))

    def _typed_symbols(self) -> DataFrame:
        return self.project.target.where("type_of is not null").select("symbol_id", "kind", "type_of")

    def _bases(self, kind: str) -> DataFrame:
        return self.project.own_type(kind).where("names").select(F.col("block_id").alias("src"), F.col("type_symbol_id").alias("type_of"))

    def _nested(self, *kinds: str) -> DataFrame:
        return self._to_block(self.project.bound("contract", *kinds).where("names").select(F.col("block_id").alias("src"), "kind", F.col("symbol_id").alias("n")), "n")

    def _decorators(self, *kinds: str) -> DataFrame:
        return self._to_block(self.project.bound("decorator", *kinds).where("names").select(F.col("block_id").alias("src"), F.col("symbol_id").alias("d")), "d", follow=False)

    def _types(self, *kinds: str) -> DataFrame:
        return self.project.own_type(*kinds).select(F.col("block_id").alias("src"), F.col("type_symbol_id").alias("s"))


def build(files: DataFrame, unit_meta: DataFrame) -> Project:
    """`files(unit_id, content, lang)`, `unit_meta` -> blocks, symbols, calls and, from them, the graph."""
    return Project(files, unit_meta)


def load(spark: SparkSession, dirs: list[str] = (), files: list[str] = (), languages: list[str] | None = None) -> Project:
    """Read folders or files of this machine and build their graph."""
    paths = scan.list_sources(dirs, files, languages)
    sources = scan.read_sources(spark, paths, languages).withColumnRenamed("file_id", "unit_id")
    sources = settle(sources, "sources")
    containers = tuple(dict.fromkeys(c for n in languages or LANGUAGES for c in LANGUAGES[n]["containers"]))
    meta = settle(M.unit_meta(sources.select("unit_id", "path"), scan.read_manifests(spark, scan.manifests_above(paths, languages)), containers), "unit-meta")
    return build(sources, meta)

