"""Packages and modules as scopes: what a file's path makes of it, and what paths that begin at a module mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: files that stand for their folder
FOLDER_FILES = ("lib", "main", "mod", "index", "__init__")
#: first parts of paths that are no names (see `sources.frontends`)
HERE, ABOVE = "<here>", "<above>"


def _joined(path: Column) -> Column:
    return F.array_join(path, "/")


def module_paths(unit_meta: DataFrame) -> DataFrame:
    """(unit_id, package_index, package_name, path, folder): the module that a file is, and its folder, inside its package; a leading `src` does not count."""
    root = F.coalesce("package_root", "project_root", F.lit(""))
    inside = F.when(F.startswith("file_path", F.concat(root, F.lit("/"))), F.expr("substring(file_path, length(coalesce(package_root, project_root, '')) + 2)")).otherwise(F.col("file_path"))
    parts = F.filter(F.split(inside, "/"), lambda x: x != "")
    rows = unit_meta.select("unit_id", "package_index", F.coalesce("package_name", "project_name").alias("package_name"), parts.alias("parts"))
    folder = F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0)))
    rows = rows.withColumn("folder", folder).withColumn("folder", F.when(F.get("folder", F.lit(0)) == "src", F.slice("folder", F.lit(2), F.size("folder"))).otherwise(F.col("folder")))
    stem = F.regexp_replace(F.element_at("parts", -1), "\\.[^.]*$", "")
    return rows.withColumn("stem", stem).select(
        "unit_id", "package_index", "package_name", F.when(F.col("stem").isin(*FOLDER_FILES), F.col("folder")).otherwise(F.concat("folder", F.array("stem"))).alias("path"), "folder", "stem"
    )


def module_scopes(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """`roots(unit_id, scope_id)` -> (package_index, path as text, name, above, scope_id, unit_id), one row a module; the package is the module without a path.

    A file's scope is its module's; folders without a file of their own get negative ids.
    """
    steps = paths.select("package_index", "package_name", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    steps = steps.groupBy("package_index", "path").agg(F.min("package_name").alias("package_name"))
    own = paths.join(roots, "unit_id").groupBy("package_index", "path").agg(F.min(F.struct((F.col("stem") == "main").alias("late"), "scope_id", "unit_id")).alias("file"))
    made = -F.abs(F.xxhash64(F.lit("module"), "package_index", _joined(F.col("path")))) - 1
    here = steps.join(own, ["package_index", "path"], "left")
    size = F.size("path")
    return here.select(
        "package_index", _joined(F.col("path")).alias("path"), F.when(size > 0, F.element_at("path", -1)).otherwise(F.replace("package_name", F.lit("-"), F.lit("_"))).alias("name"),
        F.when(size > 0, _joined(F.slice("path", F.lit(1), size - 1))).alias("above"), F.coalesce("file.scope_id", made).alias("scope_id"), F.col("file.unit_id").alias("unit_id"),
    )


def module_symbols(modules: DataFrame, global_scope: int) -> tuple[DataFrame, DataFrame]:
    """(symbols, scope_symbol) of modules: each is declared in the one above it, packages globally."""
    symbols = modules.select(F.col("scope_id").alias("symbol_id"), "name", F.lit("module").alias("kind"), "unit_id", "package_index", F.col("scope_id").alias("owned_scope_id"))
    up = modules.select("package_index", F.col("path").alias("above"), F.col("scope_id").alias("up"))
    inner = modules.where("above is not null").join(up, ["package_index", "above"]).select(F.col("up").alias("scope_id"), "name", F.col("scope_id").alias("symbol_id"))
    outer = modules.where("above is null").select(F.lit(global_scope).cast("long").alias("scope_id"), "name", F.col("scope_id").alias("symbol_id"))
    return symbols, inner.unionAll(outer).where("scope_id <> symbol_id").withColumn("ordinal", F.lit(0).cast("long"))


def inline_names(chain: DataFrame, named_modules: DataFrame) -> DataFrame:
    """`chain(scope_id, ancestor_id, depth)`, `named_modules(ancestor_id, name)` -> (scope_id, inline): modules inside the file around a scope, outermost first."""
    met = chain.join(named_modules, "ancestor_id")
    return met.groupBy("scope_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "name")), asc=False), lambda x: x["name"]).alias("inline"))


def is_anchored(parts: Column) -> Column:
    return F.get(parts, F.lit(0)).isin("crate", "self", "super", HERE)


def anchored(parts: Column, path: Column, folder: Column) -> Column:
    """Parts from the package on, of a path that begins with `crate`, `self`, `super` or HERE; null for others."""
    rest = lambda n: F.slice(parts, n + 1, F.size(parts))
    less = lambda a, n: F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))
    first, supers, above = F.get(parts, F.lit(0)), _leading(parts, "super", 0), _leading(parts, ABOVE, 1)
    return (
        F.when(first == "crate", rest(F.lit(1))).when(first == "self", F.concat(path, rest(F.lit(1))))
        .when(first == "super", F.concat(less(path, supers), rest(supers))).when(first == HERE, F.concat(less(folder, above), rest(above + 1)))
    )


def _leading(parts: Column, word: str, skip: int) -> Column:
    """How many parts from `skip` on are this word, up to the first other one."""
    rest = F.slice(parts, F.lit(skip + 1), F.size(parts))
    other = F.array_position(F.transform(rest, lambda x: x != word), F.lit(True))
    return F.when(other > 0, other - 1).otherwise(F.size(rest)).cast("int")
