"""Column expressions for paths, names and text; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^\\./", "")


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def parent_dir(path: Column) -> Column:
    """Null for a name without a folder."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Name without its last extension; a leading dot is no extension."""
    name = file_name(path)
    return F.when(name.rlike("^.+\\.[^.]*$"), F.regexp_extract(name, "^(.+)\\.[^.]*$", 1)).otherwise(name)


def extension(path: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name(path), "^.+\\.([^.]*)$", 1), F.lit(""))


def ancestors(path: Column) -> Column:
    """Folders above a path, nearest last: a/b/c.x -> [a, a/b]; absolute paths keep their slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def common_prefix(a: Column, b: Column) -> Column:
    """Common leading elements of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.slice(a, 1, F.coalesce(F.array_min(differs) - 1, n)))


def strip_prefix(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2))


def qualified_name(*levels: Column) -> Column:
    """Known level names joined with dots; null if none is known."""
    return F.nullif(F.concat_ws(".", *levels), F.lit(""))


def sanitize_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")


def escape_dot(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def ellipsis(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, max(0, width - 3)), F.lit("..."))).otherwise(text)


def display_name(name: Column, kind: Column, block_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(kind, F.lit(":"), block_id.cast("string")))


def module_key(package: Column, namespace: Column) -> Column:
    return F.concat(F.coalesce(package, F.lit("<unknown_package>")), F.lit("::"), F.coalesce(namespace, F.lit("<root>")))


def location(path: Column, line: Column) -> Column:
    return F.when(path.isNotNull(), F.concat(path, F.lit(":"), line.cast("string")))
