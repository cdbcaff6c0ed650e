"""Files in: folder walks with ignore rules, file lists, manifests; all reads by Spark's binaryFile source."""

from __future__ import annotations

import fnmatch
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kinds import IGNORE_FILES, LANGUAGES
from ..schema import SOURCE_FILE


class Ignore:
    """Patterns of one ignore file, relative to its folder; the last that matches decides, '!' takes back."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.rules = folder, []
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.lstrip("!")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            self.rules.append((keep, only_dirs, anchored, line))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        inside, out = os.path.relpath(path, self.folder), None
        for keep, only_dirs, anchored, pattern in self.rules:
            if only_dirs and not is_dir:
                continue
            if anchored:
                hit = fnmatch.fnmatch(inside, pattern) or "**/" in pattern and fnmatch.fnmatch(inside, pattern.replace("**/", ""))
            else:
                hit = fnmatch.fnmatch(os.path.basename(path), pattern)
            if hit:
                out = not keep
        return out


def walk(root: str, ignore_files: tuple[str, ...] = IGNORE_FILES) -> list[str]:
    """Files below a folder of this machine: no hidden ones, no links, nothing that an ignore file names."""
    found: list[str] = []

    def visit(folder: str, rules: list[Ignore]) -> None:
        own = [Ignore(folder, Path(folder, n).read_text(errors="replace").splitlines()) for n in ignore_files if os.path.isfile(os.path.join(folder, n))]
        rules = [*rules, *own]
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if name.startswith(".") or os.path.islink(path):
                continue
            is_dir = os.path.isdir(path)
            verdicts = [v for r in rules if (v := r.verdict(path, is_dir)) is not None]
            if verdicts and verdicts[-1]:
                continue
            visit(path, rules) if is_dir else found.append(path)

    visit(root, [])
    return found


def language_table(spark: SparkSession, languages: list[str] | None = None) -> DataFrame:
    rows = [(e, name) for name in languages or LANGUAGES for e in LANGUAGES[name]["extensions"]]
    return spark.createDataFrame(rows, "ext string, lang string")


def list_sources(dirs: list[str] = (), files: list[str] = (), languages: list[str] | None = None, extra_ignore: tuple[str, ...] = ()) -> list[str]:
    """Paths to read, each once in order of first sight. Folders or files, not both; ValueError if nothing fits."""
    if dirs and files:
        raise ValueError("give folders or files, not both")
    known = {e for name in languages or LANGUAGES for e in LANGUAGES[name]["extensions"]}
    paths = list(files) or [p for d in dirs for p in walk(d, (*IGNORE_FILES, *extra_ignore))]
    paths = list(dict.fromkeys(p for p in paths if files or p.rpartition(".")[2] in known and "." in os.path.basename(p)))
    if not paths:
        raise ValueError("no source file matches")
    return paths


def read_sources(spark: SparkSession, paths: list[str] | str, languages: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """source_file(file_id, path, content, content_hash, size, lang); ids follow the paths' order; unknown languages go."""
    reader = spark.read.format("binaryFile")
    raw = (reader.option("recursiveFileLookup", "true") if recursive else reader).load(paths)
    ext = F.regexp_extract("path", "\\.([^./]+)$", 1)
    rows = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", "length", ext.alias("ext"))
    rows = rows.join(F.broadcast(language_table(spark, languages)), "ext")  # a fixed table
    ids = rows.select("path").distinct().withColumn("file_id", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))
    out = rows.dropDuplicates(["path"]).join(ids, "path").select("file_id", "path", "content", F.xxhash64("content").alias("content_hash"), F.col("length").alias("size"), "lang")
    return out.select(*[c.split()[0] for c in SOURCE_FILE.split(", ")])


def by_size(files: DataFrame) -> DataFrame:
    """Largest first, the order in which a parallel parse is best fed; ties by path."""
    return files.orderBy(F.desc("size"), "path")


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content string)."""
    if not paths:
        return spark.createDataFrame([], "path string, content string")
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "utf-8").alias("content"))


def manifests_above(paths: list[str], languages: list[str] | None = None) -> list[str]:
    """Manifests in the folders above the given files."""
    names = {m for n in languages or LANGUAGES for m in LANGUAGES[n]["manifests"]}
    folders = {str(p) for path in paths for p in Path(path).parents}
    return sorted(os.path.join(d, n) for d in folders for n in names if os.path.isfile(os.path.join(d, n)))


def write_text(text: str, path: str | None = None) -> None:
    if path is None:
        print(text, end="")
    else:
        Path(path).write_text(text)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A snapshot: one Parquet table each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
