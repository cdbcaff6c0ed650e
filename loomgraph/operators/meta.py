"""Where a file belongs: project, package (nearest manifest above it), module (a telling folder inside the package)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, common_prefix, file_name, parent_dir

MIN_SIBLING_RATIO, MIN_SIBLINGS, MAX_DOMINANCE = 0.05, 1, 0.80


def project_root(files: DataFrame) -> DataFrame:
    """One row: project_root, project_name. The common prefix of all folders is that of the least and the greatest."""
    dirs = files.select(F.split(F.coalesce(parent_dir(F.col("path")), F.lit("")), "/").alias("d"))
    root = dirs.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.array_join(common_prefix(F.col("a"), F.col("b")), "/").alias("project_root"))
    return root.withColumn("project_name", F.coalesce(F.nullif(file_name(F.col("project_root")), F.lit("")), F.lit("project")))


def manifest_name(path: Column, content: Column) -> Column:
    """The package's name as its manifest gives it, else its folder's name; npm scopes lose '@' and '/' turns to '_'."""
    npm = F.replace(F.regexp_replace(F.get_json_object(content, "$.name"), "^@", ""), F.lit("/"), F.lit("_"))
    toml = F.regexp_extract(content, '(?s)(?:^|\\n)\\s*\\[package\\](?:(?!\\n\\s*\\[).)*?\\n\\s*name\\s*=\\s*"([^"]+)"', 1)
    own = F.when(file_name(path) == "package.json", npm).when(file_name(path) == "Cargo.toml", toml)
    return F.coalesce(F.nullif(own, F.lit("")), file_name(parent_dir(path)))


def packages(manifests: DataFrame) -> DataFrame:
    """`manifests(path, content string)` -> (package_root, package_name), one a folder."""
    rows = manifests.select(parent_dir(F.col("path")).alias("package_root"), "path", manifest_name(F.col("path"), F.col("content")).alias("package_name"))
    return rows.where("package_root is not null").groupBy("package_root").agg(F.min_by("package_name", "path").alias("package_name"))


def owners(files: DataFrame, roots: DataFrame, root_col: str = "package_root") -> DataFrame:
    """Each file with its deepest root above it; ancestors are exploded, so a prefix join becomes an equi-join."""
    up = files.select("unit_id", F.explode(ancestors(F.col("path"))).alias(root_col))
    met = up.join(roots, root_col).groupBy("unit_id").agg(F.max_by(F.struct(*[roots[c] for c in roots.columns]), F.length(root_col)).alias("r"))
    return files.join(met, "unit_id", "left").select(*files.columns, "r.*")


def _segments(containers: tuple[str, ...]) -> tuple[Column, Column]:
    """(physical folders below the package, positions of those that mean something)."""
    physical = F.when(F.col("inner").isNull(), F.array().cast("array<string>")).otherwise(F.split("inner", "/"))
    telling = F.filter(F.transform(F.col("physical"), lambda x, i: F.struct(x.alias("name"), (i + 1).alias("at"))), lambda s: ~s["name"].isin(*containers) & (s["name"] != ""))
    return physical, telling


def modules(owned: DataFrame, containers: tuple[str, ...]) -> DataFrame:
    """`owned(unit_id, path, package_root)` with module_name and module_root.

    A folder is a module if enough files lie beside it (max(floor(5 %), 1) of the package's) and it holds at most 80 % of
    them and itself; the first such folder of the path counts, else the first folder.
    """
    physical, telling = _segments(containers)
    rows = owned.withColumn("inner", F.expr("case when path like concat(package_root, '/%') then substring(path, length(package_root) + 2) end"))
    rows = rows.withColumn("inner", parent_dir(F.col("inner"))).withColumn("physical", physical).withColumn("telling", telling)
    rows = rows.withColumn("names", F.transform("telling", lambda s: s["name"]))
    total = rows.groupBy("package_root").agg(F.count(F.lit(1)).alias("files"))
    steps = rows.where(F.size("names") > 0).select("unit_id", "package_root", "names", F.posexplode("names").alias("depth", "name"))
    steps = steps.select("unit_id", "package_root", "depth", "name", F.array_join(F.slice("names", F.lit(1), F.col("depth")), "/").alias("above"))
    here = steps.groupBy("package_root", "above", "name").agg(F.count(F.lit(1)).alias("here"))
    here = here.withColumn("siblings", F.sum("here").over(Window.partitionBy("package_root", "above")) - F.col("here"))
    least = F.floor(F.greatest(F.col("files") * MIN_SIBLING_RATIO, F.lit(float(MIN_SIBLINGS))))
    good = (F.col("siblings") >= least) & (F.col("here") / (F.col("here") + F.col("siblings")) <= MAX_DOMINANCE)
    met = steps.join(here, ["package_root", "above", "name"]).join(total, "package_root")
    pick = met.groupBy("unit_id").agg(F.coalesce(F.min(F.when(good, F.col("depth"))), F.lit(0)).alias("depth"))
    out = rows.join(pick, "unit_id", "left")
    step = F.get("telling", F.col("depth"))
    root = F.concat(F.col("package_root"), F.lit("/"), F.array_join(F.slice("physical", F.lit(1), step["at"]), "/"))
    return out.withColumn("module_name", F.when(F.col("depth").isNotNull(), step["name"])).withColumn("module_root", F.when(F.col("depth").isNotNull(), root)).select(*owned.columns, "module_name", "module_root")


def folder_counts(files: DataFrame) -> DataFrame:
    """`files(path)` -> (folder, files, beside): files below a folder, and those below its siblings (the folder above, less itself)."""
    per = files.select(F.explode(ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    up = per.select(F.col("folder").alias("above"), F.col("files").alias("all"))
    at = per.withColumn("above", parent_dir(F.col("folder")))
    return at.join(up, "above", "left").select("folder", "files", (F.coalesce("all", "files") - F.col("files")).alias("beside"))


def package_index(rows: DataFrame) -> DataFrame:
    """Adds package_index: order of the packages' first units; files without a package share 0."""
    first = rows.where("package_root is not null").groupBy("package_root").agg(F.min("unit_id").alias("first"))
    index = first.withColumn("package_index", (F.row_number().over(Window.orderBy("first")) - 1).cast("long")).select("package_root", "package_index")
    return rows.join(index, "package_root", "left").withColumn("package_index", F.coalesce("package_index", F.lit(0).cast("long")))


def unit_meta(files: DataFrame, manifests: DataFrame, containers: tuple[str, ...]) -> DataFrame:
    """`files(unit_id, path)` and `manifests(path, content)` -> the unit_meta table."""
    found = packages(manifests)
    rows = owners(files.select("unit_id", "path"), found)
    project = F.broadcast(project_root(files))  # one row
    rows = rows.join(project).withColumn("package_root", F.coalesce("package_root", F.when(~_any(found), F.col("project_root"))))
    rows = package_index(modules(rows, containers))
    lost = F.col("package_name").isNull()
    return rows.select(
        "unit_id", "project_name", "project_root", "package_name", F.when(~lost, F.col("package_root")).alias("package_root"), "module_name", "module_root",
        file_name(F.col("path")).alias("file_name"), F.col("path").alias("file_path"), F.when(lost, F.lit(0).cast("long")).otherwise(F.col("package_index")).alias("package_index"),
    )


def _any(df: DataFrame) -> Column:
    return F.lit(not df.isEmpty())
