"""Modules, imports and dependencies of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.names import STDLIB, dotted_suffixes, import_target, java_dependency, module_name
from strataloom.operators.parsing import java_facts


def module_entries(files: DataFrame) -> DataFrame:
    """repo_id, module, path of the Python and Java files.

    A module is named from its anchor: the deepest folder above it that has no __init__.py. Outside
    packages that is the file's own folder, so the name is the stem; a folder's own name stands for
    its __init__.py, and one without a folder is left out.
    """
    paths = files.where(F.col("path").rlike(r"\.(?:py|java)$")).select("repo_id", "path").distinct()
    packages = paths.where(F.col("path").rlike(r"(?:^|/)__init__\.py$")).select("repo_id", F.regexp_replace("path", r"/?__init__\.py$", "").alias("folder"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    levels = paths.select("repo_id", "path", F.posexplode(above).alias("level", "folder"))
    anchors = (
        levels.join(packages, ["repo_id", "folder"], "left_anti").groupBy("repo_id", "path").agg(F.max("level").alias("level"))
    )
    kept = F.array_join(F.slice(parts, F.col("level") + 1, F.size(parts) - F.col("level")), "/")
    return anchors.select("repo_id", module_name(kept).alias("module"), "path").where("module <> '__init__'")


def unique_modules(entries: DataFrame) -> DataFrame:
    """repo_id, module, path of the names that exactly one file has."""
    return entries.groupBy("repo_id", "module").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")


def file_imports(chunks: DataFrame) -> DataFrame:
    """repo_id, file, name of all imports, once for each file."""
    return chunks.where("kind = 'file'").select("repo_id", "file", F.explode("imports").alias("name")).distinct()


def package_names(files: DataFrame) -> DataFrame:
    """repo_id, package: the packages that the Java files declare."""
    return java_facts(files).where("package is not null").select("repo_id", "package").distinct()


def internal_names(entries: DataFrame, packages: DataFrame) -> DataFrame:
    """repo_id, name: all that an import from inside may name, modules and packages."""
    return entries.select("repo_id", F.col("module").alias("name")).unionByName(packages.select("repo_id", F.col("package").alias("name"))).distinct()


def internal_imports(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Imports with `internal`: relative, or any dotted suffix of what they name is one of the repository's `names`."""
    suffixes = dotted_suffixes(import_target(F.col("name"), F.col("file")))
    names = names.select("repo_id", F.col("name").alias("suffix"))
    hits = imports.select("repo_id", "file", "name", F.explode(suffixes).alias("suffix")).join(names, ["repo_id", "suffix"]).select("repo_id", "file", "name", F.lit(True).alias("hit")).distinct()
    marked = imports.join(hits, ["repo_id", "file", "name"], "left")
    return marked.withColumn("internal", F.coalesce("hit", F.lit(False)) | F.col("name").startswith(".")).drop("hit")


def import_edges(imports: DataFrame, entries: DataFrame) -> DataFrame:
    """repo_id, src, dst between files: the longest suffix of an import that names one file only."""
    suffixes = imports.where(~F.col("name").startswith(".")).select("repo_id", "file", "name", F.posexplode(dotted_suffixes(import_target(F.col("name"), F.col("file")))).alias("pos", "module"))
    found = suffixes.join(unique_modules(entries), ["repo_id", "module"]).groupBy("repo_id", "file", "name").agg(F.min(F.struct("pos", "path")).alias("best"))
    return found.select("repo_id", F.col("file").alias("src"), F.col("best.path").alias("dst")).where("src <> dst").distinct()


def dependencies(imports: DataFrame, names: DataFrame) -> DataFrame:
    """repo_id, dep, source (third_party or stdlib) and n_files that use it, of the imports from outside."""
    outside = internal_imports(imports, names).where("not internal")
    java = F.col("file").endswith(".java")
    first = F.substring_index("name", ".", 1)
    dep = F.when(java, F.coalesce(java_dependency(F.col("name")), F.regexp_extract("name", r"^(javax?)\.", 1))).otherwise(first)
    kind = F.when(java & F.col("name").rlike(r"^javax?\."), "stdlib").when(~java & first.isin(*sorted(STDLIB)), "stdlib").otherwise("third_party")
    return outside.select("repo_id", dep.alias("dep"), kind.alias("source"), "file").groupBy("repo_id", "dep", "source").agg(F.countDistinct("file").alias("n_files"))


def import_totals(imports: DataFrame, names: DataFrame) -> DataFrame:
    """repo_id, n_third_party and n_stdlib (different dependencies) and n_internal (imports) of each repository."""
    inside = internal_imports(imports, names).groupBy("repo_id").agg(F.count_if("internal").alias("n_internal"))
    outside = dependencies(imports, names).groupBy("repo_id").agg(F.count_if(F.col("source") == "third_party").alias("n_third_party"), F.count_if(F.col("source") == "stdlib").alias("n_stdlib"))
    return inside.join(outside, "repo_id", "left").na.fill(0, ["n_third_party", "n_stdlib"])
