"""Scans of file listings: what is kept, what is skipped and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.names import extension
from strataloom.functions.windows import numbered

# Folders that are never entered.
EXCLUDED = (".git", ".venv", "venv", "env", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", "experiments")
SUPPORTED = (".java", ".py")
MAX_BYTES = 500 * 1024


def read_tree(spark, root: str) -> DataFrame:
    """path (relative), size_bytes and content of all files below a folder, read as binary files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    return files.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))


def classify(files: DataFrame, exclude: tuple[str, ...] = (), supported: tuple[str, ...] = SUPPORTED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """status of each file: excluded (a folder is excluded or hidden), skipped_other, skipped_by_size or kept.

    Own excludes are added to the fixed ones; the size limit itself is allowed; a null size counts as fitting.
    """
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    banned = F.array(*(F.lit(x) for x in sorted({*EXCLUDED, *exclude})))
    hidden = F.exists(folders, lambda s: s.startswith(".") | F.array_contains(banned, s))
    status = (
        F.when(hidden, "excluded").when(~extension(F.col("path")).isin(*supported), "skipped_other")
        .when(F.col("size_bytes") > max_bytes, "skipped_by_size").otherwise("kept")
    )
    return files.withColumn("status", status)


def extension_counts(files: DataFrame, by: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """ext and n of the files; equal paths count once."""
    return files.select(*by, "path").distinct().groupBy(*by, extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))


def fold_counts(counts: DataFrame, top: int = 5, by: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """The `top` most frequent extensions by group and one row `other` for the rest; a rest of one is not folded."""
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("rank", numbered(w.orderBy(F.desc("n"), "ext"))).withColumn("kinds", F.count("*").over(w))
    shown = F.when((F.col("rank") <= top) | (F.col("kinds") == top + 1), F.col("ext")).otherwise("other")
    return ranked.groupBy(*by, shown.alias("ext")).agg(F.sum("n").alias("n"))
