"""Incremental indexing: content hashes, reuse, merge, prune, stale entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """repo_id, path, hash (SHA-256 of the content) of the newest row of each path; files without content are left out."""
    hashed = files.where("content is not null").select("repo_id", "path", "loaded_at", "file_id", F.sha2("content", 256).alias("hash"))
    return hashed.groupBy("repo_id", "path").agg(F.max_by("hash", F.struct("loaded_at", "file_id")).alias("hash"))


def newest_contents(files: DataFrame) -> DataFrame:
    """repo_id, path, content of the newest row of each path with content: by loaded_at, file_id and content, as far as `files` has them."""
    newest = F.struct(*(c for c in ("loaded_at", "file_id") if c in files.columns), "content")
    return files.where("content is not null").groupBy("repo_id", "path").agg(F.max_by("content", newest).alias("content"))


def changed_files(old: DataFrame, now: DataFrame) -> DataFrame:
    """repo_id, path, change: added, changed, removed or same between two manifests."""
    both = old.withColumnRenamed("hash", "before").join(now.withColumnRenamed("hash", "after"), ["repo_id", "path"], "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return both.select("repo_id", "path", change.alias("change"))


def reuse_summaries(chunks: DataFrame, cached: DataFrame, old: DataFrame, now: DataFrame) -> DataFrame:
    """chunk_id, summary, reused: the cached summary of the same chunk id where its file's hash is unchanged."""
    same = changed_files(old, now).where("change = 'same'").select("repo_id", F.col("path").alias("file"), F.lit(True).alias("same"))
    known = cached.where("summary is not null and summary <> ''").groupBy("repo_id", "file", "symbol", "start_line").agg(F.min("summary").alias("cached"))
    joined = chunks.join(same, ["repo_id", "file"], "left").join(known, ["repo_id", "file", "symbol", "start_line"], "left")
    reused = F.coalesce("same", F.lit(False)) & F.col("cached").isNotNull()
    return joined.select("chunk_id", F.when(reused, F.col("cached")).otherwise(F.coalesce("summary", F.lit(""))).alias("summary"), reused.alias("reused"))


def stage(pending: DataFrame, update: DataFrame) -> DataFrame:
    """Pending entries of a manifest (repo_id, path, hash) with those of an update over them; nothing is committed."""
    return upsert(pending, update, ["repo_id", "path"])


def commit(committed: DataFrame, pending: DataFrame) -> DataFrame:
    """The manifest after a commit: pending entries replace committed ones. What was pending is empty after it."""
    return upsert(committed, pending, ["repo_id", "path"])


def reusable(committed: DataFrame, pending: DataFrame, now: DataFrame) -> DataFrame:
    """repo_id, path, source of the files of `now`: pending where an interrupted run has this hash, committed where the last whole one has, else new."""
    joined = (
        now.join(pending.withColumnRenamed("hash", "p"), ["repo_id", "path"], "left").join(committed.withColumnRenamed("hash", "c"), ["repo_id", "path"], "left")
    )
    return joined.select("repo_id", "path", F.when(F.col("p") == F.col("hash"), "pending").when(F.col("c") == F.col("hash"), "committed").otherwise("new").alias("source"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows by key; those of `new` replace those of `old`. Both are unique by key."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def prune(stored: DataFrame, valid: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows whose key is still valid; an empty valid set leaves everything, as it means that nothing was scanned."""
    valid = valid.select(*key).distinct()
    some = valid.limit(1).agg(F.count("*").alias("__some"))  # one row, by construction
    marked = stored.join(valid.withColumn("__valid", F.lit(True)), key, "left").join(F.broadcast(some))
    return marked.where("__valid or __some = 0").select(*stored.columns)


def restore(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_id, state, code sliced anew from today's file: fresh, stale (the text differs), beyond (the file is too short) or gone."""
    newest = newest_contents(files).withColumnRenamed("path", "file")
    joined = chunks.join(newest, ["repo_id", "file"], "left").withColumn("lines", F.split("content", "\n"))
    cut = F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    state = F.when(F.col("content").isNull(), "gone").when(F.col("end_line") > F.size("lines"), "beyond").when(cut == F.col("code"), "fresh").otherwise("stale")
    return joined.select("chunk_id", state.alias("state"), F.when(F.col("content").isNotNull(), cut).alias("code"))
