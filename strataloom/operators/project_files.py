"""What repositories say of themselves: README files and project settings."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.incremental import newest_contents
from strataloom.operators.text import keywords_by_section

# Names of README files in Markdown, the first that a folder has counts.
README_NAMES = ("readme.md", "readme.markdown")


def _placed(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return newest_contents(files).withColumns({"name": name, "folder": F.regexp_replace("path", r"/?[^/]*$", "")})


def readme_texts(files: DataFrame) -> DataFrame:
    """repo_id, folder, path, text: of each folder the first file by name that begins with readme, whatever its case."""
    found = _placed(files).where(F.lower("name").startswith("readme"))
    return found.groupBy("repo_id", "folder").agg(F.min_by(F.struct("path", "content"), "name").alias("r")).select("repo_id", "folder", "r.path", F.col("r.content").alias("text"))


def readme_chunks(files: DataFrame) -> DataFrame:
    """repo_id, file, symbol, title, start_line, end_line, summary, code: the sections of each folder's README in Markdown.

    The README of a folder is the first of `README_NAMES` that it has; blank ones have no sections.
    Sections of equal titles have equal symbols. The summary names file and title and gives the
    section's keywords.
    """
    place = F.array_position(F.array(*(F.lit(n) for n in README_NAMES)), F.lower("name"))
    found = _placed(files).withColumn("place", place).where("place > 0")
    readme = found.groupBy("repo_id", "folder").agg(F.min_by(F.struct("path", "name", "content"), F.struct("place", "name")).alias("r")).select("repo_id", "r.*")
    texts = readme.select(F.struct("repo_id", "path", "name").alias("key"), "content")
    sections = keywords_by_section(texts, "key", "content").join(texts, "key")
    body = F.array_join(F.slice(F.split("content", "\r?\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    name = F.col("key.name")
    return sections.select(
        "key.repo_id", F.col("key.path").alias("file"), F.concat(name, F.lit("#"), "title").alias("symbol"), "title", "start_line", "end_line",
        F.concat_ws(" / ", name, "title", F.nullif("keywords", F.lit(""))).alias("summary"), F.concat_ws("\n", name, "title", F.lit(""), body).alias("code"),
    )


def project_facts(files: DataFrame, pattern: str = r"(?:^|/)pyproject\.toml$") -> DataFrame:
    """repo_id, path, name, version, requires_python, dependencies, scripts of the TOML files with a path like `pattern`.

    A file that isn't TOML gives no row, nor does one without content; what a project doesn't say is
    null, or an empty list or map. Values of other types than expected count as absent.
    """

    def facts(content: str) -> tuple | None:
        try:
            project = tomllib.loads(content).get("project", {})
        except (tomllib.TOMLDecodeError, RecursionError):
            return None
        project = project if isinstance(project, dict) else {}
        plain = [project[k] if isinstance(project.get(k), str) else None for k in ("name", "version", "requires-python")]
        deps, scripts = project.get("dependencies", []), project.get("scripts", {})
        return (*plain, [d for d in deps if isinstance(d, str)] if isinstance(deps, list) else [], [(k, v) for k, v in scripts.items() if isinstance(v, str)] if isinstance(scripts, dict) else [])

    rows = newest_contents(files.where(F.col("path").rlike(pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            found = [facts(c) for c in batch.column("content").to_pylist()]
            kept = pa.array([i for i, f in enumerate(found) if f is not None], pa.int64())
            columns = list(zip(*(f for f in found if f is not None))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("repo_id").take(kept), batch.column("path").take(kept), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["repo_id", "path", "name", "version", "requires_python", "dependencies", "scripts"])

    kind = rows.schema["repo_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"repo_id {kind}, path string, name string, version string, requires_python string, dependencies array<string>, scripts map<string, string>")


def project_scripts(facts: DataFrame) -> DataFrame:
    """repo_id, path, command, target: the commands that installing a project makes; confirmed entry points."""
    return facts.select("repo_id", "path", F.explode("scripts").alias("command", "target"))


def config_chunks(files: DataFrame, pattern: str = r"(?:^|/)pyproject\.toml$") -> DataFrame:
    """repo_id, file, kind, start_line, end_line, summary, code: one chunk of each project's settings, told in a line."""
    facts = project_facts(files, pattern)
    told = F.concat_ws(
        " / ", "path", F.when(F.size("scripts") > 0, F.concat(F.lit("commands: "), F.array_join(F.transform(F.map_entries("scripts"), lambda e: F.concat(e["key"], F.lit(" -> "), e["value"])), ", "))),
        F.concat(F.lit("name: "), "name"), F.concat(F.lit("version: "), "version"), F.concat(F.lit("python: "), "requires_python"), F.when(F.size("dependencies") > 0, F.concat(F.lit("dependencies: "), F.array_join("dependencies", ", "))),
    )
    texts = newest_contents(files).select("repo_id", "path", "content")
    lines = F.size(F.split(F.regexp_replace("content", r"\r?\n$", ""), "\r?\n"))
    return facts.join(texts, ["repo_id", "path"]).select("repo_id", F.col("path").alias("file"), F.lit("config").alias("kind"), F.lit(1).cast("bigint").alias("start_line"), lines.cast("bigint").alias("end_line"), told.alias("summary"), F.col("content").alias("code"))
