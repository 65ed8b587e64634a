"""Repository overviews: totals, entry points, ranked questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.names import is_test_path
from strataloom.functions.windows import rank_within
from strataloom.operators.incremental import newest_contents

# File names of entry points, and parts of names that speak against one.
ENTRY_FILES = ("__main__.py", "main.py", "cli.py", "app.py", "manage.py")
NON_ENTRY = ("test", "dummy", "example", "sample", "bench", "demo")


def totals(chunks: DataFrame) -> DataFrame:
    """repo_id, n_files, n_lines, n_symbols, n_summarised."""
    whole = F.col("kind") == "file"
    symbol = F.col("kind").isin("class", "method", "function")
    return chunks.groupBy("repo_id").agg(
        F.count_if(whole).alias("n_files"), F.coalesce(F.sum(F.when(whole, F.col("end_line"))), F.lit(0)).alias("n_lines"), F.count_if(symbol).alias("n_symbols"),
        F.count_if(symbol & (F.length("summary") > 0)).alias("n_summarised"),
    )


def index_stats(chunks: DataFrame, manifest: DataFrame, collected: DataFrame) -> DataFrame:
    """repo_id, n_files, n_chunks, n_summarised and n_removed (files of the manifest that are not collected any more)."""
    symbol = F.col("kind").isin("class", "method", "function")
    counts = chunks.groupBy("repo_id").agg(F.count_if(F.col("kind") == "file").alias("n_files"), F.count("*").alias("n_chunks"), F.count_if(symbol & (F.length("summary") > 0)).alias("n_summarised"))
    gone = manifest.join(collected.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").groupBy("repo_id").agg(F.count("*").alias("n_removed"))
    return counts.join(gone, "repo_id", "left").na.fill(0, ["n_removed"])


def entry_points(files: DataFrame) -> DataFrame:
    """repo_id, path, evidence, place: files that look as if a program starts there.

    Evidence is a main block or main method in the content, else the file's name; names that hint at
    tests go last, then files in folders, then by path.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    java = F.col("path").endswith(".java") & F.col("content").rlike(r"\bstatic\s+void\s+main\s*\(")
    python = F.col("path").endswith(".py") & F.contains("content", F.lit("__main__"))
    evidence = F.when(java & F.contains("content", F.lit("@SpringBootApplication")), "main method, Spring Boot").when(java, "main method").when(python, "main block").when(name.isin(*ENTRY_FILES), "file name")
    found = newest_contents(files).withColumn("evidence", evidence).where("evidence is not null")
    weak = F.lower(name).rlike("|".join(NON_ENTRY))
    return rank_within(found, ["repo_id"], [weak, F.contains("path", F.lit("/")), "path"], "place").select("repo_id", "path", "evidence", "place")


def flow_ranking(edges: DataFrame) -> DataFrame:
    """repo_id, id, n_out, n_in, place: symbols that call at least two others, by calls in both directions; dunders and tests left out."""
    outs = edges.groupBy("repo_id", F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_out"))
    ins = edges.groupBy("repo_id", F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n_in"))
    both = outs.where("n_out >= 2").join(ins, ["repo_id", "id"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    kept = both.where(~F.col("id").rlike(r"__\w+__$") & ~is_test_path(F.substring_index("id", "::", 1)))
    return rank_within(kept, ["repo_id"], [F.desc(F.col("n_out") + F.col("n_in")), "id"], "place")


def type_ranking(neighbours: DataFrame) -> DataFrame:
    """repo_id, file, n_uses, n_used_by, place: Java files by how many files they use and are used by; tests count on neither side."""
    pairs = neighbours.where(~is_test_path(F.col("src")) & ~is_test_path(F.col("dst"))).select("repo_id", "src", "dst").distinct()
    ends = pairs.select("repo_id", F.explode(F.array(F.struct(F.col("src").alias("file"), F.lit(1).alias("uses")), F.struct(F.col("dst").alias("file"), F.lit(0).alias("uses")))).alias("e"))
    counted = ends.groupBy("repo_id", "e.file").agg(F.sum("e.uses").alias("n_uses"), F.sum(1 - F.col("e.uses")).alias("n_used_by"))
    return rank_within(counted, ["repo_id"], [F.desc(F.col("n_uses") + F.col("n_used_by")), "file"], "place")


def flows_and_types(flows: DataFrame, types: DataFrame) -> DataFrame:
    """repo_id, id, place: the flow family, call flows first and types after them."""
    both = flows.select("repo_id", "id", F.lit(0).alias("part"), F.col("place").alias("at")).unionByName(types.select("repo_id", F.col("file").alias("id"), F.lit(1).alias("part"), F.col("place").alias("at")))
    return rank_within(both, ["repo_id"], ["part", "at"], "place").select("repo_id", "id", "place")


def file_map(chunks: DataFrame) -> DataFrame:
    """repo_id, file, text: the file's own summary, then those of its symbols in source order; a heading where it has symbols."""
    files = chunks.where("kind = 'file'").groupBy("repo_id", "file").agg(F.min(F.coalesce("summary", F.lit(""))).alias("own"))
    told = F.when(F.length("summary") > 0, F.struct("start_line", "chunk_id", F.concat(F.lit("    "), "symbol", F.lit(": "), "summary").alias("line")))
    symbols = chunks.where(F.col("kind").isin("class", "method", "function")).groupBy("repo_id", "file").agg(F.array_sort(F.collect_list(told)).alias("told"))
    lines = F.concat(F.array("own"), F.when(F.col("told").isNotNull(), F.concat(F.array(F.lit("  symbols")), F.transform("told", lambda x: x["line"]))).otherwise(F.array().cast("array<string>")))
    return files.join(symbols, ["repo_id", "file"], "left").select("repo_id", "file", F.array_join(lines, "\n").alias("text"))


def main_files(chunks: DataFrame) -> DataFrame:
    """repo_id, file: of each repository the file with the longest overview text, tests left out; of equal ones the first by path."""
    sizes = file_map(chunks).where(~is_test_path(F.col("file"))).select("repo_id", "file", F.length("text").alias("size"))
    return sizes.groupBy("repo_id").agg(F.min_by("file", F.struct((-F.col("size")).alias("s"), "file")).alias("file"))


def file_ranking(chunks: DataFrame) -> DataFrame:
    """repo_id, file, n_symbols, place: files by number of symbols; tests and the main file left out."""
    main = main_files(chunks)
    counted = chunks.where(F.col("kind").isin("class", "method", "function")).groupBy("repo_id", "file").agg(F.count("*").alias("n_symbols"))
    kept = counted.where(~is_test_path(F.col("file"))).join(main, ["repo_id", "file"], "left_anti")
    return rank_within(kept, ["repo_id"], [F.desc("n_symbols"), "file"], "place")


def dependency_ranking(deps: DataFrame) -> DataFrame:
    """repo_id, dep, n_files, place of the third-party dependencies."""
    third = deps.where("source = 'third_party' and dep is not null").select("repo_id", "dep", "n_files")
    return rank_within(third, ["repo_id"], [F.desc("n_files"), "dep"], "place")


def interleave(flows: DataFrame, deps: DataFrame, files: DataFrame, size: int = 5) -> DataFrame:
    """repo_id, number, set_no, family, item: round robin of flow, dependency, flow, file; sets of `size` from the second on."""
    at = F.col("place") - 1
    parts = [
        flows.select("repo_id", F.floor(at / 2).alias("cycle"), (2 * (at % 2)).alias("slot"), F.lit("flow").alias("family"), F.col("id").alias("item")),
        deps.select("repo_id", at.cast("bigint").alias("cycle"), F.lit(1).alias("slot"), F.lit("dependency").alias("family"), F.col("dep").alias("item")),
        files.select("repo_id", at.cast("bigint").alias("cycle"), F.lit(3).alias("slot"), F.lit("file").alias("family"), F.col("file").alias("item")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rank_within(every, ["repo_id"], ["cycle", "slot"], "number").select("repo_id", "number", (F.floor((F.col("number") - 1) / size) + 2).alias("set_no"), "family", "item")


# Least number of symbols, most documented share, least parsed share of a repository worth an index; tokens and prices of the estimate.
MIN_SYMBOLS, MAX_DOCUMENTED, MIN_PARSED = 10, 0.8, 0.95
PROMPT_TOKENS, SUMMARY_TOKENS, CHARS_PER_TOKEN = 300, 50, 4


def screening(files: DataFrame, facts: DataFrame) -> DataFrame:
    """repo_id and what decides whether a repository's Python files are worth an index.

    files: its collected files; facts: `documentation_counts` of those that parse. n_files, n_parsed,
    n_symbols, n_documented, n_tests, n_tokens (what summaries would read and write) and verdict: the first of
    unparsable, too_small, documented_already that holds, else fit.
    """
    python = newest_contents(files.where(F.col("path").endswith(".py")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    test = F.contains("path", F.lit("tests/")) | F.col("path").startswith("test/") | name.startswith("test_") | name.endswith("_test.py")
    kept = python.select("repo_id", "path", F.length("content").alias("chars"), test.alias("test")).join(facts.select("repo_id", "path", "n_symbols", "n_documented"), ["repo_id", "path"], "left")
    sums = kept.groupBy("repo_id").agg(
        F.count("*").alias("n_files"), F.count("n_symbols").alias("n_parsed"), F.coalesce(F.sum("n_symbols"), F.lit(0)).alias("n_symbols"), F.coalesce(F.sum("n_documented"), F.lit(0)).alias("n_documented"),
        F.count_if("test").alias("n_tests"), F.sum("chars").alias("chars"))
    tokens = F.col("n_symbols") * (PROMPT_TOKENS + SUMMARY_TOKENS) + F.floor(F.col("chars") / CHARS_PER_TOKEN)
    verdict = (
        F.when(F.col("n_parsed") < MIN_PARSED * F.col("n_files"), "unparsable").when(F.col("n_symbols") < MIN_SYMBOLS, "too_small")
        .when(F.col("n_documented") > MAX_DOCUMENTED * F.col("n_symbols"), "documented_already").otherwise("fit")
    )
    return sums.withColumns({"n_tokens": tokens.cast("long"), "verdict": verdict}).drop("chars")
