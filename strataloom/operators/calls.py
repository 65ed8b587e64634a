"""Call sites, their resolution to definitions, and the graph they make.

Resolution never lists candidate pairs: definitions are counted beforehand by name, by name and
file, by name and class, and by name and the key under which an import reaches them, and each call
looks its counts up by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.names import BUILTINS
from strataloom.functions.windows import numbered

CALL = r"(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)\("
RULES = ("builtin", "external", "unique", "same_class", "same_file", "import", "ambiguous")


def call_sites(chunks: DataFrame) -> DataFrame:
    """chunk_id, repo_id, file, symbol, parent, imports, receiver and name of each call in Python functions."""
    functions = chunks.where(F.col("kind").isin("function", "method") & F.col("file").endswith(".py"))
    body = F.regexp_replace("code", r"(?s)^\s*(?:async )?def\s+\w+\(", "")
    sites = functions.select("chunk_id", "repo_id", "file", "symbol", "parent", "imports", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(f"({CALL})"), F.lit(1)))).alias("call"))
    return sites.withColumns({"receiver": F.regexp_extract("call", "^" + CALL, 1), "name": F.regexp_extract("call", "^" + CALL, 2)}).drop("call")


def definitions(chunks: DataFrame) -> DataFrame:
    """repo_id, name, file, parent, symbol, id of the Python classes, functions and methods; each overload is one row."""
    plain = F.regexp_replace("symbol", r"#\d+$", "")
    kept = chunks.where(F.col("kind").isin("class", "function", "method") & F.col("file").endswith(".py"))
    leaf = F.regexp_extract(plain, r"([A-Za-z_]\w*)$", 1)
    return kept.select("repo_id", leaf.alias("name"), "file", F.coalesce("parent", F.lit("")).alias("parent"), "symbol", F.concat_ws("::", "file", plain).alias("id")).distinct()


def _reach_key(file: Column) -> Column:
    """Key under which imports reach a file: its last dotted part, marked whether more stands before it."""
    module = F.regexp_replace(file, r"\.py$", "")
    return F.concat(F.when(F.contains(module, F.lit("/")), "2:").otherwise("1:"), F.regexp_extract(module, r"([^/]*)$", 1))


def _import_keys(name: Column) -> Column:
    """Keys of the files that an import reaches: with the same last part, or, at the root, with a name that it ends with."""
    last = F.regexp_extract(name, r"([^.]*)$", 1)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.length(last), F.lit(1))), lambda i: F.concat(F.lit("1:"), F.substr(last, i)))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("2:"), last)), ends))


def _counted(defs: DataFrame, *by: str, prefix: str) -> DataFrame:
    return defs.groupBy(*by).agg(F.count("*").alias(f"{prefix}_n"), F.min("id").alias(f"{prefix}_id"))


def resolve_calls(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """chunk_id, src, receiver, name, rule and dst: the first rule that leaves exactly one definition.

    builtin (a name of the language, whatever the receiver), external (no definition in the
    repository), unique, same_class (receiver self), same_file, import (an import reaches the
    definition's file), ambiguous.
    """
    site = sites.withColumns({"src": F.concat_ws("::", "file", F.regexp_replace("symbol", r"#\d+$", "")), "own": F.coalesce("parent", F.lit(""))})
    named = site.join(_counted(defs, "repo_id", "name", prefix="r"), ["repo_id", "name"], "left")
    # Imports matter only to names with several definitions, and are the same for all calls of a name with the same imports.
    several = named.where((F.col("r_n") > 1) & ~F.col("name").isin(*BUILTINS)).select("repo_id", "name", F.coalesce("imports", F.array().cast("array<string>")).alias("reached")).distinct()
    keyed = _counted(defs.withColumn("key", _reach_key(F.col("file"))), "repo_id", "name", "key", prefix="i")
    wanted = several.select("repo_id", "name", "reached", F.explode(F.array_distinct(F.flatten(F.transform("reached", _import_keys)))).alias("key"))
    imported = wanted.join(keyed, ["repo_id", "name", "key"]).groupBy("repo_id", "name", F.col("reached").alias("imports")).agg(F.sum("i_n").alias("i_n"), F.min("i_id").alias("i_id"))
    joined = (
        named
        .join(_counted(defs, "repo_id", "name", "file", prefix="f"), ["repo_id", "name", "file"], "left")
        .join(_counted(defs, "repo_id", "name", "file", "parent", prefix="c").withColumnRenamed("parent", "own"), ["repo_id", "name", "file", "own"], "left")
        .join(imported, ["repo_id", "name", "imports"], "left")
    )
    rule = (
        F.when(F.col("name").isin(*BUILTINS), "builtin").when(F.col("r_n").isNull(), "external").when(F.col("r_n") == 1, "unique")
        .when((F.col("receiver") == "self") & (F.col("own") != "") & (F.col("c_n") == 1), "same_class").when(F.col("f_n") == 1, "same_file").when(F.col("i_n") == 1, "import").otherwise("ambiguous")
    )
    dst = F.when(F.col("rule") == "unique", F.col("r_id")).when(F.col("rule") == "same_class", F.col("c_id")).when(F.col("rule") == "same_file", F.col("f_id")).when(F.col("rule") == "import", F.col("i_id"))
    return joined.withColumn("rule", rule).select("chunk_id", "repo_id", "src", "receiver", "name", "rule", dst.alias("dst"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """repo_id, src, dst without repetition and loops."""
    return resolved.where("dst is not null and src <> dst").select("repo_id", "src", "dst").distinct()


def stored_edges(chunks: DataFrame) -> DataFrame:
    """repo_id, src, dst of the calls that chunks already hold."""
    return chunks.select("repo_id", F.concat_ws("::", "file", "symbol").alias("src"), F.explode("calls").alias("dst")).where("src <> dst").distinct()


def neighbours(edges: DataFrame, direction: str = "out") -> DataFrame:
    """repo_id, file, other and n: edges between different files, counted from one side."""
    files = edges.select("repo_id", F.substring_index("src", "::", 1).alias("a"), F.substring_index("dst", "::", 1).alias("b")).where("a <> b")
    file, other = ("a", "b") if direction == "out" else ("b", "a")
    return files.groupBy("repo_id", F.col(file).alias("file"), F.col(other).alias("other")).agg(F.count("*").alias("n"))


def callers(edges: DataFrame, limit: int = 10) -> DataFrame:
    """repo_id, dst, n_callers and callers: the first `limit` in order, joined by a comma."""
    # The limit on the rank keeps all but the first callers of a task out of the shuffle; the count needs no list.
    first = edges.withColumn("rank", numbered(Window.partitionBy("repo_id", "dst").orderBy("src"))).where(F.col("rank") <= limit)
    shown = first.groupBy("repo_id", "dst").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("callers"))
    return edges.groupBy("repo_id", "dst").agg(F.count("*").alias("n_callers")).join(shown, ["repo_id", "dst"])


def enclosing_symbols(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """repo_id, file, line and symbol: the innermost function, method or class around each point.

    Each symbol is spread over its own lines, so the join is by key; the smallest span wins, then
    the earlier start, then the name. Points outside every symbol are left out.
    """
    spans = chunks.where(F.col("kind").isin("function", "method", "class")).select("repo_id", "file", "symbol", "start_line", "end_line").distinct()
    lines = spans.where("end_line >= start_line").select("repo_id", "file", F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line", "symbol").alias("s"), F.explode(F.sequence("start_line", "end_line")).alias("line"))
    inner = points.select("repo_id", "file", "line").distinct().join(lines, ["repo_id", "file", "line"]).groupBy("repo_id", "file", "line").agg(F.min("s").alias("s"))
    return inner.select("repo_id", "file", F.col("line").cast("bigint").alias("line"), F.col("s.symbol").alias("symbol"))
