"""Facts from the syntax of source files: symbols, imports, calls, unused parameters, comments.

The language's own parser runs inside Arrow batches on one file at a time; every fact is a row, and
what is made of the facts is Spark's work.
"""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.incremental import newest_contents

# Parameters that the protocol of a special method dictates.
FIXED_PARAMS = {
    "__exit__": {"exc_type", "exc_val", "exc_tb", "exc", "tb", "traceback"},
    "__aexit__": {"exc_type", "exc_val", "exc_tb", "exc", "tb", "traceback"},
    "__set_name__": {"owner", "name"},
    "__init_subclass__": {"cls"},
}


def tree_of(source: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _facts(files: DataFrame, extract: Callable[[str], list[tuple]], columns: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """Rows of `extract` for the content of each Python file, with its repo_id and path."""
    # A number of its own keeps the partitions of this shuffle apart: they are small, but slow to parse.
    wide = 4 * files.sparkSession.sparkContext.defaultParallelism
    rows = files.where(F.col("path").endswith(".py") & F.col("content").isNotNull()).repartition(wide, "repo_id", "path")
    rows = newest_contents(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, p, *fact) for r, p, c in zip(*(batch.column(x).to_pylist() for x in ("repo_id", "path", "content"))) for fact in extract(c)]
            if found:
                types = [pa.int64(), pa.string(), *columns.values()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], names=["repo_id", "path", *columns])

    return rows.mapInArrow(run, f"repo_id bigint, path string, {ddl}")


def _walk_symbols(source: str) -> list[tuple]:
    out = []

    def visit(node: ast.AST, parent: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                out.append((child.name, kind, child.lineno, child.end_lineno, parent, len(out)))
                visit(child, child.name, is_class)
            else:
                visit(child, parent, in_class and not isinstance(child, ast.stmt))

    if (tree := tree_of(source)) is not None:
        visit(tree, None, False)
    return out


def python_symbols(files: DataFrame) -> DataFrame:
    """repo_id, path, name, kind, start_line, end_line, parent, ord of the classes, methods and functions."""
    types = {"name": pa.string(), "kind": pa.string(), "start_line": pa.int64(), "end_line": pa.int64(), "parent": pa.string(), "ord": pa.int64()}
    return _facts(files, _walk_symbols, types, "name string, kind string, start_line bigint, end_line bigint, parent string, ord bigint")


def _imports(source: str) -> list[tuple]:
    tree, names = tree_of(source), []

    def visit(body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, ast.Import):
                names.extend(a.name for a in s.names)
            elif isinstance(s, ast.ImportFrom):
                names.append("." * s.level + (s.module or ""))
            elif isinstance(s, (ast.If, ast.Try)):
                visit(s.body)
                visit(s.orelse)
                for h in getattr(s, "handlers", []):
                    visit(h.body)

    if tree is not None:
        visit(tree.body)
    return [(n, i) for i, n in enumerate(dict.fromkeys(names))]


def python_imports(files: DataFrame) -> DataFrame:
    """repo_id, path, name, ord: imports of the top level and of its if and try blocks, without aliases, each once."""
    return _facts(files, _imports, {"name": pa.string(), "ord": pa.int64()}, "name string, ord bigint")


def _calls(source: str) -> list[tuple]:
    out = []
    if (tree := tree_of(source)) is None:
        return out
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append((f.id, None, f.lineno))
            elif isinstance(f, ast.Attribute):
                out.append((f.attr, f.value.id if isinstance(f.value, ast.Name) else None, f.end_lineno))
    return out


def python_calls(files: DataFrame) -> DataFrame:
    """repo_id, path, name, receiver (only a bare name), line of every call."""
    return _facts(files, _calls, {"name": pa.string(), "receiver": pa.string(), "line": pa.int64()}, "name string, receiver string, line bigint")


def _unused(source: str) -> list[tuple]:
    out = []
    if (tree := tree_of(source)) is None:
        return out
    owners = {child: node.name for node in ast.walk(tree) if isinstance(node, ast.ClassDef) for child in node.body}
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) or all(isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in node.body):
            continue
        used = {n.id for s in node.body for n in ast.walk(s) if isinstance(n, ast.Name)}
        a = node.args
        names = [p.arg for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        idle = [n for n in names if n not in used and n not in ("self", "cls") and not n.startswith("_") and n not in FIXED_PARAMS.get(node.name, ())]
        if idle:
            out.append((f"{owners[node]}.{node.name}" if node in owners else node.name, node.lineno, ", ".join(idle)))
    return out


def unused_params(files: DataFrame) -> DataFrame:
    """repo_id, path, symbol, line, params: functions that don't use what they take; bodies that only declare are left out."""
    return _facts(files, _unused, {"symbol": pa.string(), "line": pa.int64(), "params": pa.string()}, "symbol string, line bigint, params string")


def unused_groups(quirks: DataFrame) -> DataFrame:
    """repo_id, params, n and n_tests: findings with the same parameters, by number."""
    from strataloom.functions.names import is_test_path

    return quirks.groupBy("repo_id", "params").agg(F.count("*").alias("n"), F.count_if(is_test_path(F.col("path"))).alias("n_tests"))


def _documentation(source: str) -> list[tuple]:
    tree = tree_of(source)
    if tree is None:
        return []
    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))]
    comments = code = 0
    seen: set[int] = set()
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT and not t.string.startswith(("#!", "# -*-", "# type:", "# noqa")):
                comments += 1
            elif t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.COMMENT):
                code += t.start[0] not in seen
                seen.add(t.start[0])
    except (tokenize.TokenError, IndentationError):
        pass
    return [(ast.get_docstring(tree), len(nodes), sum(ast.get_docstring(n) is not None for n in nodes), comments, code)]


def documentation_counts(files: DataFrame) -> DataFrame:
    """repo_id, path, module_doc, n_symbols, n_documented, n_comments, n_code_lines of each file that parses."""
    types = {"module_doc": pa.string(), "n_symbols": pa.int64(), "n_documented": pa.int64(), "n_comments": pa.int64(), "n_code_lines": pa.int64()}
    return _facts(files, _documentation, types, "module_doc string, n_symbols bigint, n_documented bigint, n_comments bigint, n_code_lines bigint")


def _stripped(source: str) -> list[tuple]:
    tree = tree_of(source)
    if tree is None:
        return []
    drop: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node) is not None and len(node.body) > 1:
            drop.update(range(node.body[0].lineno, node.body[0].end_lineno + 1))
    lines = source.split("\n")
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                row, col = t.start
                lines[row - 1] = lines[row - 1][:col].rstrip()
                if not lines[row - 1]:
                    drop.add(row)
    except (tokenize.TokenError, IndentationError):
        return []
    return [("\n".join(x for i, x in enumerate(lines, 1) if i not in drop),)]


def stripped_sources(files: DataFrame) -> DataFrame:
    """repo_id, path, code without docstrings and comments, of the files that parse."""
    return _facts(files, _stripped, {"code": pa.string()}, "code string")


def java_facts(files: DataFrame) -> DataFrame:
    """repo_id, path, package, imports (wildcards as packages, in order, each once), is_entry of Java files, without a parser."""
    rows = newest_contents(files.where(F.col("path").endswith(".java")))
    plain = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", " "), r"//[^\r\n]*", " ")
    names = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*[A-Za-z0-9_])(?:\.\*)?[ \t]*;"), F.lit(1)))
    return rows.select(
        "repo_id", "path", F.nullif(F.regexp_extract(plain, r"(?m)^[ \t]*package[ \t]+([A-Za-z0-9_.]+)[ \t]*;", 1), F.lit("")).alias("package"),
        F.array_join(names, ",").alias("imports"), plain.rlike(r"\bstatic\s+void\s+main\s*\(").alias("is_entry"),
    )


def java_type_references(files: DataFrame) -> DataFrame:
    """repo_id, path, name, n: capitalised names in Java files and how often they occur; strings and comments left out."""
    rows = newest_contents(files.where(F.col("path").endswith(".java")))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", " "), r"//[^\r\n]*", " "), r'"[^"\r\n]*"', '""')
    names = rows.select("repo_id", "path", F.explode(F.regexp_extract_all(plain, F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1))).alias("name"))
    return names.groupBy("repo_id", "path", "name").agg(F.count("*").alias("n"))


def type_neighbours(references: DataFrame) -> DataFrame:
    """repo_id, src, dst, n: references to types that exactly one file of the repository is named after."""
    stems = references.select("repo_id", "path").distinct().withColumn("name", F.regexp_extract("path", r"([^/]*)\.java$", 1))
    unique = stems.groupBy("repo_id", "name").agg(F.count("*").alias("c"), F.min("path").alias("dst")).where("c = 1").drop("c")
    return references.join(unique, ["repo_id", "name"]).where("path <> dst").select("repo_id", F.col("path").alias("src"), "dst", "n")
