"""From source files to chunks: symbols with their lines of code, their numbers and ids.

The members of one file are found inside Arrow batches, Python's by its own parser (by indentation
where that refuses the file), Java's by brackets. Every chunk is a row; numbering, ids and imports
are Spark's work.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.incremental import newest_contents
from strataloom.operators.parsing import tree_of

_DEFINED = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")
_JAVA = re.compile(r'(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>""".*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)|(?P<word>\w+)|(?P<sign>[^\s\w])', re.S)
# Words that begin the declaration of a type.
TYPE_WORDS = ("class", "interface", "enum", "record")


def python_members(source: str) -> list[tuple]:
    """(symbol, kind, start_line, end_line, parent) of classes, methods and functions in source order; a name holds that of what encloses it directly, its parent."""
    tree, out = tree_of(source), []
    if tree is None:
        return _by_indentation(source)

    def visit(node: ast.AST, parent: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{parent}.{child.name}" if parent else child.name
                is_class = isinstance(child, ast.ClassDef)
                out.append((name, "class" if is_class else "method" if in_class else "function", child.lineno, child.end_lineno, parent))
                visit(child, child.name, is_class)
            else:
                visit(child, parent, in_class and not isinstance(child, ast.stmt))

    visit(tree, None, False)
    return out


def _by_indentation(source: str) -> list[tuple]:
    """Members of a file that doesn't parse: a definition reaches to the last line that is indented more."""
    lines, out, stack = source.split("\n"), [], []  # stack: (indent, name, is_class, index in out)
    last = 0
    for number, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while stack and indent <= stack[-1][0]:
            _, _, _, at = stack.pop()
            out[at] = (*out[at][:3], last, out[at][4])
        if m := _DEFINED.match(line):
            parent = stack[-1] if stack else None
            name = f"{parent[1]}.{m[3]}" if parent else m[3]
            kind = "class" if m[2] == "class" else "method" if parent and parent[2] else "function"
            out.append((name, kind, number, number, parent[1] if parent else None))
            stack.append((indent, m[3], kind == "class", len(out) - 1))
        last = number
    for _, _, _, at in stack:
        out[at] = (*out[at][:3], last, out[at][4])
    return out


def _declared(header: list[str], owner: str | None) -> tuple[str, str] | None:
    """(kind, name) of the declaration that a header begins; kind is class, annotation or method."""
    plain, i = [], 0
    while i < len(header):
        if header[i] == "@" and header[i + 1 : i + 2] == ["interface"]:
            return "annotation", (header[i + 2 : i + 3] or [""])[0]
        if header[i] == "@":
            i += 2
            while header[i : i + 1] == ["."]:
                i += 2
            if header[i : i + 1] == ["("]:
                depth = 0
                while i < len(header):
                    depth += (header[i] == "(") - (header[i] == ")")
                    i += 1
                    if depth == 0:
                        break
            continue
        plain.append(header[i])
        i += 1
    for k, word in enumerate(plain):
        following = plain[k + 1] if k + 1 < len(plain) else ""
        if word in TYPE_WORDS and re.match(r"[^\W\d]", following) and (word != "record" or plain[k + 2 : k + 3] in (["("], ["<"])):
            return "class", following
        if word == "=":
            return None
        if following == "(" and re.match(r"[^\W\d]", word):
            return "method", word
    return ("method", plain[-1]) if plain and owner and plain[-1] == owner else None


def java_members(source: str) -> list[tuple]:
    """(symbol, kind, start_line, end_line, parent) of types, methods and constructors of a Java file in source order.

    A Javadoc that ends on the line above a declaration belongs to it. Interfaces, enums and
    records are classes. What lies inside method bodies isn't looked at.
    """
    line_at = [0, *(m.end() for m in re.finditer("\n", source))]
    out: list[list] = []
    # Of each open brace: whether it is the body of a type, the type's name, the member that it ends, whether enum constants still come.
    scopes: list[tuple[bool, str | None, int | None]] = [(True, None, None)]
    constants = [False]
    header: list[str] = []
    start = doc = None  # first token of the header, and the Javadoc before it
    parens, line = 0, 0

    def line_of(offset: int) -> int:
        nonlocal line
        while line < len(line_at) and line_at[line] <= offset:
            line += 1
        return line

    def add(kind: str, name: str) -> int:
        parent = next((n for is_type, n, _ in reversed(scopes) if is_type and n), None)
        begin = doc[0] if doc and doc[1] == start - 1 else start
        out.append([f"{parent}.{name}" if parent else name, kind, begin, None, parent])
        return len(out) - 1

    for m in _JAVA.finditer(source):
        kind, text = m.lastgroup, m[0]
        in_type = scopes[-1][0]
        if kind == "comment":
            if in_type and not header and text.startswith("/**") and text != "/**/":
                doc = (line_of(m.start()), line_of(max(m.start(), m.end() - 1)))
            continue
        at = line_of(m.start())
        if not in_type:
            if text == "{":
                scopes.append((False, None, None))
            elif text == "}" and len(scopes) > 1:
                _, _, member = scopes.pop()
                constants.pop()
                if member is not None:
                    out[member][3] = at
                if scopes[-1][0] and "=" not in header:
                    header, start, doc = [], None, None
                continue
            if text == "{":
                constants.append(False)
            continue
        if text in "([":
            parens += 1
        elif text in ")]":
            parens = max(0, parens - 1)
        if text == "{" and parens == 0:
            found = None if constants[-1] else _declared(header, scopes[-1][1])
            if found and found[0] in ("class", "annotation"):
                member = add("class", found[1]) if found[0] == "class" else None
                scopes.append((True, found[1] if member is not None else None, member))
                constants.append("enum" in header)
                header, start, doc = [], None, None
            else:
                scopes.append((False, None, add("method", found[1]) if found and scopes[-1][1] else None))
                constants.append(False)
            continue
        if text == "}" and parens == 0:
            if len(scopes) > 1:
                _, _, member = scopes.pop()
                constants.pop()
                if member is not None:
                    out[member][3] = at
            header, start, doc = [], None, None
            continue
        if text == ";" and parens == 0:
            found = None if constants[-1] or not header else _declared(header, None)
            if found and found[0] == "method" and scopes[-1][1]:
                out[add("method", found[1])][3] = at
            constants[-1] = False
            header, start, doc = [], None, None
            continue
        if not header:
            start = at
        header.append(text)
    last = len(line_at)
    return [(s, k, a, b if b is not None else last, p) for s, k, a, b, p in out]


def clean_javadoc(raw: str) -> str | None:
    """The body of a Javadoc comment without its marks; tags stay. None for an empty one."""
    lines = []
    for line in raw.removeprefix("/**").removesuffix("*/").splitlines():
        line = line.strip()
        lines.append((line[1:].removeprefix(" ") if line.startswith("*") else line).rstrip())
    return "\n".join(lines).strip() or None


def java_file_doc(source: str) -> str | None:
    """The Javadoc right before the first type of a file: what describes the file. Null without one, whatever later types have."""
    doc, header, parens = None, [], 0
    for m in _JAVA.finditer(source):
        kind, text = m.lastgroup, m[0]
        parens += (text == "(") - (text == ")")
        if kind == "comment":
            doc = text if not header else doc
        elif text == ";" and not parens:
            doc, header = None, []
        elif text == "{" and not parens:
            found = _declared(header, None)
            return clean_javadoc(doc) if found and doc and doc.startswith("/**") else None
        else:
            header.append(text)
    return None


def _rows(files: DataFrame, extract, columns: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """Rows of `extract` for path and content of each Python and Java file (its newest content)."""
    wide = 4 * files.sparkSession.sparkContext.defaultParallelism
    rows = newest_contents(files.where(F.col("path").rlike(r"\.(?:py|java)$")).repartition(wide, "repo_id", "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, p, *row) for r, p, c in zip(*(batch.column(x).to_pylist() for x in ("repo_id", "path", "content"))) for row in extract(p, c)]
            if found:
                types = [batch.schema.field("repo_id").type, pa.string(), *columns.values()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], names=["repo_id", "path", *columns])

    return rows.mapInArrow(run, f"repo_id {rows.schema['repo_id'].dataType.simpleString()}, path string, {ddl}")


def _members(path: str, content: str) -> list[tuple]:
    lines = content.replace("\r\n", "\n").split("\n")
    found = (java_members if path.endswith(".java") else python_members)(content.replace("\r\n", "\n"))
    size = len(lines) - (lines[-1] == "" and len(lines) > 1)
    whole = (path, "file", 1, size, None, -1, "\n".join(lines[:size]))
    return [whole] + [(s, k, a, b, p, i, "\n".join(lines[a - 1 : b])) for i, (s, k, a, b, p) in enumerate(found)]


def index_chunks(files: DataFrame) -> DataFrame:
    """repo_id, file, symbol, kind, start_line, end_line, parent, code and id of every chunk of the collected files.

    One chunk is the whole file; the others are its classes, methods and functions, whose names get
    # and a number from the second of the same name on. A file that its parser refuses gives what
    its indentation or brackets tell. Null contents and other languages give no chunk; an empty
    table gives an empty result.
    """
    types = {"symbol": pa.string(), "kind": pa.string(), "start_line": pa.int64(), "end_line": pa.int64(), "parent": pa.string(), "ord": pa.int64(), "code": pa.string()}
    found = _rows(files, _numbered, types, "symbol string, kind string, start_line bigint, end_line bigint, parent string, ord bigint, code string")
    return found.withColumnRenamed("path", "file").withColumn("id", F.concat_ws("::", "file", "symbol")).drop("ord")


def _numbered(path: str, content: str) -> list[tuple]:
    """Members of one file, the later ones of equal name numbered."""
    seen: dict[str, int] = {}
    out = []
    for symbol, *rest in _members(path, content):
        seen[symbol] = seen.get(symbol, 0) + 1
        out.append((symbol if seen[symbol] == 1 else f"{symbol}#{seen[symbol]}", *rest))
    return out


def file_docs(files: DataFrame) -> DataFrame:
    """repo_id, path, doc: what describes each file: Python's module docstring as it stands in the source, stripped, or the Javadoc of Java's first type."""

    def doc(path: str, content: str) -> list[tuple]:
        if path.endswith(".java"):
            found = java_file_doc(content)
        else:
            tree = tree_of(content)
            first = tree.body[0] if tree is not None and tree.body else None
            plain = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
            raw = ast.get_source_segment(content, first.value) if plain else None
            body = re.sub(r"^[rRuU]?(\"\"\"|'''|\"|')(.*)\1$", r"\2", raw, flags=re.S) if raw else ""
            found = body.strip() or None
        return [(found,)] if found else []

    return _rows(files, doc, {"doc": pa.string()}, "doc string")
