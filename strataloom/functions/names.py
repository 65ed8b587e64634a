"""Names, paths and identifiers as column expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dotted names of the standard library, by their first segment.
STDLIB = frozenset(sys.stdlib_module_names)
# Names of common methods of the language that never resolve to a definition of the repository.
BUILTINS = [
    "add", "append", "extend", "insert", "remove", "pop", "clear", "get", "keys", "values", "items", "update", "setdefault", "copy", "sort", "reverse", "count", "index",
    "join", "split", "splitlines", "strip", "lstrip", "rstrip", "replace", "format", "startswith", "endswith", "lower", "upper", "encode", "decode", "find",
    "read", "write", "close", "open", "read_text", "write_text", "read_bytes", "exists", "resolve", "expanduser", "mkdir", "glob", "is_file", "is_dir", "unlink", "relative_to",
    "run", "main", "start", "stop", "send", "next", "group", "match", "search", "commit", "execute", "fetchall", "fetchone", "connect",
]


def dotted_suffixes(name: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]; longest first. Null for a null name."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts) - i), "."))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for none, as for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"[^.](\.[^./]+)$", 1))


def module_name(path: Column) -> Column:
    """Dotted name of a Python or Java path; a package of Python is named by its folder."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.(?:py|java)$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def is_test_path(path: Column) -> Column:
    """A folder test or tests, or a file whose name without its extension begins with test_ or ends with _test, Test or Tests."""
    return path.rlike(r"(?:^|/)tests?/|(?:^|/)test_[^/]*$|(?:_test|Tests?)(?:\.[^./]*)?$")


def identifiers(text: Column) -> Column:
    """Names of at least two characters with an underscore or mixed case, in order of first use."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & (F.contains(t, F.lit("_")) | (t.rlike("[a-z]") & t.rlike("[A-Z]"))))


def import_target(name: Column, file: Column) -> Column:
    """What an import of a file names: in Java the name up to its first class, else the whole name."""
    target = F.regexp_extract(name, r"^((?:(?!\p{Lu})[^.]*\.)*\p{Lu}[^.]*)", 1)
    return F.when(file.endswith(".java") & (target != ""), target).otherwise(F.regexp_replace(name, r"\.\*$", ""))


def java_dependency(name: Column) -> Column:
    """Up to two lower-case segments before the first capitalised one; null for java. and javax."""
    lower = F.regexp_extract(name, r"^([a-z_]\w*(?:\.[a-z_]\w*)?)", 1)
    return F.when(~name.rlike(r"^javax?\."), F.nullif(lower, F.lit("")))


def clamp_score(text: Column, quoted: Column | None = None) -> Column:
    """0, 1 or 2 of a JSON value's text: numbers lose their fraction, true is 1, anything else 0; of a quoted one only a whole number counts."""
    number = F.when(F.lower(text) == "true", F.lit(1)).otherwise(F.coalesce(text.try_cast("double").cast("int"), F.lit(0)))
    if quoted is not None:
        number = F.when(quoted, F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int")), F.lit(0))).otherwise(number)
    return F.least(F.lit(2), F.greatest(F.lit(0), number))
