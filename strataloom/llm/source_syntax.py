"""Source files that do not parse.

Packrat grammars decide whether the whole content of a file follows the syntax of its
extension's language; a file that a grammar refuses is reported with the furthest place where
no token fitted and a likely cause. The grammars alone decide; no parser of the executors' own
Python is asked.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.grammars import LexError, data_formats, java17, python313
from strataloom.llm.peg import Grammar
from strataloom.session import spread

# Language of each extension.
LANGUAGES = {"py": "python", "java": "java", "json": "json", "toml": "toml"}
_CONFLICT = re.compile(r"(?m)^(?:<{7}(?: .*)?|\|{7}(?: .*)?|={7}|>{7}(?: .*)?)\r?$")
_STATEMENT = re.compile(r"(?m)^[ \t]*(?:(?:async|def|class|import|from|if|for|while|try|with|return)\b|@?\w+[ \t]*[=(])")
#: Frames of the parsers, which lie on the heap: some 100,000 nested brackets. What is nested deeper isn't decided but reported.
MOST_FRAMES = 1_000_000


@functools.lru_cache(maxsize=None)
def _parser(language: str) -> tuple[Callable, Callable, Callable | None]:
    lexer, grammar = {
        "python": (python313.lex, python313.GRAMMAR), "java": (java17.lex, java17.GRAMMAR),
        "json": (data_formats.lex_json, data_formats.JSON_GRAMMAR), "toml": (data_formats.lex_toml, data_formats.TOML_GRAMMAR),
    }[language]
    field = Grammar(grammar, "fstring_part").compile() if language == "python" else None
    return lexer, Grammar(grammar, "file").compile(), field


def _refusal(language: str, text: str) -> tuple[int, str] | None:
    """Offset of the furthest failure of the grammar and `syntax`, or `too_deep`; None if it takes the whole text."""
    if sys.getrecursionlimit() < MOST_FRAMES:
        sys.setrecursionlimit(MOST_FRAMES)
    lexer, run, field = _parser(language)
    try:
        symbols, offsets, fields = lexer(text)
        fits, far = run(symbols)
        if not fits:
            return offsets[far] if far < len(offsets) else len(text), "syntax"
        for begin, end in fields:
            inner, at, _ = lexer(f"({text[begin:end]}\n)")
            close = inner.index("NEWLINE") - 1 if "NEWLINE" in inner else len(inner) - 1
            fits, far = field(inner[1:close])
            if not fits:
                return begin + at[far + 1] - 1, "syntax"  # the bracket before the source counts as one
        if language == "toml" and (at := data_formats.defined_twice(text, symbols, offsets)) is not None:
            return at, "syntax"
    except LexError as e:
        return min(e.at, len(text)), "syntax"
    except RecursionError:
        return len(text), "too_deep"
    return None


def _other_language(language: str, text: str) -> bool:
    """Whether the text as a whole is of another of the languages; a blank one is of none, literals alone are no Python and headers alone no TOML."""
    others = [x for x in LANGUAGES.values() if x != language and (x != "python" or _STATEMENT.search(text)) and (x != "toml" or "=" in text)]
    return bool(text.strip()) and any(_refusal(x, text) is None for x in others)


def check(language: str, text: str) -> tuple[int, int, str] | None:
    """Line and column (1-based) of the furthest failure, and its cause; None for a valid text.

    Cause is merge_conflict, wrong_extension (the text is valid in another of the languages),
    truncated (it ends where more was due), too_deep (nested beyond what the parser takes, so not
    known to be valid) or syntax.
    """
    found = _refusal(language, text)
    if found is None:
        return None
    at, cause = found
    line = text.count("\n", 0, at) + 1
    column = at - (text.rfind("\n", 0, at) + 1) + 1
    if cause == "syntax":
        if _CONFLICT.search(text):
            cause = "merge_conflict"
        elif _other_language(language, text):
            cause = "wrong_extension"
        elif at >= len(text.rstrip()):
            cause = "truncated"
    return line, column, cause


def _language() -> Column:
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), extension)


def invalid_files(files: DataFrame, key: str = "file_id") -> DataFrame:
    """`key`, repo_id, language, line, col and cause of the files that don't follow their language.

    The extension (whatever its case) decides on the language; others, null paths and null contents
    are no cases. An empty file is valid unless its language is JSON. Repeated rows come out once,
    rows without key not at all. An empty table gives an empty result and further columns are
    ignored.
    """
    cases = files.where(F.col(key).isNotNull() & F.col("content").isNotNull()).select(F.col(key).alias("key"), "repo_id", _language().alias("language"), "content").where("language is not null")
    cases = spread(cases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "repo_id", "language", "content")]
            rows = [(k, r, x, *found) for k, r, x, t in zip(*columns) if (found := check(x, t))]
            if rows:
                types = [batch.schema.field("key").type, batch.schema.field("repo_id").type, pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["key", "repo_id", "language", "line", "col", "cause"])

    kind, repo = cases.schema["key"].dataType.simpleString(), cases.schema["repo_id"].dataType.simpleString()
    return cases.mapInArrow(run, f"key {kind}, repo_id {repo}, language string, line bigint, col bigint, cause string").distinct().withColumnRenamed("key", key)


def invalid_rates(files: DataFrame, found: DataFrame, key: str = "file_id") -> DataFrame:
    """repo_id, language, n_files, n_invalid and rate of the files with content."""
    every = files.where(F.col(key).isNotNull() & F.col("content").isNotNull()).select(key, "repo_id", _language().alias("language")).where("language is not null").distinct()
    bad = found.select(key, F.lit(1).alias("bad")).distinct()
    return (
        every.join(bad, key, "left").groupBy("repo_id", "language")
        .agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid")).withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
