"""Functions paired with their documentation.

Each chunk is lexed for functions and for candidate comments (string statements, blocks of
comments, Javadoc). A bipartite assignment links them at the least total cost, where the cost
counts the statements between them, the side on which the language documents, the kind of
comment, the indentation, other functions in between, parameter tags that the function lacks
and names that both share. A function may stay without a link at the cost `MOST_COST`, so less
plausible links are never made. Descriptions that say no more than the symbol and its parameters
are rejected. Whether the language itself takes the linked comment as the function's
documentation is told in a column of its own.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import spread

#: Words beyond the names of the function that a description needs.
LEAST_WORDS = 2
#: Cost of having no link, above which every link is implausible.
MOST_COST = 2.25
#: Costs of one statement in between, of a comment instead of a documentation string, of the less usual side, of a side where the language has no documentation, of each other function in between.
A_STATEMENT, A_COMMENT, OTHER_SIDE, NEVER_THERE, A_FUNCTION = 1.5, 1.0, 1.0, 3.0, 1.0

# Words that say nothing about what a function does.
FILLERS = set(
    """a an the this that these those it its is are was be been being of for to in on at by with from and or not as if into method function func procedure routine constructor class
    object instance member helper utility will shall should can may does do did done simply just here now used uses use using call calls called given new return returns returned
    returning get gets getter set sets setter value values result results param params parameter parameters arg args argument arguments type types str string int integer bool boolean float
    list dict map tuple optional none null void true false any self cls def var default defaults some something thing things stuff etc which what when e g i e implementation implements
    die der das ein eine funktion methode la el los una un función método le les une fonction méthode 함수 메서드 메소드 이 그 저 는 은""".split()
)
# Words of notes that a description is missing, generated or inherited.
PLACEHOLDERS = set(
    """todo fixme tbd tba xxx wip hack summary description descriptions desc docstring docstrings doc docs document documents documented documentation documenting javadoc comment comments
    placeholder goes write written writeme me add added missing later fill filled pending coming soon empty blank stub auto autogenerated generated automatically generator inherit inherited
    inherits inheritdoc see super superclass parent base overridden override overrides non no lorem ipsum dolor insert text explain explanation describe your
    설명 추가 예정 작성 필요 나중에 미작성 문서 문서화 자동 생성 생성됨 상속 beschreibung folgt fehlt dokumentation ergänzen descripción pendiente documentar à compléter compléter documenter venir""".split()
)

_PY = re.compile(
    r"""(?P<string>[rRbBuUfF]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))|(?P<comment>\#[^\n]*)|(?P<join>\\\r?\n)|(?P<line>\r?\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[^\s"'#()\[\]{};\\,:]+)|(?P<sign>[,:;\\])""",
    re.S,
)
_JAVA = re.compile(r'(?P<doc>/\*\*(?!/).*?\*/)|(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<string>""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<word>\w+)|(?P<sign>[^\s\w])', re.S)
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


@dataclass
class Function:
    name: str
    params: list[str]
    order: int  # place among all statements
    indent: int


@dataclass
class Candidate:
    text: str
    order: int  # place among all statements; a comment has that of the statement after it
    indent: int
    kind: str  # docstring, javadoc or comment
    owner: int = -1  # index of the function whose documentation the language takes it for
    tags: set[str] = field(default_factory=set)
    end: int = -1  # of a comment, where it ends in the code


def words_of(name: str) -> list[str]:
    """Lower-case words of an identifier or a text."""
    return [w.lower() for w in _NAME_PARTS.findall(name)]


def _literal(raw: str) -> str:
    try:
        return ast.literal_eval(raw)
    except (ValueError, SyntaxError):
        return raw.strip("rRuU").strip("'\"")


def scan_python(code: str) -> tuple[list[Function], list[Candidate]]:
    """Functions and candidate comments of Python code, in source order."""
    functions, candidates = [], []
    tokens = [(m.lastgroup, m[0], m.start()) for m in _PY.finditer(code)]
    i, order, depth, fresh, waiting = 0, 0, 0, True, None  # waiting: the function whose body comes next
    line_start = 0
    while i < len(tokens):
        kind, text, at = tokens[i]
        if kind == "line":
            if depth == 0:
                fresh, line_start = True, at + len(text)
            i += 1
        elif kind == "comment":
            last, line = candidates[-1] if candidates else None, text.lstrip("#").strip()
            if last and last.end >= 0 and last.order == order and not code[last.end : at].strip() and code.count("\n", last.end, at) == 1:
                last.text, last.end = f"{last.text}\n{line}", at + len(text)  # the next line of a block
            else:
                candidates.append(Candidate(line, order, at - line_start, "comment", end=at + len(text)))
            i += 1
        elif kind == "join":
            i += 1
        elif fresh and (kind == "string" or text == "("):
            # A statement of nothing but strings, which may be joined and stand in brackets.
            parts, j, level = [], i, 0
            while j < len(tokens) and (tokens[j][0] in ("string", "join") or tokens[j][1] in "()" or (level and tokens[j][0] in ("line", "comment"))):
                if tokens[j][1] == ")" and level == 0:
                    break
                level += (tokens[j][1] == "(") - (tokens[j][1] == ")")
                parts += [tokens[j][1]] if tokens[j][0] == "string" else []
                j += 1
            if not parts or level:
                order, waiting, fresh = order + 1, None, False
                continue  # an ordinary statement
            alone = j == len(tokens) or tokens[j][0] in ("line", "comment") or tokens[j][1] == ";"
            plain = not any(set(re.match(r"\w*", p)[0].lower()) & set("bf") for p in parts)
            if alone and plain:
                candidates.append(Candidate("".join(map(_literal, parts)), order, at - line_start, "docstring", -1 if waiting is None else waiting))
            order, waiting, fresh, i = order + 1, None, False, j
        elif fresh and kind == "word" and text in ("def", "async"):
            j = i + (2 if text == "async" else 1)
            name = tokens[j][1] if j < len(tokens) else ""
            name = name.partition("[")[0]
            params, level, j, expect, listed = [], 0, j + 1, True, False
            while j < len(tokens):
                k, t, _ = tokens[j]
                if k == "open":
                    level += 1
                elif k == "close":
                    level -= 1
                    listed |= level == 0
                elif level == 0 and t == ":":
                    break
                elif level == 0 and k == "line":
                    break
                elif level == 1 and t == ",":
                    expect = True
                elif level == 1 and k == "word" and expect and not listed:
                    params.append(t.strip("*").partition("=")[0])
                    expect = False
                j += 1
            functions.append(Function(name, [p for p in params if p not in ("self", "cls")], order, at - line_start))
            waiting, order, i, fresh = len(functions) - 1, order + 1, j + 1, True  # the body may begin on the same line
        else:
            if fresh:
                order, waiting, fresh = order + 1, None, False
            if kind == "open":
                depth += 1
            elif kind == "close":
                depth = max(0, depth - 1)
            elif text == ";" and depth == 0:
                fresh = True
            i += 1
    return functions, candidates


def scan_java(code: str) -> tuple[list[Function], list[Candidate]]:
    """The method of a Java chunk and the candidate comments before and in its header; a chunk holds one member."""
    candidates, first = [], True
    name, params, level, header = "", [], 0, []
    for m in _JAVA.finditer(code):
        kind, text = m.lastgroup, m[0]
        if kind in ("doc", "comment"):
            body = re.sub(r"(?m)^[ \t]*\*+[ \t]?", "", re.sub(r"^/\*+|\*+/$|^//", "", text))
            candidates.append(Candidate(body, len(candidates) if first else -1, 0, "javadoc" if kind == "doc" else "comment", 0 if kind == "doc" and first else -1))
        elif not name:
            first = False
            if text == "(" and header and header[-1][1] == "word" and not any(t == "@" for t, _ in header[-2:-1]):
                name, level = header[-1][0], 1
            header.append((text, kind))
        else:
            level += (kind == "open") - (kind == "close")
            header.append((text, kind))
            if (text == "," and level == 1) or level == 0:
                words = [t for t, k in header[:-1] if k == "word"]
                params += words[-1:]
            if level == 0:
                break
    before = sum(c.order >= 0 for c in candidates)
    for c in candidates:
        c.order = before + 1 if c.order < 0 else c.order + 1
    return [Function(name, params, before, 0)], candidates


def tags_of(text: str) -> set[str]:
    """Names of the parameters that a comment documents."""
    found = set(re.findall(r"@param\s+(\w+)|:param\s+(?:[\w\[\].]+\s+)?(\w+)\s*:", text))
    names = {x for pair in found for x in pair if x}
    if section := re.search(r"(?s)\b(?:Args|Arguments|Parameters)\s*:?\s*\n(.*?)(?:\n\s*\n|\n\s*(?:Returns|Raises|Yields)\b|$)", text):
        names |= set(re.findall(r"(?m)^\s*\*{0,2}(\w+)\s*(?:\([^)\n]*\))?\s*:", section[1]))
    return names


def link_cost(functions: list[Function], index: int, candidate: Candidate, language: str) -> float:
    """How far a candidate comment is from documenting a function."""
    function = functions[index]
    after = candidate.order > function.order
    gap = candidate.order - function.order - 1 if after else function.order - candidate.order
    cost = A_STATEMENT * gap
    cost += A_COMMENT if candidate.kind == "comment" else 0.0
    if after != (language == "python"):
        cost += OTHER_SIDE if candidate.kind == "comment" and language == "python" else NEVER_THERE
    if after and candidate.indent <= function.indent and language == "python":
        cost += OTHER_SIDE  # not inside the function
    if gap:
        low, high = sorted((candidate.order, function.order))
        cost += A_FUNCTION * sum(low < f.order < high for f in functions[max(0, index - gap) : index + gap + 1])
    if candidate.tags:
        cost += 2.0 * len(candidate.tags - set(function.params)) / len(candidate.tags) - 0.5 * bool(candidate.tags & set(function.params))
    names = set(words_of(function.name))
    return cost - 0.5 * bool(names) * (len(names & set(words_of(candidate.text))) >= max(1, len(names) - 1))


def plausible_links(functions: list[Function], candidates: list[Candidate], language: str) -> dict[tuple[int, int], float]:
    """Costs of the links of function and candidate below `MOST_COST`; only near ones are looked at, as every statement between costs."""
    reach, links = int((MOST_COST + 1.0) / A_STATEMENT) + 1, {}
    orders = [c.order for c in candidates]
    for i, f in enumerate(functions):
        for j in range(bisect_left(orders, f.order - reach), bisect_right(orders, f.order + 1 + reach)):
            if (cost := link_cost(functions, i, candidates[j], language)) < MOST_COST:
                links[i, j] = cost
    return links


def matched(links: dict[tuple[int, int], float]) -> dict[int, int]:
    """Candidate of each linked function in the assignment of least total cost, found by connected component."""
    part: dict[tuple[str, int], tuple[str, int]] = {}

    def root(x: tuple[str, int]) -> tuple[str, int]:
        while part.setdefault(x, x) != x:
            part[x] = x = part[part[x]]
        return x

    for i, j in links:
        part[root(("f", i))] = root(("c", j))
    groups: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for i, j in links:
        groups.setdefault(root(("f", i)), []).append((i, j))
    chosen = {}
    for pairs in groups.values():
        rows, columns = sorted({i for i, _ in pairs}), sorted({j for _, j in pairs})
        far = 1e6  # each function also has a column of its own, for no link
        costs = [[links.get((i, j), far) for j in columns] + [MOST_COST if i == k else far for k in rows] for i in rows]
        chosen |= {i: columns[at] for i, at in zip(rows, assign(costs)) if at < len(columns)}
    return chosen


def assign(costs: list[list[float]]) -> list[int]:
    """Column of each row (or -1) in a least-cost assignment (shortest augmenting paths)."""
    n, m = len(costs), len(costs[0]) if costs else 0
    if n > m:
        back = assign([list(c) for c in zip(*costs)]) if m else []
        out = [-1] * n
        for column, row in enumerate(back):
            out[row] = column
        return out
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        least, seen, way, row_of[0], j = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1), i, 0
        while True:
            seen[j], r, step, nxt = True, row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not seen[k]:
                    c = costs[r - 1][k - 1] - u[r] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < step:
                        step, nxt = least[k], k
            for k in range(m + 1):
                if seen[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = nxt
            if row_of[j] == 0:
                break
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = [-1] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


def prose(text: str) -> str:
    """A description without tags, parameter names, types, headings and markup."""
    text = re.sub(r"(?s)<pre>.*?</pre>|```.*?```", " ", text)
    text = re.sub(r"<[^>]{0,100}>", " ", text)
    text = re.sub(r"(?m)^\s*(?:@(?:see|since|author|version|category|deprecated|hidden)\b.*|:(?:rtype|type)[^:\n]*:.*|>>>.*|\.\. .*)$", " ", text)
    text = re.sub(r"@param\s+(?:<\w+>|\w+)|@(?:throws|exception|raises)\s+[\w.]+|@returns?\b|\{@\w+\s*[^}]*\}|@\w+", " ", text)
    text = re.sub(r":(?:param|parameter|arg|argument|key|raises?|raise|except)[^:\n]*:|:(?:returns?|yields?)\s*:|:\w+:", " ", text)
    text = re.sub(r"(?mi)^\s*(?:args|arguments|parameters|params|returns?|raises|yields|notes?|examples?|attributes|see also)\s*:?\s*$", " ", text)
    text = re.sub(r"(?m)^\s*\*{0,2}\w+\s*\([^)\n]*\)\s*:|^\s*\w+\s*:\s*[\w\[\], .|]+$|^\s*\w+\s*:(?=\s|$)", " ", text)
    return text


def informative_words(text: str, symbol: str, params: list[str]) -> int:
    """Different words of the prose that neither the names nor the lists of empty words have."""
    own = {w for name in [symbol, *params] for w in words_of(name)}
    own |= {w + s for w in own for s in ("s", "es", "ed", "d", "ing", "er")} | {w[:-1] + "ing" for w in own} | {w[:-1] + "ies" for w in own} | {w.rstrip("s") for w in own}
    found = set(words_of(prose(text)))
    return len({w for w in found if len(w) > 1 or ord(w[0]) > 0x2E7F} - own - FILLERS - PLACEHOLDERS)


_HEADER = re.compile(r"\s*(?:@[\w.]+[ \t]*\r?\n\s*)*(?:async\s+)?def\s+\w+\s*\(")
_PLAIN_END = re.compile(r"(?:[^:#\"'()\[\]{}\\]|\[[^#\"'()\[\]{}\\]*\])*:(?:\s|\\\r?\n|#[^\n]*(?:\n|$))*")
_STRING_OR_BRACKET = re.compile(r"[rRuU]{0,2}[\"']|\(")


def may_have_docstring(code: str) -> bool:
    """False only where the first function's body can't begin with a string; spares the lexer.

    Where the header isn't plain (decorators with arguments, type parameters, quotes, nested or
    round brackets in the return annotation), the lexer decides.
    """
    header = _HEADER.match(code)
    if not header:
        return True
    depth, i = 0, header.end() - 1
    while i < len(code):
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                body = _PLAIN_END.match(code, i + 1)
                return body is None or _STRING_OR_BRACKET.match(code, body.end()) is not None
        elif c in "\"'#":
            return True
        i += 1
    return True


def documentation(language: str, code: str, symbol: str) -> tuple[str, str, bool, float] | None:
    """Description of a chunk's own function, its kind, whether the language takes it, and the cost of the link; None without an informative one."""
    if language != "java" and "#" not in code and not may_have_docstring(code):
        return None
    functions, candidates = (scan_java if language == "java" else scan_python)(code)
    if not functions or not candidates:
        return None
    for c in candidates:
        c.tags = tags_of(c.text)
    links = plausible_links(functions, candidates, language)
    at = matched(links).get(0)
    if at is None or informative_words(candidates[at].text, symbol, functions[0].params) < LEAST_WORDS:
        return None
    return candidates[at].text.strip(), candidates[at].kind, candidates[at].owner == 0, links[0, at]


def function_pairs(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """`key`, symbol, code, description, source and is_official of the chunks of kind method or function with documentation of their own.

    source is docstring, javadoc or comment; is_official tells whether the language itself takes
    the text as the documentation of that function.

    A null or empty code, symbol or file gives no pair; files that don't end in .java are read as
    Python. Equal rows are one; rows with a null key are left out. An empty table gives an empty
    result and further columns are ignored.
    """
    kind = chunks.schema[key].dataType.simpleString()
    marked = F.when(F.lower("file").endswith(".java"), F.col("code").rlike("/[*/]")).otherwise(F.col("code").rlike("['\"#]"))
    rows = chunks.where(F.col("kind").isin("method", "function") & F.col(key).isNotNull() & F.col("symbol").isNotNull() & marked)
    rows = rows.select(F.col(key).alias("__key"), "symbol", "code", F.when(F.lower("file").endswith(".java"), "java").otherwise("python").alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("__key", "symbol", "code", "language")]
            found = [(k, s, c, *d[:3]) for k, s, c, x in zip(*columns) if (d := documentation(x, c, s))]
            if found:
                types = [batch.schema.field("__key").type, pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], names=["__key", "symbol", "code", "description", "source", "is_official"])

    pairs = spread(rows).mapInArrow(run, f"__key {kind}, symbol string, code string, description string, source string, is_official boolean")
    return pairs.withColumnRenamed("__key", key)
