"""JSON (RFC 8259) and TOML 1.0: tokens and grammars."""

from __future__ import annotations

import re

from strataloom.llm.grammars import LexError

JSON_GRAMMAR = r"""
file <- value
value <- '{' (pair (',' pair)*)? '}' / '[' (value (',' value)*)? ']' / STRING / NUMBER / WORD
pair <- STRING ':' value
"""

_JSON = re.compile(r"""(?P<space>[ \t\r\n]+)|(?P<string>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z_.]))|(?P<word>(?:true|false|null)(?![0-9A-Za-z_]))|(?P<op>[{}\[\],:])""")


def lex_json(text: str) -> tuple[list[str], list[int], list[str]]:
    symbols, offsets, i = [], [], 0
    while i < len(text):
        m = _JSON.match(text, i)
        if m is None:
            raise LexError(i)
        if m.lastgroup != "space":
            symbols.append(m[0] if m.lastgroup == "op" else m.lastgroup.upper())
            offsets.append(i)
        i = m.end()
    return symbols, offsets, []


TOML_GRAMMAR = r"""
file <- NEWLINE* (line (NEWLINE+ line)*)? NEWLINE*
line <- '[[' key ']]' / '[' key ']' / key '=' value
key <- part ('.' part)*
part <- BARE / STRING
value <- STRING / MULTI / SCALAR / array / table
array <- '[' (value (',' value)* ','?)? ']'
table <- '{' (key '=' value (',' key '=' value)*)? '}'
"""

_BASIC = r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:["\\bfnrt]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"'
_LITERAL = r"'[^'\x00-\x08\x0a-\x1f\x7f]*'"
_MULTI = r'"""(?:\r?\n)?(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\(?:["\\bfnrt]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n[ \t\r\n]*)|"{1,2}(?!"))*"{3,5}'
_MULTI_LITERAL = r"'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'{1,2}(?!'))*'{3,5}"
_DATE, _TIME = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])", r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?"
_SCALAR = rf"{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_TIME}|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|true|false"
_SPACE = re.compile(r"[ \t]+|#[^\x00-\x08\x0a-\x1f\x7f]*")
_NEWLINE = re.compile(r"\r?\n")
_TOML_KEY = re.compile(rf"(?P<STRING>{_BASIC}|{_LITERAL})|(?P<BARE>[A-Za-z0-9_-]+)|(?P<op>\[\[|\]\]|[\[\].=}}])")
_TOML_VALUE = re.compile(rf"(?P<MULTI>{_MULTI}|{_MULTI_LITERAL})|(?P<STRING>{_BASIC}|{_LITERAL})|(?P<SCALAR>(?:{_SCALAR})(?![A-Za-z0-9_:.+-]))|(?P<op>[\[\]{{}}])")


def lex_toml(text: str) -> tuple[list[str], list[int], list[str]]:
    symbols, offsets, i, stack, state = [], [], 0, [], "key"  # states: key, value, after
    while i < len(text):
        if m := _SPACE.match(text, i):
            if m[0][0] == "#" and stack and stack[-1] == "{":
                raise LexError(i)
            i = m.end()
            continue
        if m := _NEWLINE.match(text, i):
            if not stack:
                symbols.append("NEWLINE")
                offsets.append(i)
                state = "key"
            elif stack[-1] == "{":
                raise LexError(i)
            i = m.end()
            continue
        if state == "after":
            if stack and text[i] == ",":
                symbol, end, state = ",", i + 1, "value" if stack[-1] == "[" else "key"
            elif stack and text[i] == {"[": "]", "{": "}"}[stack[-1]]:
                symbol, end = text[i], i + 1
                stack.pop()
            else:
                raise LexError(i)
        else:
            m = (_TOML_KEY if state == "key" else _TOML_VALUE).match(text, i)
            if m is None:
                raise LexError(i)
            symbol, end = m[0] if m.lastgroup == "op" else m.lastgroup, m.end()
            if state == "key":
                if symbol == "=":
                    state = "value"
                elif symbol == "}":
                    if not stack:
                        raise LexError(i)
                    stack.pop()
                    state = "after"
            elif symbol in ("[", "{"):
                stack.append(symbol)
                state = "value" if symbol == "[" else "key"
            elif symbol in ("]", "}"):
                if not stack or stack[-1] != {"]": "[", "}": "{"}[symbol]:
                    raise LexError(i)
                stack.pop()
                state = "after"
            else:
                state = "after"
        symbols.append(symbol)
        offsets.append(i)
        i = end
    if stack or state == "value":
        raise LexError(len(text))
    return symbols, offsets, []


_ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(["\\bfnrt]))')
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _part(raw: str) -> str:
    """The name that a part of a key stands for."""
    if raw[0] == "'":
        return raw[1:-1]
    if raw[0] == '"':
        return _ESCAPE.sub(lambda m: _PLAIN.get(m[3], m[3]) if m[3] else chr(int(m[1] or m[2], 16)), raw[1:-1])
    return raw


def defined_twice(text: str, symbols: list[str], offsets: list[int]) -> int | None:
    """Offset of the first key of a valid sequence of TOML tokens that defines again what is defined; None without one.

    Every place in the document has a kind: `value`, `inline` (closed), `array`, `header` (a table
    with its own header), `path` (made on the way to a header's table) or `dotted` (made by a
    dotted key). Elements of arrays of tables and inline tables are places of their own.
    """
    kinds: dict[tuple, str] = {}
    counts: dict[tuple, int] = {}
    fresh = 0  # numbers inline tables inside arrays apart
    section: tuple = ()
    stack: list[tuple] = [()]  # of the inline tables and arrays around, where their keys lie
    i, n = 0, len(symbols)

    def key(i: int) -> tuple[list[str], int]:
        parts = []
        while symbols[i] in ("BARE", "STRING"):
            # A token ends where it ends: bare ones at their last letter, quoted ones at their quote.
            m = _TOML_KEY.match(text, offsets[i])
            parts.append(_part(m[0]))
            i += 1
            if i < n and symbols[i] == ".":
                i += 1
            else:
                break
        return parts, i

    def step(at: tuple, part: str) -> tuple:
        at = (*at, part)
        return (*at, counts[at]) if kinds.get(at) == "array" else at

    while i < n:
        symbol = symbols[i]
        if symbol in ("[[", "[") and len(stack) == 1 and (i == 0 or symbols[i - 1] == "NEWLINE"):
            start = offsets[i]
            parts, i = key(i + 1)
            i += 1
            at: tuple = ()
            for p in parts[:-1]:
                at = step(at, p)
                if kinds.setdefault(at, "path") in ("value", "inline"):
                    return start
            at = (*at, parts[-1])
            kind = kinds.get(at)
            if symbol == "[[":
                if kind not in (None, "array"):
                    return start
                kinds[at], counts[at] = "array", counts.get(at, 0) + 1
                section = (*at, counts[at])
            else:
                if kind not in (None, "path"):
                    return start
                kinds[at] = "header"
                section = at
            stack = [section]
        elif symbol in ("BARE", "STRING") and (len(stack) == 1 and (i == 0 or symbols[i - 1] == "NEWLINE") or len(stack) > 1 and symbols[i - 1] in ("{", ",") and stack[-1] is not None):
            start = offsets[i]
            parts, i = key(i)
            at = stack[-1]
            for p in parts[:-1]:
                at = (*at, p)
                if kinds.get(at, "path") not in ("path", "dotted"):
                    return start
                kinds[at] = "dotted"
            at = (*at, parts[-1])
            if at in kinds:
                return start
            i += 1  # the equals sign
            if symbols[i] == "{":
                kinds[at] = "inline"
                stack.append(at)
            elif symbols[i] == "[":
                kinds[at] = "value"
                stack.append(None)
            else:
                kinds[at] = "value"
            i += 1
        else:
            if symbol == "{":
                fresh += 1
                stack.append((fresh, None))
            elif symbol == "[":
                stack.append(None)
            elif symbol in ("}", "]") and len(stack) > 1:
                stack.pop()
            i += 1
    return None
