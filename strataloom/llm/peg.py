"""Packrat parsing of token sequences with parsing-expression grammars.

A grammar is text: `name <- expression` lines with `/` (ordered choice), `* + ?`, `!` and `&`
(look-ahead), brackets, 'quoted' token symbols, UPPER-CASE token classes and rule names. Each
rule becomes one Python function of a position, without inner calls for anything but rules. A
rule that can be tried twice at one position keeps its results by position, so a parse stays
linear in the tokens. Choices look up the next symbol in the first sets of their alternatives.
A first parse only decides; one that fails is repeated by functions that also note the furthest
position at which a token didn't fit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_TOKEN = re.compile(r"\s*(?:(<-)|'([^']*)'|([A-Za-z_]\w*)|([/*+?!&()]))")


def _parse_rule(text: str) -> list:
    tokens = [m.groups() for m in _TOKEN.finditer(text)]
    at = 0

    def choice():
        nonlocal at
        options = [sequence()]
        while at < len(tokens) and tokens[at][3] == "/":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("choice", options)

    def sequence():
        nonlocal at
        parts = []
        while at < len(tokens) and tokens[at][3] not in ("/", ")"):
            parts.append(prefixed())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefixed():
        nonlocal at
        if tokens[at][3] in ("!", "&"):
            sign = tokens[at][3]
            at += 1
            return (sign, prefixed())
        _, literal, name, sign = tokens[at]
        at += 1
        if sign == "(":
            inner = choice()
            at += 1
        elif literal is not None:
            inner = ("sym", literal)
        else:
            inner = ("sym", name) if name.isupper() else ("rule", name)
        while at < len(tokens) and tokens[at][3] in ("*", "+", "?"):
            inner = (tokens[at][3], inner)
            at += 1
        return inner

    return choice()


class Grammar:
    """Rules by name; `start` must take the whole input."""

    def __init__(self, text: str, start: str):
        self.rules, name = {}, None
        lines: dict[str, str] = {}
        for line in text.splitlines():
            line = line.split("#!")[0]
            if m := re.match(r"(\w+)\s*<-(.*)", line):
                name = m[1]
                lines[name] = m[2]
            elif name and line.strip():
                lines[name] += " " + line.strip()
        self.rules = {n: _parse_rule(t) for n, t in lines.items()}
        self.start = start
        self.firsts: dict[str, tuple[frozenset, bool]] = {n: (frozenset(), False) for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, e in self.rules.items():
                new = self._first(e)
                if new != self.firsts[n]:
                    self.firsts[n], changed = new, True

    def _first(self, e) -> tuple[frozenset, bool]:
        """Symbols that may come first, and whether nothing may be taken."""
        kind, x = e
        if kind == "sym":
            return frozenset([x]), False
        if kind == "rule":
            return self.firsts[x]
        if kind in ("*", "?"):
            return self._first(x)[0], True
        if kind == "+":
            return self._first(x)
        if kind in ("!", "&"):
            return frozenset(), True
        if kind == "choice":
            each = [self._first(o) for o in x]
            return frozenset().union(*(f for f, _ in each)), any(n for _, n in each)
        found: frozenset = frozenset()
        for part in x:
            first, empty = self._first(part)
            found |= first
            if not empty:
                return found, False
        return found, True

    def _uses(self, e, name: str) -> int:
        """How often an expression may try a rule at one position."""
        kind, x = e
        if kind == "sym":
            return 0
        if kind == "rule":
            return int(x == name)
        if kind == "choice":
            return sum(self._uses(o, name) for o in x)
        if kind != "seq":
            return self._uses(x, name)
        most = group = 0
        for part in x:
            group += self._uses(part, name)
            most = max(most, group)
            if not self._first(part)[1]:
                group = 0
        return most

    def _kept(self) -> set[str]:
        """Rules whose results are kept: what stands in two places may be tried twice at one position, and what calls a rule is worth it."""
        calls = {n for n, e in self.rules.items() if any(self._places(e, m) for m in self.rules)}
        return {n for n in calls if sum(self._uses(e, n) for e in self.rules.values()) > 1}

    def _places(self, e, name: str) -> int:
        """In how many places a rule stands in an expression."""
        kind, x = e
        return int(kind == "rule" and x == name) if kind in ("sym", "rule") else sum(self._places(o, name) for o in x) if kind in ("seq", "choice") else self._places(x, name)

    @staticmethod
    def _is_class(e) -> bool:
        return e[0] == "sym" or e[0] == "choice" and all(o[0] == "sym" for o in e[1])

    def _code(self, e, at: str, lines: list[str], pad: str, notes: bool) -> None:
        """Lines that move the position in variable `at` past an expression, or set it to -1."""
        kind, x = e
        inner, depth = pad + " ", len(lines)
        fail = [f"{pad}if {at} < 0: far({at}q{depth})"] if notes else []
        keep = [f"{pad}{at}q{depth} = {at}"] if notes else []
        if kind == "sym":
            lines += [*keep, f"{pad}{at} = {at} + 1 if S[{at}] == {x!r} else -1", *fail]
        elif kind == "rule" and (x in self._once and len(pad) < 40 or self._is_class(self.rules[x])):
            self._code(self.rules[x], at, lines, pad, notes)  # a rule that stands in one place, or for some tokens, is written there
        elif kind == "rule":
            first, empty = self.firsts[x]
            lines += [f"{pad}{at} = r_{x}({at})"] if empty else [*keep, f"{pad}{at} = r_{x}({at}) if S[{at}] in {self._set(first)} else -1", *fail]
        elif kind == "seq":
            self._code(x[0], at, lines, pad, notes)
            if len(x) > 1:
                lines.append(f"{pad}if {at} >= 0:")
                self._code(("seq", x[1:]), at, lines, inner, notes)
        elif kind == "choice":
            if not notes and self._is_class(e):
                lines.append(f"{pad}{at} = {at} + 1 if S[{at}] in {self._set(frozenset(o[1] for o in x))} else -1")
                return
            start = f"{at}c{depth}"
            lines += [f"{pad}{start} = {at}", f"{pad}{at} = -1"]
            for o in x:
                first, empty = self._first(o)
                test = "" if empty else f" and S[{start}] in {self._set(first)}"
                lines += [f"{pad}if {at} < 0{test}:", f"{inner}{at} = {start}"]
                self._code(o, at, lines, inner, notes)
            lines += [f"{pad}if {at} < 0: far({start})"] if notes else []
        elif kind == "?":
            first, empty = self._first(x)
            start = f"{at}c{depth}"
            lines += [f"{pad}{start} = {at}", pad + ("if True:" if empty else f"if S[{at}] in {self._set(first)}:")]
            self._code(x, at, lines, inner, notes)
            lines += [f"{inner}if {at} < 0: {at} = {start}"] + ([f"{pad}else: far({start})"] if notes and not empty else [])
        elif kind in ("*", "+"):
            first, empty = self._first(x)
            start, begun = f"{at}c{depth}", f"{at}b{depth}"
            lines += [f"{pad}{begun} = {at}"] if kind == "+" else []
            lines += [pad + ("while True:" if empty else f"while S[{at}] in {self._set(first)}:"), f"{inner}{start} = {at}"]
            self._code(x, at, lines, inner, notes)
            lines += [f"{inner}if {at} <= {start}:", f"{inner} {at} = {start}", f"{inner} break"]
            lines += [f"{pad}else: far({at})"] if notes and not empty else []
            lines += [f"{pad}if {at} == {begun}: {at} = -1"] if kind == "+" else []
        else:
            start = f"{at}c{depth}"
            lines.append(f"{pad}{start} = {at}")
            self._code(x, at, lines, pad, notes and kind == "&")  # what must not follow is no place of failure
            lines.append(f"{pad}{at} = {start} if {at} {'<' if kind == '!' else '>='} 0 else -1")

    def _set(self, symbols: frozenset) -> str:
        return self._sets.setdefault(symbols, f"F{len(self._sets)}")

    def _functions(self, symbols: list[str], notes: bool) -> tuple[Callable[[int], int], list[dict], list[int]]:
        """The start rule as a function, what the rules keep, and the cell of the furthest failure."""
        self._sets: dict[frozenset, str] = {}
        kept, lines, furthest = self._kept(), [], [0]
        self._once = {n for n in self.rules if n != self.start and sum(self._places(e, n) for e in self.rules.values()) == 1 and not self._places(self.rules[n], n)}
        for name, e in self.rules.items():
            lines.append(f"def r_{name}(i):")
            if name in kept:
                lines += [f" p = k_{name}.get(i)", " if p is not None: return p"]
            lines.append(" p = i")
            self._code(e, "p", lines, " ", notes)
            lines += [f" k_{name}[i] = p", " return p"] if name in kept else [" return p"]

        def far(i: int) -> None:
            if i > furthest[0]:
                furthest[0] = i

        tables = {f"k_{n}": {} for n in kept}
        space = {"S": symbols, "far": far, **tables, "": None}
        code = compile("\n".join(lines), f"<grammar {self.start}>", "exec")
        space.update({name: symbols_ for symbols_, name in self._sets.items()})
        exec(code, space)  # the text is made from the grammar alone
        return space[f"r_{self.start}"], list(tables.values()), furthest

    def compile(self) -> Callable[[list[str]], tuple[bool, int]]:
        """A function of a list of token symbols: whether all of it fits, and the furthest failing token."""
        symbols: list[str] = []
        decide, kept, _ = self._functions(symbols, False)
        locate: list = []

        def run(tokens: list[str]) -> tuple[bool, int]:
            symbols[:] = tokens
            symbols.extend(("END", "END"))
            try:
                if decide(0) == len(tokens):
                    return True, len(tokens)
            finally:
                for k in kept:
                    k.clear()
            if not locate:
                locate.extend(self._functions(symbols, True))
            again, kept_again, furthest = locate
            furthest[0] = 0
            try:
                end = again(0)
            finally:
                for k in kept_again:
                    k.clear()
            return False, max(furthest[0], end)

        return run
