import ast
import json
import random
import tomllib
import warnings

import pytest

from strataloom.llm import source_syntax as s

PYTHON = '''"""Doc."""
from __future__ import annotations
import a.b as c, d
from . import (e, f as g,)
@deco(x=1, *y, **z)
class A[T: int](B, metaclass=M):
    x: int = 3
    def m(self, p, /, q: list[int] = [], *args: *Ts, r, s=2, **kw) -> None: return lambda a, *b, c=1: (yield)
async def n():
    async with a as b, c: pass
    async for i in (j async for j in k if j): await i
    return [*a, *b], {**c, 'd': 1}, {1, *e}, x[1:2, ::3, ...], -a ** -b if not c else d
with (open(a) as f, open(b)): print(f"{x!r:>{w}} {{}} {y['k']=}")
try: pass
except* (E, F) as e: raise G from e
else: del a[0], b.c
finally: global h
match x:
    case [1, *rest] | {"k": v, **kw} if v: pass
    case Point(x=0, y=-1j) as p: pass
    case _: pass
a, *b = c = d if e else f; g += 1
type X[T] = list[T]
while (n := 3): break
'''
JAVA = """package a.b; import static c.D.*;
@An(v = {1, 2}, w = @X) public sealed abstract class A<T extends B & C<? super T>> extends D<T[]> implements E permits F {
  static { x = 1; } private final Map<String, List<int[]>> m = new HashMap<>(), n[] = {{}};
  <U> A(int... a) throws G { this(); super.x(); }
  int f(final @N String s) { for (int i = 0, j = 1; i < 3; i++, j--) if (o instanceof String t && t.length() >>> 2 > 1) continue; else break;
    return switch (k) { case 1, 2 -> { yield 3; } default -> throw new E(); }; }
  record R(int a) { R { assert a > 0 : "x"; } } enum Z { P { }, Q(1) { void g() {} }; } @interface I { int v() default 1; }
  Runnable r = () -> { try (var q = w(); z) { } catch (H | J e) { } finally { } }; Object o = (Runnable & S) A::<T>new; int[][] y = new int[3][]; String t = \"\"\"
    text "quoted" \"\"\"; char c = '\\''; }
"""
TOML = 'a.b = 1_0\n"q" = \'\'\'x\n\'y\'\'\'\'\n[t."u v"]\nd = 1979-05-27T07:32:00.5-07:00 # c\n[[arr]]\ni = { x = [1, "2",\n 3.0e-1, ], y.z = true }\nn = -inf\r\n'
JSON = ' {"a": [1, -0.5e+3, true, null, "\\u00e9\\n"], "b": {}} '
VALID = {"python": PYTHON, "java": JAVA, "toml": TOML, "json": JSON}


def _no_constant(name):
    raise ValueError(name)


def real(language, text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            {"python": ast.parse, "json": lambda t: json.loads(t, parse_constant=_no_constant), "toml": tomllib.loads}[language](text)
        return True
    except (SyntaxError, ValueError):
        return False


@pytest.mark.parametrize("language", VALID)
def test_valid_sources_fit_the_grammar(language):
    assert s._refusal(language, VALID[language]) is None and s.check(language, VALID[language]) is None


@pytest.mark.parametrize("language", ["python", "json", "toml"])
def test_mutations_agree_with_the_languages_own_parser(language):
    rng, source, differ = random.Random(7), VALID[language], []
    for _ in range(1500):
        i = rng.randrange(len(source))
        y = rng.choice([source[:i], source[:i] + source[i + rng.randint(1, 3) :], source[:i] + rng.choice(list("()[]{}:,.=+-*/'\"\\ \n\t@#01aé")) + source[i:]])
        grammar = s._refusal(language, y) is None
        if grammar != real(language, y):
            differ.append((i, y[max(0, i - 30) : i + 30], grammar))
    assert differ == [], differ[:5]


def test_keys_of_toml_that_are_defined_twice():
    rng, differ, seen = random.Random(5), [], set()
    keys = ["a", "b", "a.b", "b.a", '"a"', "'b'.c", "a.b.c", "c"]
    for _ in range(4000):
        lines = []
        for _ in range(rng.randint(2, 5)):
            k, value = rng.choice(keys), rng.choice(["1", "{}", "{ a = 1, b.c = 2 }", "{ a.b = 1, a.c = 2 }", "{ a = 1, a.b = 2 }", "[{ a = 1 }, { a = 2 }]", "[\n1,\n]"])
            lines.append(rng.choice([f"[{k}]", f"[[{k}]]", f"{k} = {value}", f"{k} = {value}"]))
        text = "\n".join(lines)
        seen.add(real("toml", text))
        if (s._refusal("toml", text) is None) != real("toml", text):
            differ.append(text)
    assert seen == {True, False} and differ == [], (len(differ), differ[:3])


def test_every_lost_bracket_of_java_is_noticed():
    from strataloom.llm.grammars import java17

    symbols, offsets, _ = java17.lex(JAVA)
    for symbol, at in zip(symbols, offsets):
        if symbol in ("{", "}", "(", ")"):
            assert s.check("java", JAVA[:at] + JAVA[at + 1 :]) is not None, JAVA[at - 20 : at + 20]


@pytest.mark.parametrize("language, text, cause", [
    ("python", "def f(:\n", "syntax"), ("python", "x = (1,\n", "truncated"), ("python", "a = 1\n<<<<<<< HEAD\nb = 2\n=======\nb = 3\n>>>>>>> x\n", "merge_conflict"), ("python", "if a:\n\tb\n        c\n", "syntax"), ("python", "print 'x'", "syntax"),
    ("java", "class A { void f() { a + b; } }", "syntax"), ("java", "class A { String s = \"", "syntax"), ("java", "class A { /* open", "truncated"), ("java", "fun f(x: Int) {}", "syntax"), ("java", "class A { void f() { switch (o) { case String s -> g(); } } }", "syntax"),
    ("json", "", "truncated"), ("json", '{"a": 1,}', "syntax"), ("json", "[NaN]", "syntax"), ("json", "[01]", "syntax"), ("json", "{'a': 1}", "syntax"), ("json", '"tab\there"', "syntax"),
    ("toml", "a = ", "truncated"), ("toml", "a = 1 b = 2", "syntax"), ("toml", "[a", "truncated"), ("toml", "a = {x = 1,\n}", "syntax"), ("toml", "a = 01", "syntax"),
])
def test_refusals(language, text, cause):
    assert s.check(language, text)[2] == cause


def test_empty_and_odd_texts():
    assert [s.check(x, "") is None for x in ("python", "java", "toml", "json")] == [True, True, True, False]
    assert s.check("java", "/*\n<<<<<<< HEAD\n*/ class A {}") is None and s.check("python", '"""\n=======\n"""') is None
    assert s.check("json", "[" * 3000 + "]" * 3000) is None
    assert s.check("python", "x = [" + "1, " * 50_000 + "]") is None


DEEP = 5000
NESTED = {
    "python": ("x = " + "[" * DEEP, "]" * DEEP + "\n"), "json": ('{"a":' * DEEP + "1", "}" * DEEP), "toml": ("a = " + "[" * DEEP, "]" * DEEP),
    "java": ("class A { int x = " + "(" * DEEP + "1", ")" * DEEP + "; }"),
}


@pytest.mark.parametrize("language", NESTED)
def test_deep_files_are_decided_like_flat_ones(language):
    before, after = NESTED[language]
    assert s.check(language, before + after) is None
    assert s.check(language, before)[2] == "truncated"
    assert s.check(language, before + after[1:]) is not None
    assert s.check(language, before + "," + after) is not None if language != "json" else s.check(language, before + ",," + after) is not None


def test_what_is_too_deep_is_never_valid(monkeypatch):
    monkeypatch.setattr(s, "MOST_FRAMES", 3000)
    limit = s.sys.getrecursionlimit()
    try:
        s.sys.setrecursionlimit(3000)
        assert s.check("java", "class A { int x = " + "(" * 20_000 + "1" + ")" * 20_000 + "; }")[2] == "too_deep"
    finally:
        s.sys.setrecursionlimit(limit)


def test_place_of_a_failure_inside_an_f_string():
    text = "# a b is fine here\nx = 1\ny = f'{a b} {c}'\n"
    assert s.check("python", text)[:2] == (3, 10)


@pytest.mark.parametrize("language, text", [("java", "def f(x):\n    return x\n"), ("python", "class A { int x; }"), ("json", "a = 1\n[b]\nc = 2\n"), ("toml", '{"a": [1, 2]}'), ("java", '{"a": true}')])
def test_wrong_extension(language, text):
    assert s.check(language, text)[2] == "wrong_extension"


def test_furthest_failure():
    assert s.check("python", "a = 1\nb = = 2\n")[:2] == (2, 5)
    assert s.check("java", "class A {\n  int x\n}")[:2] == (3, 1)


def test_table_and_rates(spark):
    rows = [(1, 1, "a.py", "x = 1"), (2, 1, "b.PY", "x ="), (2, 1, "b.PY", "x ="), (3, 1, "c.json", ""), (4, 2, "d.toml", None), (5, 2, "e.md", "x ="), (6, None, "f.java", "class"), (None, 1, "g.py", "x ="), (7, 1, None, "x ="), (8, 1, "py", "x =")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "file_id bigint, repo_id bigint, path string, content string, key string, language int")
    found = s.invalid_files(df)
    assert sorted(r["file_id"] for r in found.collect()) == [2, 3, 6]
    rates = {(r["repo_id"], r["language"]): (r["n_files"], r["n_invalid"]) for r in s.invalid_rates(df, found).collect()}
    assert rates == {(1, "python"): (2, 1), (1, "json"): (1, 1), (None, "java"): (1, 1)}
    assert s.invalid_files(df.limit(0)).count() == 0
