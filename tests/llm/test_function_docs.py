import itertools
import random

import pytest

from strataloom.llm import function_docs as fd

GOOD = "Keeps at most ten entries so that long names cannot push others out."
CASES = [
    ("python", f'def f(a):\n    """{GOOD}"""\n    return a', True),
    ("python", f"async def f(a: int = 3, *b, **c) -> dict[str, int]:\n    # note\n\n    r'''{GOOD}'''\n    return a", True),
    ("python", f'def f(a="):", b=(1, 2)): "{GOOD}"', True),
    ("python", f'def f():\n    ("{GOOD[:20]}"\n     "{GOOD[20:]}")\n    pass', True),
    ("python", f'def f():\n    "{GOOD[:20]}" \\\n        "{GOOD[20:]}"\n    pass', True),
    ("python", f'def f():\n    x = 1\n    """{GOOD}"""', False),
    ("python", f'def f():\n    b"""{GOOD}"""', False),
    ("python", f'def f():\n    f"""{GOOD}"""', False),
    ("python", f'def f():\n    """{GOOD}""".strip()', False),
    ("python", f'def f():\n    usage = """{GOOD}"""', False),
    ("python", f'def f():\n    def g():\n        """{GOOD}"""\n    return g', False),
    ("python", f"def f():\n    # {GOOD}\n    pass", False),
    ("python", 'def load_file(path, mode):\n    """Load the file.\n\n    Args:\n        path (str): path\n        mode: the mode\n    """', False),
    ("python", 'def load_file(path):\n    """TODO: write me"""', False),
    ("python", 'def load_file(path):\n    """:param path:\n    :return:\n    :rtype: int"""', False),
    ("python", 'def load_file(path):\n    """Auto-generated docstring."""', False),
    ("python", 'def load_file(path):\n    """Args:\n        path (str): where last week\'s totals lie, relative to the archive\n    """', True),
    ("python", "def f():\n    '''설명 추가 예정'''", False),
    ("python", "def f():\n    '''파일이 바뀌지 않았으면 저장된 값을 그대로 돌려준다.'''", True),
    ("python", 'def f():\n    """', False),
    ("java", f"    /**\n     * {GOOD}\n     * @param a the a\n     */\n    @Override\n    public int f(int a) {{ return a; }}", True),
    ("java", "/** {@inheritDoc} */ void f() {}", False),
    ("java", "/** @param pathFooter\n * @return int */ int readFile(String pathFooter) { }", False),
    ("java", f"/* {GOOD} */ int f() {{ }}", False),
    ("java", f"int f() {{ /** {GOOD} */ }}", False),
    ("java", "/** (non-Javadoc) */ void f() {}", False),
    ("java", "/** Read file. */ void readFile() {}", False),
]


@pytest.mark.parametrize("language, code, documented", CASES)
def test_cases(language, code, documented):
    symbol = "Reader.readFile" if language == "java" and "readFile" in code else "load_file" if "load_file" in code else "f"
    found = fd.documentation(language, code, symbol)
    assert (found is not None and found[2]) == documented


def test_assignment_is_optimal():
    rng = random.Random(2)
    for n, m in [(1, 1), (3, 3), (2, 4), (4, 2), (3, 0)]:
        costs = [[rng.random() for _ in range(m)] for _ in range(n)]
        got = fd.assign(costs) if m else [-1] * n
        total = sum(costs[i][j] for i, j in enumerate(got) if j >= 0)
        if m:
            best = min(sum(costs[i][j] for i, j in pairs) for pairs in ([*zip(rows, cols)] for rows in itertools.permutations(range(n), min(n, m)) for cols in itertools.combinations(range(m), min(n, m))))
            assert abs(total - best) < 1e-9 and len({j for j in got if j >= 0}) == min(n, m)


def test_tags_decide_between_comments():
    code = 'def f(alpha):\n    """:param alpha: the first of the readings that were taken today"""\n    x = 1\n    def g(beta):\n        """:param beta: another of the readings that were taken before"""\n'
    assert "alpha" in fd.documentation("python", code, "f")[0]
    assert fd.tags_of(":param a: x\nArgs:\n    b (int): y\n    c: z\n\nReturns:\n    d: e") == {"a", "b", "c"}


@pytest.mark.parametrize("code, description", [
    # The nearest comment isn't the one: it documents parameters of another function, stands for another name, or lies beyond other statements.
    ("# Reads the totals that our archive kept.\ndef read_totals(week):\n    # :param day: the day whose orders are removed for good\n    return week", "Reads the totals that our archive kept."),
    ("def read_totals(week):\n    # TODO\n    'Reads what last week brought.'\n    return week", "Reads what last week brought."),
    ("def outer():\n    x = 1\n    # Sorts the shelf by colour, then by weight.\n    def sort_shelf():\n        return x\n    return sort_shelf", None),
    ("def outer():\n    # Walks the shelf once and keeps the heavy books.\n    def inner():\n        'Weighs one book against the scale.'\n    return inner", "Walks the shelf once and keeps the heavy books."),
    ("def outer():\n    x = 1\n    y = 2\n    'Walks the shelf once and keeps the heavy books.'", None),
])
def test_the_nearest_comment_may_lose(code, description):
    found = fd.documentation("python", code, code.partition("def ")[2].partition("(")[0])
    assert (found and found[0]) == description


def test_java_takes_the_comment_next_to_the_member():
    code = "/** Licensed under the terms of the shelf keepers. */\n// Weighs every book on the shelf.\n/** Counts the heavy books of a shelf. */\n@Deprecated\nint count(int shelf) { /** Never this one, it lies inside. */ return 1; }"
    assert fd.documentation("java", code, "count")[:3] == ("Counts the heavy books of a shelf.", "javadoc", True)
    assert fd.documentation("java", "// Weighs every book on the shelf.\nint f() { }", "f")[1:3] == ("comment", False)


def test_components_give_the_same_as_one_matrix():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        links = {(i, j): round(rng.uniform(-0.5, fd.MOST_COST - 0.01), 3) for i in range(n) for j in range(m) if rng.random() < 0.4}
        got = fd.matched(links)
        total = sum(links[i, j] for i, j in got.items()) + fd.MOST_COST * (n - len(got))
        whole = fd.assign([[links.get((i, j), 1e6) for j in range(m)] + [fd.MOST_COST if i == k else 1e6 for k in range(n)] for i in range(n)])
        best = sum(links[i, j] if j < m else fd.MOST_COST for i, j in enumerate(whole))
        assert abs(total - best) < 1e-6 and len(set(got.values())) == len(got)


def test_many_functions_in_one_chunk():
    code = "".join(f'def f{i}(a):\n    """Keeps the shelf number {i} in good order."""\n    return a\n' for i in range(3000))
    assert fd.documentation("python", code, "f0")[0] == "Keeps the shelf number 0 in good order."


def test_table(spark):
    rows = [(1, "function", "a.py", "f", CASES[0][1]), (1, "function", "a.py", "f", CASES[0][1]), (2, "method", "A.java", "A.f", CASES[20][1]), (3, "class", "a.py", "f", CASES[0][1]), (4, "function", "a.py", "f", None), (5, "function", None, "f", CASES[0][1]),
            (None, "function", "a.py", "f", CASES[0][1]), (6, "function", "a.py", None, CASES[0][1]), (7, "method", "a.py", "f", ""), (8, "function", "a.py", "f", 'def f():\n    """' + "Long words follow. " * 50_000 + '"""')]
    df = spark.createDataFrame([(*r, "x") for r in rows], "chunk_id bigint, kind string, file string, symbol string, code string, description string")
    assert sorted(r["chunk_id"] for r in fd.function_pairs(df).select("chunk_id").distinct().collect()) == [1, 2, 5, 8]
    assert fd.function_pairs(df.limit(0)).count() == 0


HEADERS = [
    "def f(a) -> dict[str, list[int]]:", "def f(a) -> Callable[[int], str]:", 'def f(a) -> "Node":', "def f(a) -> Annotated[int, Gt(0)]:", "def f(a) -> (int):", "def f(a) -> Literal['x']:", "@lru_cache(maxsize=None)\ndef f(a):", "@cache\n@app.get(path)\nasync def f(a) -> int:",
    "def f[T: (int, str)](a: T) -> T:", "def f(a) -> dict[str, int]:", "@staticmethod\ndef f(a):", "def f(a) -> list[  # note\n    int]:", "def f(a) \\\n        -> int:",
]


@pytest.mark.parametrize("header", HEADERS)
@pytest.mark.parametrize("body", [f'\n    """{GOOD}"""\n    return a', f'  # note\n\n    (\n    # note\n    r"{GOOD}")\n    return a', f' ( ( "{GOOD}" ) )'])
def test_no_header_hides_its_documentation(header, body):
    assert fd.documentation("python", header + body, "f") == (GOOD, "docstring", True, 0.0)


@pytest.mark.parametrize("header", ["def f(a):", "def f(a) -> dict[str, int]:", "@staticmethod\ndef f(a) -> int:"])
def test_the_lexer_is_spared_where_the_body_begins_otherwise(header):
    assert not fd.may_have_docstring(header + "\n    # note\n    return 'x'")
