from datetime import datetime

import pytest

from pyspark.sql import functions as F

from strataloom.functions import names
from strataloom.operators import imports, indexing, overview, records
from strataloom.streaming import index_stream

T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1)
FILE = "file_id bigint, repo_id bigint, path string, listing string, content string, loaded_at timestamp, symbol string"


def files(spark, *rows):
    return spark.createDataFrame([(i, 1, path, "files", content, at, "x") for i, (path, content, at) in enumerate(rows)], FILE)


JAVA = """package a.b;

/** The shelf. */
@An(v = {1, 2})
public class Shelf<T extends B> extends Base {
    private final int[] sizes = {1, 2};
    private final Runnable r = () -> { run(); };
    static { init(); }

    /**
     * Counts.
     */
    @Override
    public int count(int limit) throws E {
        Object o = new Object() { void inner() { } };
        return "}".length();
    }
    Shelf(int a) { this.a = a; }
    abstract void open(String s);
    enum Kind { A(1) { void f() { } }, B; Kind(int i) { } boolean big() { return true; } }
    record Pair(int x, int y) { Pair { assert x > 0; } int sum() { return x + y; } }
    interface Walker { void walk(); default void stop() { } }
}
"""


def test_members_of_java():
    found = [(s, k, a, b, p) for s, k, a, b, p in indexing.java_members(JAVA)]
    assert found == [
        ("Shelf", "class", 3, 23, None), ("Shelf.count", "method", 10, 17, "Shelf"), ("Shelf.Shelf", "method", 18, 18, "Shelf"), ("Shelf.open", "method", 19, 19, "Shelf"),
        ("Shelf.Kind", "class", 20, 20, "Shelf"), ("Kind.Kind", "method", 20, 20, "Kind"), ("Kind.big", "method", 20, 20, "Kind"),
        ("Shelf.Pair", "class", 21, 21, "Shelf"), ("Pair.Pair", "method", 21, 21, "Pair"), ("Pair.sum", "method", 21, 21, "Pair"),
        ("Shelf.Walker", "class", 22, 22, "Shelf"), ("Walker.walk", "method", 22, 22, "Walker"), ("Walker.stop", "method", 22, 22, "Walker"),
    ]
    assert indexing.java_members("class A { void f() { if (x) {") == [("A", "class", 1, 1, None), ("A.f", "method", 1, 1, "A")]
    assert indexing.java_members("") == []


def test_documentation_of_java_files():
    assert indexing.java_file_doc(JAVA) == "The shelf."
    assert indexing.java_file_doc("/** Old. */ import a.B;\nclass A { }\n/** Later. */ class C { }") is None
    assert indexing.java_file_doc("/* plain */ class A { }") is None and indexing.java_file_doc("") is None
    assert indexing.clean_javadoc("/**\n * One.\n *   in\n * @param x y\n */") == "One.\n  in\n@param x y" and indexing.clean_javadoc("/** */") is None


def test_members_of_python_and_of_a_file_that_does_not_parse():
    source = "class A:\n    @deco\n    def f(self):\n        def g():\n            pass\n        return g\n\ndef h():\n    pass\n"
    whole = [("A", "class", 1, 6, None), ("A.f", "method", 3, 6, "A"), ("f.g", "function", 4, 5, "f"), ("h", "function", 8, 9, None)]
    assert indexing.python_members(source) == whole
    assert indexing.python_members(source + "x = = 1\n") == whole
    assert indexing.python_members("def f(:\n    pass\n") == [("f", "function", 1, 2, None)]


def test_chunks_of_files(spark):
    df = files(spark, ("a.py", "def f():\n    pass\n\ndef f():\n    return 1\n", T2), ("a.py", "def old(): pass\n", T1), ("B.java", JAVA, T1), ("c.py", None, T1), ("d.py", "", T1), ("e.md", "# x", T1), ("f.py", "x =\r\n", T1))
    rows = {(r["file"], r["symbol"]): r for r in indexing.index_chunks(df).collect()}
    assert rows["a.py", "f"]["code"] == "def f():\n    pass" and rows["a.py", "f#2"]["start_line"] == 4 and rows["a.py", "f#2"]["id"] == "a.py::f#2"
    assert rows["B.java", "Shelf.count"]["code"].startswith("    /**\n     * Counts.") and rows["B.java", "Shelf.count"]["code"].endswith("    }")
    assert {f for f, s in rows if f == s} == {"a.py", "B.java", "d.py", "f.py"} and ("a.py", "old") not in rows
    assert indexing.index_chunks(df.limit(0)).count() == 0
    docs = files(spark, ("a.py", '"""  One\\n two.  """\nx = 1\n', T1), ("B.java", JAVA, T1), ("c.py", "x = 1\n", T1), ("d.py", "def f(:", T1))
    assert {(r["path"], r["doc"]) for r in indexing.file_docs(docs).collect()} == {("a.py", "One\\n two."), ("B.java", "The shelf.")}


@pytest.fixture(scope="module")
def repository(spark):
    df = files(spark, ("src/com/a/B.java", "package com.a;\nclass B { }", T1), ("src/com/a/C.java", "package com.a;\nclass C { }", T1), ("lib/core/__init__.py", "", T1), ("lib/core/parser.py", "", T1), ("lib/core/x.py", "", T1), ("x/C.java", "class C { }", T1))
    chunks = spark.createDataFrame(
        [(1, "file", "src/com/a/C.java", ["com.a.B", "com.a.B.Inner", "com.a.B.count", "com.a.*", "org.apache.Tool", "java.util.List"]), (1, "file", "lib/core/x.py", ["core.parser", "parser", ".parser", "os.path", "httpx.Client", "core"]), (1, "file", "x/C.java", ["com.a.C"])],
        "repo_id bigint, kind string, file string, imports array<string>",
    )
    return imports.file_imports(chunks), imports.module_entries(df), imports.package_names(df)


def test_imports_of_own_packages_and_classes_are_internal(repository):
    found, entries, packages = repository
    marked = {(r["file"][-4:], r["name"]): r["internal"] for r in imports.internal_imports(found, imports.internal_names(entries, packages)).collect()}
    assert {n for (f, n), inside in marked.items() if inside} == {"com.a.B", "com.a.B.Inner", "com.a.B.count", "com.a.*", "core.parser", ".parser", "core", "com.a.C"}
    assert {n for (f, n), inside in marked.items() if not inside} == {"org.apache.Tool", "java.util.List", "parser", "os.path", "httpx.Client"}


def test_import_edges_go_to_the_one_file_that_is_meant(repository):
    found, entries, _ = repository
    edges = {(r["src"], r["dst"]) for r in imports.import_edges(found, entries).collect()}
    # Two files are called C, so no edge goes to either.
    assert edges == {("src/com/a/C.java", "src/com/a/B.java"), ("lib/core/x.py", "lib/core/parser.py"), ("lib/core/x.py", "lib/core/__init__.py")}


def test_import_totals(repository):
    found, entries, packages = repository
    row = imports.import_totals(found, imports.internal_names(entries, packages)).collect()[0]
    assert (row["n_internal"], row["n_third_party"], row["n_stdlib"]) == (8, 3, 2)


def test_test_paths(spark):
    cases = {"a/tests/x.py": True, "test/x.md": True, "a/test_x.py": True, "a/x_test.go": True, "a/XTest.kt": True, "a/XTests.java": True, "XTest": True, "a/contest.py": False, "a/Testing.java": False, "attests/x.py": False, "a/x_test.d/y.py": False}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r["path"]: r["t"] for r in df.select("path", names.is_test_path(F.col("path")).alias("t")).collect()} == cases


def test_quoted_scores_count_only_as_whole_numbers(spark):
    raw = spark.createDataFrame([('{"specificity": "1.5", "calibration": 1.5, "groundedness": "2"}',), ('{"specificity": true, "calibration": "x", "groundedness": 9}',), ("no json",)], "raw string")
    assert [tuple(r) for r in records.parse_feedback(raw).select("specificity", "calibration", "groundedness").collect()] == [(0, 1, 2), (1, 0, 2), (0, 0, 0)]


def test_main_file_has_the_longest_overview_and_is_no_test(spark):
    rows = [(1, "a.py", "file", "a.py", 1, "Short."), (1, "a.py", "function", "f", 2, "Tells a good deal about what it does."), (1, "b.py", "file", "b.py", 1, "Somewhat longer than the other."), (1, "b.py", "class", "C", 3, None), (1, "tests/c.py", "file", "tests/c.py", 1, "Long " * 50), (2, "tests/d.py", "file", "tests/d.py", 1, "x")]
    chunks = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "chunk_id bigint, repo_id bigint, file string, kind string, symbol string, start_line int, summary string")
    texts = {r["file"]: r["text"] for r in overview.file_map(chunks).collect()}
    assert texts["a.py"] == "Short.\n  symbols\n    f: Tells a good deal about what it does." and texts["b.py"].endswith("other.\n  symbols")
    assert [tuple(r) for r in overview.main_files(chunks).collect()] == [(1, "a.py")]


def test_screening_of_repositories(spark):
    df = files(spark, *((f"m{i}.py", "def f(): pass\n" * 4, T1) for i in range(3)), ("tests/x.py", "x = 1\n", T1), ("bad.py", "def", T1))
    facts = spark.createDataFrame([(1, f"m{i}.py", 4, 4) for i in range(3)] + [(1, "tests/x.py", 0, 0)], "repo_id bigint, path string, n_symbols bigint, n_documented bigint")
    row = overview.screening(df, facts).collect()[0]
    assert (row["n_files"], row["n_parsed"], row["n_symbols"], row["n_tests"], row["verdict"]) == (5, 4, 12, 1, "unparsable")
    assert overview.screening(df.where("path <> 'bad.py'"), facts).collect()[0]["verdict"] == "documented_already"
    assert overview.screening(df.where("path like 'tests%'"), facts).collect()[0]["verdict"] == "too_small"


def test_pointer_is_replaced_at_once_and_old_versions_go(spark, tmp_path):
    store = str(tmp_path / "store")
    for batch in range(4):
        index_stream.publish(spark, store, spark.range(batch + 1), batch)
        folder, done = index_stream.published(spark, store)
        assert done == batch and spark.read.parquet(folder).count() == batch + 1
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("version")) == ["version-2", "version-3"]
    assert not (tmp_path / "store" / "current.json.new").exists()
