from datetime import datetime

from pyspark.sql import functions as F

from strataloom.functions import names
from strataloom.operators import calls, imports, scan


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_names(spark):
    assert one(spark, "a.b.c", names.dotted_suffixes) == ["a.b.c", "b.c", "c"]
    assert one(spark, "x/y.tar.GZ", names.extension) == ".gz" and one(spark, "x/.env", names.extension) == "" and one(spark, "Makefile", names.extension) == ""
    assert one(spark, "how does foo_bar use FooBar and foo_bar in X or plain", names.identifiers) == ["foo_bar", "FooBar"]
    assert [one(spark, x, names.clamp_score) for x in ("1", "2.9", "-3", "7", "true", "x", "")] == [1, 2, 0, 2, 1, 0, 0]
    assert one(spark, "org.alpha.Beta", names.java_dependency) == "org.alpha" and one(spark, "java.util.List", names.java_dependency) is None
    assert one(spark, None, names.dotted_suffixes) is None


def test_classify_and_fold(spark):
    files = spark.createDataFrame([(1, "a/b.py", 10), (1, "a/.git/b.py", 1), (1, "build/x.py", 1), (1, "b.go", 1), (1, "big.java", scan.MAX_BYTES + 1), (1, "edge.java", scan.MAX_BYTES), (1, "own/x.py", 1)], "repo_id bigint, path string, size_bytes bigint")
    found = {r["path"]: r["status"] for r in scan.classify(files, exclude=("own",)).collect()}
    assert found == {"a/b.py": "kept", "a/.git/b.py": "excluded", "build/x.py": "excluded", "b.go": "skipped_other", "big.java": "skipped_by_size", "edge.java": "kept", "own/x.py": "excluded"}
    counts = spark.createDataFrame([(1, f".{c}", n) for c, n in zip("abcdefg", (9, 8, 7, 6, 5, 2, 1))] + [(2, f".{c}", 1) for c in "abcdef"], "repo_id bigint, ext string, n bigint")
    folded = rows(scan.fold_counts(counts))
    assert (1, "other", 3) in folded and len([r for r in folded if r[0] == 2]) == 6


def test_read_tree(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.md").write_text("# é\n", encoding="utf-8")
    assert rows(scan.read_tree(spark, str(tmp_path))) == [("b.md", 5, "# é\n"), ("p/a.py", 6, "x = 1\n")]


def test_modules_and_edges(spark):
    files = spark.createDataFrame([(1, p) for p in ("pkg/__init__.py", "pkg/core/__init__.py", "pkg/core/a.py", "pkg/b.py", "tools/b.py", "tools/c.py", "__init__.py")], "repo_id bigint, path string")
    entries = imports.module_entries(files.where("path <> '__init__.py'"))
    assert rows(entries) == [(1, "b", "tools/b.py"), (1, "c", "tools/c.py"), (1, "pkg", "pkg/__init__.py"), (1, "pkg.b", "pkg/b.py"), (1, "pkg.core", "pkg/core/__init__.py"), (1, "pkg.core.a", "pkg/core/a.py")]
    used = spark.createDataFrame([(1, "pkg/b.py", "x.pkg.core.a"), (1, "pkg/b.py", "pkg.b"), (1, "tools/c.py", "numpy.linalg"), (1, "tools/c.py", "os.path"), (1, "tools/c.py", ".rel"), (1, "tools/c.py", "pkg.core")], "repo_id bigint, file string, name string")
    assert rows(imports.import_edges(used, entries)) == [(1, "pkg/b.py", "pkg/core/a.py"), (1, "tools/c.py", "pkg/core/__init__.py")]
    names = entries.select("repo_id", entries["module"].alias("name"))
    assert {(r["name"], r["internal"]) for r in imports.internal_imports(used, names).collect()} == {("x.pkg.core.a", True), ("pkg.b", True), ("numpy.linalg", False), ("os.path", False), (".rel", True), ("pkg.core", True)}
    assert rows(imports.dependencies(used, names)) == [(1, "numpy", "third_party", 1), (1, "os", "stdlib", 1)]


CHUNKS = "chunk_id bigint, repo_id bigint, file string, symbol string, kind string, start_line int, end_line int, code string, parent string, calls array<string>, imports array<string>"


def chunks(spark):
    return spark.createDataFrame([
        (1, 1, "m/a.py", "A.f", "method", 2, 5, "def f(self):\n    self.g()\n    helper()\n    twice()\n    x.append(1)\n    far()\n    print(lone())", "A", [], ["m.far", "m.b"]),
        (2, 1, "m/a.py", "A.g", "method", 6, 8, "def g(self): pass", "A", [], []),
        (3, 1, "m/a.py", "B.g", "method", 9, 10, "def g(self): pass", "B", [], []),
        (4, 1, "m/a.py", "helper", "function", 11, 12, "def helper(): pass", None, [], []),
        (5, 1, "m/b.py", "helper", "function", 1, 2, "def helper(): pass", None, [], []),
        (6, 1, "m/b.py", "twice", "function", 3, 4, "def twice(): pass", None, [], []),
        (7, 1, "m/c.py", "twice", "function", 1, 2, "def twice(): pass", None, [], []),
        (8, 1, "m/far.py", "far", "function", 1, 2, "def far(): pass", None, [], []),
        (9, 1, "m/a.py", "A", "class", 1, 10, "class A", None, [], []),
        (10, 1, "m/d.py", "twice", "function", 1, 2, "def twice(): pass", None, [], []),
    ], CHUNKS)


def test_call_resolution_rules(spark):
    c = chunks(spark)
    found = {r["name"]: (r["rule"], r["dst"]) for r in calls.resolve_calls(calls.call_sites(c), calls.definitions(c)).where("chunk_id = 1").collect()}
    assert found == {
        "g": ("same_class", "m/a.py::A.g"), "helper": ("same_file", "m/a.py::helper"), "twice": ("import", "m/b.py::twice"), "append": ("builtin", None),
        "far": ("unique", "m/far.py::far"), "print": ("external", None), "lone": ("external", None),
    }
    edges = calls.call_edges(calls.resolve_calls(calls.call_sites(c), calls.definitions(c)))
    assert rows(calls.neighbours(edges)) == [(1, "m/a.py", "m/b.py", 1), (1, "m/a.py", "m/far.py", 1)]
    assert rows(calls.neighbours(edges, "in")) == [(1, "m/b.py", "m/a.py", 1), (1, "m/far.py", "m/a.py", 1)]
    assert calls.call_edges(calls.resolve_calls(calls.call_sites(c.limit(0)), calls.definitions(c.limit(0)))).count() == 0


def test_enclosing_symbol_is_the_innermost(spark):
    points = spark.createDataFrame([(1, "m/a.py", 3), (1, "m/a.py", 1), (1, "m/a.py", 99)], "repo_id bigint, file string, line int")
    assert rows(calls.enclosing_symbols(chunks(spark), points)) == [(1, "m/a.py", 1, "A"), (1, "m/a.py", 3, "A.f")]


def test_callers_are_capped_in_the_text_only(spark):
    edges = spark.createDataFrame([(1, f"a::f{i:02d}", "b::g") for i in range(12)], "repo_id bigint, src string, dst string")
    row = calls.callers(edges).first()
    assert row["n_callers"] == 12 and row["callers"].count(",") == 9 and row["callers"].startswith("a::f00,a::f01")


def test_streamed_index_matches_a_batch(spark, tmp_path):
    from strataloom.streaming import index_stream as s

    schema = "repo_id bigint, path string, content string, loaded_at timestamp"
    at = lambda d: datetime(2025, 1, d)
    parts = [[(1, "a", "one", at(1)), (1, "b", None, at(1))], [(1, "a", "two", at(3)), (2, "a", "x", at(1))], [(1, "a", "late", at(2))]]
    store, source = f"{tmp_path}/store", f"{tmp_path}/in"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        s.index_stream(spark, source, store, f"{tmp_path}/cp", schema, 1).awaitTermination()
    want = spark.createDataFrame([(1, "a", "two"), (2, "a", "x")], "repo_id bigint, path string, c string").select("repo_id", "path", F.sha2("c", 256))
    assert rows(s.read_index(spark, store).select("repo_id", "path", "hash")) == rows(want)
    _, batch = s.published(spark, store)
    s.merge_batch(store)(spark.createDataFrame(parts[0], schema), batch)  # replayed after a failure
    assert rows(s.read_index(spark, store).select("repo_id", "path", "hash")) == rows(want)


def test_windowed_counts(spark):
    from strataloom.streaming.index_stream import windowed_counts

    events = spark.createDataFrame([(datetime(2025, 1, 1, h), "a") for h in (1, 2)] + [(datetime(2025, 1, 2), "a")], "ts timestamp, event_type string")
    assert [(r["event_type"], r["n"]) for r in windowed_counts(events).orderBy("start").collect()] == [("a", 2), ("a", 1)]
