import random

import numpy as np
from pyspark.sql import functions as F

from strataloom.operators import evaluation, overview, parsing, retrieval


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_vector_topk_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(120, 8))
    vectors[7] = 0
    vectors[9] = vectors[8]
    base = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)] + [(500, None, 0), (501, [], 0)], "vec_id bigint, embedding array<double>, label int")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "BASE_BLOCK", 30)
    monkeypatch.setattr(retrieval, "QUERY_SLICE", 5)
    monkeypatch.setattr(retrieval, "SLICES_AT_ONCE", 2)
    queries = base.where("vec_id % 10 = 0")
    found = {(r["query"], r["rank"]): (r["vec_id"], r["distance"]) for r in retrieval.vector_topk(queries, base, k=5).collect()}
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for q in range(0, 120, 10):
        d = np.round(1 - unit[q] @ unit.T, 6)
        want = [j for j in sorted(range(120), key=lambda j: (d[j], j)) if j != q][:5]
        assert [found[q, r][0] for r in range(1, 6)] == want
    grouped = retrieval.vector_topk(queries, base, k=2, group="label")
    assert grouped.groupBy("query", "label").count().where("count <> 2").count() == 0
    assert retrieval.vector_topk(base.limit(0), base).count() == 0


def test_index_reaches_its_recall_and_looks_into_few_lists_where_vectors_lie_in_groups(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 16))
    vectors = middles[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None), (9001, [])], "vec_id bigint, embedding array<double>")
    index = retrieval.fit_index(base, centres=24)
    assert index.probes <= 8
    queries = base.where("vec_id % 50 = 0")
    row = retrieval.recall(retrieval.index_topk(queries, base, index), retrieval.vector_topk(queries, base)).collect()[0]
    assert row["n_exact"] == 240 and row["recall"] >= 0.9
    assert retrieval.index_topk(base.limit(0), base, index).count() == 0 and retrieval.fit_index(base.limit(0)).probes == 0


def test_quotas_use_up_their_places(spark):
    every = spark.createDataFrame([(1, r, r, k) for r, k in enumerate(["fn", "file", "fn", "fn", "fn", "file", "doc", "fn", "fn"], 1)], "query bigint, rank bigint, vec_id bigint, kind string")
    by_kind = spark.createDataFrame([(1, 1, 2, "file"), (1, 2, 6, "file"), (1, 3, 99, "file"), (1, 1, 7, "doc")], "query bigint, rank bigint, vec_id bigint, kind string")
    assert [r[2] for r in rows(retrieval.quota_union(by_kind, every))] == [1, 2, 3, 4, 6, 7, 5, 8]


def test_drop_contained_against_pairs(spark):
    rng = random.Random(4)
    spans = [(i, 1, *sorted((rng.randint(1, 20), rng.randint(1, 20)))) for i in range(60)] + [(60, 1, 1, 20), (61, 1, 1, 20), (62, 2, 5, 5)]
    kept = {r["chunk_id"] for r in retrieval.drop_contained(spark.createDataFrame(spans, "chunk_id bigint, f bigint, start_line int, end_line int"), ["f"]).collect()}
    inside = lambda a, b: a[1] == b[1] and b[2] <= a[2] and b[3] >= a[3] and (b[2:] != a[2:] or b[0] < a[0])
    assert kept == {a[0] for a in spans if not any(inside(a, b) for b in spans)}


def test_identifiers_and_mentions(spark):
    chunks = spark.createDataFrame([(1, 1, "function", "a_b() + a_b", "x.a_b"), (2, 1, "method", "a_b a_bc", "M.a_bc"), (3, 1, "file", "a_b a_b a_b", "f"), (4, 2, "function", "a_b", "a_b")], "chunk_id bigint, repo_id bigint, kind string, code string, symbol string")
    asks = spark.createDataFrame([(9, 1, "what does a_b do"), (10, 1, None), (11, 1, "use a_bc, a_b")], "id bigint, repo_id bigint, question string")
    assert [r for r in rows(retrieval.identifier_hits(asks, chunks)) if r[0] == 9] == [(9, "a_b", 1, 1, 2), (9, "a_b", 2, 2, 1)]
    assert rows(retrieval.mentioned_symbols(asks, chunks)) == [(11, "a_bc"), (9, "a_b")]
    files = spark.createDataFrame([(1, "p/a.py"), (1, "q/a.py"), (1, "q/b.py")], "repo_id bigint, path string")
    texts = spark.createDataFrame([(1, 1, "see b.py, a.py and p/a.py; p/a.py again"), (2, 1, None)], "id bigint, repo_id bigint, body string")
    assert rows(retrieval.mentioned_files(texts, files)) == [(1, 1, "q/b.py"), (1, 2, "p/a.py")]


def test_picks_and_evidence(spark):
    candidates = spark.createDataFrame([(1, r, 10 + r) for r in range(1, 6)], "query bigint, rank int, item bigint")
    picks = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 99), (1, 4, 1)], "query bigint, pos int, pick int")
    assert [r[2] for r in rows(retrieval.validated_picks(picks, candidates, 4))] == [13, 11, 12, 14]
    hits = spark.createDataFrame([(1, 0, 1, 1, "f", "method", 5, 6), (1, 0, 2, 2, "f", "file", 1, 90), (1, 1, 1, 3, "f", "class", 4, 9), (1, 1, 2, 4, "f", "method", 7, 8), (1, 1, 3, 5, "g", "method", 1, 2)],
                                 "query bigint, stage int, rank int, chunk_id bigint, file string, kind string, start_line int, end_line int")
    assert [r[2] for r in rows(retrieval.union_evidence(hits, 4))] == [2, 3, 5]
    found = rows(retrieval.embed_hashed(spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, t string"), "id", "t").select("id", F.size("embedding")))
    assert found == [(1, 64), (2, 64)]


def test_overview(spark):
    files = spark.createDataFrame([(1, "z/cli.py", ""), (1, "run.py", "if __name__ == '__main__': pass"), (1, "a/test_x.py", "__main__"), (1, "M.java", "public static void main(String[] a) {}"), (1, "x.py", "")], "repo_id bigint, path string, content string")
    assert [(r[1], r[2]) for r in sorted(overview.entry_points(files).collect(), key=lambda r: r["place"])] == [("M.java", "main method"), ("run.py", "main block"), ("z/cli.py", "file name"), ("a/test_x.py", "main block")]
    edges = spark.createDataFrame([(1, "a::f", "a::g"), (1, "a::f", "b::h"), (1, "b::h", "a::f"), (1, "t/test_a.py::t", "a::f"), (1, "t/test_a.py::t", "a::g"), (1, "a::C.__init__", "a::f"), (1, "a::C.__init__", "a::g")], "repo_id bigint, src string, dst string")
    assert rows(overview.flow_ranking(edges)) == [(1, "a::f", 2, 3, 1)]
    item = lambda name, n: spark.createDataFrame([(1, f"{name}{i}", i) for i in range(1, n + 1)], f"repo_id bigint, {'id' if name == 'w' else 'dep' if name == 'd' else 'file'} string, place int")
    order = [r["item"] for r in sorted(overview.interleave(item("w", 3), item("d", 1), item("f", 2)).collect(), key=lambda r: r["number"])]
    assert order == ["w1", "d1", "w2", "f1", "w3", "f2"]


def test_metrics(spark):
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "z")], "query bigint, rank int, item string")
    gold = spark.createDataFrame([(1, "b"), (2, "c"), (3, "q")], "query bigint, item string")
    assert tuple(evaluation.rank_metrics(evaluation.gold_ranks(found, gold, "item")).first()) == (3, 0.333333, 0.666667, 0.5)
    expected = spark.createDataFrame([(1, "a"), (1, "x"), (2, "c")], "query bigint, item string")
    assert rows(evaluation.expected_found(found, expected, "item")) == [(1, 2, 1, True, False), (2, 1, 1, True, True)]


SOURCE = '''"""Doc of the module."""
import os, os.path
from . import x
try:
    import json
except ImportError:
    import simplejson
else:
    from a.b import c as d
finally:
    import never
def top(a, b, _c, *args):
    """D."""
    import inner
    def local(z): return z
    return os.path.join(b)  # note
class C:
    def m(self, q): pass
    def __exit__(self, exc_type, exc_val, exc_tb): return 1
    async def n(self): await self.m(1)
'''


def test_python_facts(spark):
    files = spark.createDataFrame([(1, "a.py", SOURCE), (1, "bad.py", "def ("), (1, "n.py", None), (1, "x.java", "class A {}")], "repo_id bigint, path string, content string")
    symbols = [(r["name"], r["kind"], r["parent"]) for r in parsing.python_symbols(files).orderBy("ord").collect()]
    assert symbols == [("top", "function", None), ("local", "function", "top"), ("C", "class", None), ("m", "method", "C"), ("__exit__", "method", "C"), ("n", "method", "C")]
    assert [r["name"] for r in parsing.python_imports(files).orderBy("ord").collect()] == ["os", "os.path", ".", "json", "a.b", "simplejson"]
    assert {(r["name"], r["receiver"]) for r in parsing.python_calls(files).collect()} == {("join", None), ("m", "self")}
    assert {(r["symbol"], r["params"]) for r in parsing.unused_params(files).collect()} == {("top", "a, args"), ("C.m", "q")}
    assert tuple(parsing.documentation_counts(files).select("module_doc", "n_symbols", "n_documented", "n_comments").first()) == ("Doc of the module.", 6, 1, 1)
    code = parsing.stripped_sources(files).first()["code"]
    assert "Doc" not in code and "note" not in code and "D." not in code and "import inner" in code


def test_java_facts(spark):
    source = "package a.b;\nimport x.Y;\nimport static x.Z.*;\n// import no.No;\n/* import n.N; */\nimport x.Y;\nclass T { U u = new U(\"V\"); T t; public static void main(String[] a) {} }"
    files = spark.createDataFrame([(1, "p/T.java", source), (1, "p/U.java", "class U {}"), (1, "q/e.java", "")], "repo_id bigint, path string, content string")
    assert rows(parsing.java_facts(files))[0] == (1, "p/T.java", "a.b", "x.Y,x.Z", True)
    refs = parsing.java_type_references(files)
    assert {(r["name"], r["n"]) for r in refs.where("path = 'p/T.java'").collect()} == {("Y", 2), ("Z", 1), ("T", 2), ("U", 2), ("String", 1)}
    assert rows(parsing.type_neighbours(refs)) == [(1, "p/T.java", "p/U.java", 2)]


def test_type_questions_follow_the_flows(spark):
    edges = [("A", "B"), ("A", "C"), ("B", "C"), ("ATest", "A"), ("ATest", "C")]
    path = lambda x: f"src/test/{x}.java" if x.endswith("Test") else f"src/{x}.java"
    pairs = spark.createDataFrame([(1, path(a), path(b), 2) for a, b in edges], "repo_id bigint, src string, dst string, n bigint")
    types = overview.type_ranking(pairs)
    assert rows(types) == [(1, "src/A.java", 2, 0, 1), (1, "src/B.java", 1, 1, 2), (1, "src/C.java", 0, 2, 3)]
    flows = spark.createDataFrame([(1, "a::f", 1), (1, "a::g", 2), (2, "b::f", 1)], "repo_id bigint, id string, place int")
    assert rows(overview.flows_and_types(flows, types)) == [(1, "a::f", 1), (1, "a::g", 2), (1, "src/A.java", 3), (1, "src/B.java", 4), (1, "src/C.java", 5), (2, "b::f", 1)]


def test_every_call_has_its_enclosing_symbol(spark, tmp_path):
    from strataloom.plans import search

    code = "import a\na.start()\nclass K:\n    def m(self):\n        return g(1)\ndef g(x):\n    return a.b(x)\n"
    spark.createDataFrame([(1, 1, "k.py", code)], "file_id bigint, repo_id bigint, path string, content string").write.parquet(str(tmp_path / "source_files.parquet"))
    chunks = [(1, "K", "class", 3, 5), (2, "K.m", "method", 4, 5), (3, "g", "function", 6, 7)]
    spark.createDataFrame([(i, 1, "k.py", s, k, a, b) for i, s, k, a, b in chunks], "chunk_id bigint, repo_id bigint, file string, symbol string, kind string, start_line int, end_line int").write.parquet(str(tmp_path / "chunks.parquet"))
    assert [(r["line"], r["name"], r["symbol"]) for r in sorted(search.enclosing_calls(spark, str(tmp_path)).collect(), key=lambda r: r["line"])] == [(2, "start", None), (5, "g", "K.m"), (7, "b", "g")]
