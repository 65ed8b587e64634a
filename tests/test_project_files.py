from datetime import datetime

from strataloom.operators import incremental, project_files, records, text

T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1)


def files(spark, *rows):
    return spark.createDataFrame([(i, 1, p, c, t, "x") for i, (p, c, t) in enumerate(rows)], "file_id bigint, repo_id bigint, path string, content string, loaded_at timestamp, name string")


README = "Before.\n\n  # Shelf **keeper**\nShelf **keeper**\n\nCounts heavy books.\n```\n# no heading\n```\n## Use\n\nRun it.\n### Detail\nMore.\n## Empty\n\n"


def test_sections_of_a_readme(spark):
    df = files(spark, ("README.md", README, T2), ("README.md", "# Old\n", T1), ("a/readme.markdown", "no heading here\n", T1), ("a/README.MD", " \n", T1), ("b/README", "plain", T1), ("c/x.md", "# x", T1), ("d/README.md", None, T1))
    rows = [(r["file"], r["symbol"], r["start_line"], r["end_line"], r["summary"]) for r in project_files.readme_chunks(df).orderBy("file", "start_line").collect()]
    assert rows == [
        ("README.md", "README.md#머리말", 1, 2, "README.md / 머리말 / Before."),
        ("README.md", "README.md#Shelf **keeper**", 3, 9, rows[1][4]),
        ("README.md", "README.md#Use", 10, 14, rows[2][4]),
        ("README.md", "README.md#Empty", 15, 17, "README.md / Empty"),
    ]
    assert rows[1][4].endswith("Counts heavy books.") and "Detail More." in rows[2][4]
    code = {r["symbol"]: r["code"] for r in project_files.readme_chunks(df).collect()}
    assert code["README.md#Use"] == "README.md\nUse\n\n## Use\n\nRun it.\n### Detail\nMore."
    texts = {r["folder"]: r["path"] for r in project_files.readme_texts(df).collect()}
    assert texts == {"": "README.md", "a": "a/README.MD", "b": "b/README"}
    assert project_files.readme_chunks(df.limit(0)).count() == 0


def test_text_without_headings_is_one_section(spark):
    docs = spark.createDataFrame([(1, "only text\nmore"), (2, ""), (3, None), (4, "\n\n# A\n")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["title"], r["start_line"], r["end_line"]) for r in text.markdown_sections(docs).collect()) == [(1, "README", 1, 2), (4, "A", 3, 4)]


def test_project_settings(spark):
    good = '[project]\nname = "shelf"\nversion = "1.0"\nrequires-python = ">=3.11"\ndependencies = ["a>=1", "b"]\n[project.scripts]\nshelf = "shelf.main:run"\n'
    df = files(spark, ("pyproject.toml", good, T1), ("x/pyproject.toml", "[project", T1), ("y/pyproject.toml", "[tool]\na = 1\n", T1), ("other.toml", good, T1), ("z/pyproject.toml", '[project]\nname = 3\ndependencies = "a"\nscripts = []\n', T1), ("w/pyproject.toml", None, T1))
    rows = {r["path"]: r for r in project_files.project_facts(df).collect()}
    assert set(rows) == {"pyproject.toml", "y/pyproject.toml", "z/pyproject.toml"} and rows["pyproject.toml"]["dependencies"] == ["a>=1", "b"]
    assert rows["y/pyproject.toml"]["name"] is None and rows["z/pyproject.toml"]["dependencies"] == [] and rows["z/pyproject.toml"]["name"] is None
    assert [tuple(r) for r in project_files.project_scripts(project_files.project_facts(df)).collect()] == [(1, "pyproject.toml", "shelf", "shelf.main:run")]
    told = {r["file"]: (r["summary"], r["end_line"]) for r in project_files.config_chunks(df).collect()}
    assert told["pyproject.toml"] == ("pyproject.toml / commands: shelf -> shelf.main:run / name: shelf / version: 1.0 / python: >=3.11 / dependencies: a>=1, b", 7)
    assert project_files.project_facts(df.limit(0)).count() == 0


def test_pending_entries_are_used_before_committed_ones(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "repo_id bigint, path string, hash string")
    committed, pending = make((1, "a", "1"), (1, "b", "1"), (1, "gone", "1")), make((1, "b", "2"))
    staged = incremental.stage(pending, make((1, "b", "3"), (1, "c", "1")))
    found = {r["path"]: r["source"] for r in incremental.reusable(committed, staged, make((1, "a", "1"), (1, "b", "3"), (1, "c", "9"), (1, "d", "1"))).collect()}
    assert found == {"a": "committed", "b": "pending", "c": "new", "d": "new"}
    assert {(r["path"], r["hash"]) for r in incremental.commit(committed, staged).collect()} == {("a", "1"), ("b", "3"), ("c", "1"), ("gone", "1")}


def test_inserts_are_numbered_after_what_is_there(spark):
    known = spark.createDataFrame([(4, "a"), (9, "b")], "id bigint, path string")
    names = spark.createDataFrame([("c",), ("a",), ("c",), (None,), ("0",)], "path string")
    assert sorted((r["id"], r["path"]) for r in records.get_or_create(known, names).collect()) == [(4, "a"), (9, "b"), (10, "0"), (11, "c")]
    assert [(r["id"], r["path"]) for r in records.get_or_create(known.limit(0), names.limit(1)).collect()] == [(1, "c")]


def test_answered_questions_by_text(spark):
    questions = spark.createDataFrame([(1, 1, "why"), (2, 2, "why"), (3, 1, None)], "id bigint, repo_id bigint, text string")
    answers = spark.createDataFrame([(1, "why"), (1, "why"), (1, None)], "repo_id bigint, question_text string")
    assert {r["id"]: r["answered"] for r in records.mark_answered(questions, answers).collect()} == {1: True, 2: False, 3: False}
