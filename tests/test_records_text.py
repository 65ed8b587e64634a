from datetime import datetime

from strataloom.operators import incremental, records, text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


T = lambda d: datetime(2025, 1, d)


def test_latest_and_deleted(spark):
    df = spark.createDataFrame([(1, T(1), "a"), (1, T(2), "b"), (2, None, "c"), (2, T(1), "d"), (None, T(1), "x"), (3, T(5), "e"), (3, T(5), "e")], "id bigint, loaded_at timestamp, v string")
    assert rows(records.latest(df)) == [(1, T(2), "b"), (2, T(1), "d"), (3, T(5), "e")]
    log = spark.createDataFrame([("t", 1, T(1)), ("t", 3, T(5)), ("u", 2, T(9))], "rec_table string, rec_id bigint, deleted_at timestamp")
    assert [r[0] for r in rows(records.without_deleted(records.latest(df), log, "t"))] == [1, 2]


def test_tally_and_claims(spark):
    answers = spark.createDataFrame([(1, 7), (2, 8)], "id bigint, repo_id bigint")
    claims = spark.createDataFrame(
        [(1, 1, "confirmed", True, "f::a"), (2, 1, "contradicted", False, "f::a"), (3, 1, "unverifiable", None, "f::b"), (4, 1, "contradicted", True, None), (5, 2, "unverifiable", True, None), (6, 99, "confirmed", False, None)],
        "id bigint, answer_id bigint, verdict string, hedged boolean, evidence string")
    assert rows(records.tally(answers, claims)) == [(7, 1, 2, 1, 0.666667), (8, 0, 0, 1, None)]
    assert rows(records.repeated_claims(answers, claims)) == [(7, "f", 2)]
    assert rows(records.claims_of_answers(claims))[0] == (1, 4, 2, "confirmed,contradicted,unverifiable,contradicted")


def test_chain_stops_at_the_limit_and_in_cycles(spark):
    asks = spark.createDataFrame([(1, None, "q1", "a1"), (2, 1, "q2", "a2"), (3, 2, "q3", "a3"), (4, 5, "x", None), (5, 4, "y", None)], "id bigint, parent_id bigint, question string, answer string")
    chain = records.ask_chain(asks, asks["id"].isin(3, 4), hops=3)
    assert rows(chain) == [(3, 1, 2), (3, 2, 1), (4, 1, 5), (4, 2, 4), (4, 3, 5)]
    assert dict(rows(records.history_text(asks, chain.where("start = 3")))) == {3: "Q: q1\nQ: q2\nA: a2"}


def test_parse_feedback(spark):
    raw = spark.createDataFrame([
        (1, 'Sure: {"specificity": 2.9, "calibration": "1.5", "groundedness": true, "claims": [{"claim": "c", "verdict": "maybe"}, {"claim": "d", "verdict": "confirmed", "hedged": true}], "verdict_line": "v"} ok'),
        (2, "no json"), (3, "{broken"), (4, None), (5, '{"specificity": -4, "calibration": 9}')], "id bigint, raw string")
    found = {r["id"]: r for r in records.parse_feedback(raw).collect()}
    assert (found[1]["specificity"], found[1]["groundedness"], found[1]["valid"]) == (2, 1, True)
    assert [(c["verdict"], c["hedged"]) for c in found[1]["verdicts"]] == [("unverifiable", False), ("confirmed", True)]
    assert [(found[i]["valid"], found[i]["specificity"], len(found[i]["verdicts"])) for i in (2, 3, 4)] == [(False, 0, 0)] * 3
    assert (found[5]["specificity"], found[5]["calibration"]) == (0, 2)


def test_numbering_and_newest(spark):
    q = spark.createDataFrame([(i, 1, i) for i in range(1, 8)], "id bigint, repo_id bigint, ordinal int")
    assert rows(records.numbered_questions(q))[4:6] == [(5, 1, 5, 1), (6, 1, 6, 2)]
    asks = spark.createDataFrame([(1, 1, "2025-01-01T00:00:00+00:00"), (2, 1, "2025-01-01 01:00:00"), (3, 1, "2025-01-01T00:30:00Z"), (4, 1, "bad")], "id bigint, repo_id bigint, created_at string")
    assert [r[2] for r in rows(records.newest_asks(asks, 2))] == [2, 3]


FILES = "repo_id bigint, path string, content string, loaded_at timestamp, file_id bigint"


def test_incremental(spark):
    old = incremental.manifest(spark.createDataFrame([(1, "a", "x", T(1), 1), (1, "b", "y", T(1), 2), (1, "c", "z", T(1), 3)], FILES))
    now = incremental.manifest(spark.createDataFrame([(1, "a", "x", T(1), 1), (1, "b", "y2", T(2), 2), (1, "d", "w", T(1), 4), (1, "b", "y1", T(1), 9), (1, "e", None, T(1), 5)], FILES))
    assert rows(incremental.changed_files(old, now)) == [(1, "a", "same"), (1, "b", "changed"), (1, "c", "removed"), (1, "d", "added")]
    assert len(rows(incremental.upsert(old, now, ["repo_id", "path"]))) == 4
    stored = spark.createDataFrame([(1, 1, "a"), (2, 1, "zz")], "chunk_id bigint, repo_id bigint, path string")
    assert rows(incremental.prune(stored, now, ["repo_id", "path"])) == [(1, 1, "a")]
    assert len(rows(incremental.prune(stored, now.limit(0), ["repo_id", "path"]))) == 2


def test_restore(spark):
    files = spark.createDataFrame([(1, "f", "l1\nl2\nl3", T(1), 1)], FILES)
    chunks = spark.createDataFrame([(1, 1, "f", 1, 2, "l1\nl2"), (2, 1, "f", 2, 3, "old"), (3, 1, "f", 3, 4, "l3"), (4, 1, "g", 1, 1, "")], "chunk_id bigint, repo_id bigint, file string, start_line int, end_line int, code string")
    assert [r[:2] for r in rows(incremental.restore(chunks, files))] == [(1, "fresh"), (2, "stale"), (3, "beyond"), (4, "gone")]


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\ntext\n```\n# not a heading\n```\n## Two\n### no cut\nend"), (2, "no heading"), (3, None), (4, ""), (5, "\n\n# Only\n")], "doc_id bigint, text string")
    assert rows(text.markdown_sections(docs)) == [(1, 0, "머리말", 1, 1), (1, 1, "One", 2, 6), (1, 2, "Two", 7, 9), (2, 0, "README", 1, 1), (5, 1, "Only", 3, 4)]
    words = dict(rows(text.section_keywords(docs, budget=10)))
    assert words[1] == "intro text" and words[2] == "no heading" and 3 not in words


def test_assembly(spark):
    chunks = spark.createDataFrame([(1, 1, "f", "A", "class", 1, None, "sa"), (2, 1, "f", "A.m", "method", 2, "A", ""), (3, 1, "f", "g", "function", 5, None, None), (4, 1, "f", "g", "function", 9, None, "sg"), (5, 1, "f", "g.h", "function", 6, "g", "no")],
                                   "chunk_id bigint, repo_id bigint, file string, symbol string, kind string, start_line int, parent string, summary string")
    assert dict(rows(text.occurrence_numbers(chunks)))[4] == "g#2"
    assert rows(text.file_chunks(chunks)) == [(1, "f", 4, "A, A.m, g, g\nsa / sg")]
    many = spark.createDataFrame([(1, f"n{i}") for i in range(8)] + [(2, "x")], "repo_id bigint, symbol string")
    assert dict(rows(text.names_line(many, ["repo_id"], "symbol"))) == {1: "n0, n1, n2, n3, n4, n5 and 2 more", 2: "x"}


def test_ranks_within_hot_groups(spark):
    from pyspark.sql import functions as F

    from strataloom.functions.windows import rank_within

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), (F.col("id") * 7919 % 3001).alias("v"), "id").repartition(7)
    got = rank_within(df, ["g"], [F.desc("v"), "id"], "n").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((-r["v"], r["id"], r["n"]))
    assert len(got) == 3000 and all([x[2] for x in sorted(g)] == list(range(1, len(g) + 1)) for g in groups.values())
    assert rank_within(df.limit(0), ["g"], ["id"], "n").count() == 0


def test_keywords_of_every_section(spark):
    long = "\n".join(f"word{i:03d} of the text" for i in range(40))
    docs = spark.createDataFrame([(1, f"# One\nOne\n![badge](x)\n🚧 WIP\n{long}\n## Two\r\n```\n# not a heading\n```\n### Sub-heading\n- **bold** | cell\n|---|:--|\n> quoted\nTwo"), (2, "intro\n\n# Only\n"), (3, None), (4, "")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["section"]): (r["title"], r["keywords"]) for r in text.keywords_by_section(docs).collect()}
    assert found[1, 1] == ("One", long.replace("\n", " ")[:200])
    assert found[1, 2] == ("Two", "Sub-heading bold   cell quoted Two")
    assert found[2, 0] == ("머리말", "intro") and found[2, 1] == ("Only", "") and len(found) == 4
