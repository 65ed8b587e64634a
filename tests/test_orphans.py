from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataloom.operators import orphans

T = datetime
ROW = "id bigint, {} bigint, loaded_at timestamp, ref_table string"


def _tables(spark, questions=(), answers=(), claims=(), asks=(), deleted=()):
    make = lambda rows, column: spark.createDataFrame(list(rows), ROW.format(column))
    tables = {"questions": make([(i, None, t, "x") for i, t in questions], "other"), "answers": make([(*r, "x") for r in answers], "question_id"), "claims": make([(*r, "x") for r in claims], "answer_id"), "asks": make([(*r, "x") for r in asks], "parent_id")}
    return tables, spark.createDataFrame(list(deleted), "rec_table string, rec_id bigint, deleted_at timestamp")


def _run(spark, **rows):
    return sorted(tuple(r) for r in orphans.orphan_references(*_tables(spark, **rows)).collect())


@pytest.mark.parametrize("limit", [0, orphans.BROADCAST_BYTES])
def test_reasons_in_order(spark, monkeypatch, limit):
    """The same whether the filters are broadcast or, being larger than the limit, met by a shuffle."""
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", limit)
    d = lambda day: T(2025, 3, day)
    found = _run(
        spark,
        questions=[(1, d(1)), (2, d(9)), (3, d(1)), (4, d(1)), (4, d(20))],
        answers=[(10, 1, d(2)), (11, 2, d(5)), (12, 3, d(5)), (13, 99, d(5)), (13, 99, d(3)), (14, None, d(5)), (15, 4, d(6)), (16, 98, d(6)), (None, 1, d(1)), (17, 1, None)],
        deleted=[("questions", 3, d(4)), ("questions", 4, d(10)), ("questions", 98, d(1)), ("asks", 1, d(1)), (None, None, None)],
    )
    # 2 came later, 3 was deleted, 4 came back after its deletion, 98 is gone and logged, 99 was never there.
    assert found == [("answers", 11, "late", "2025-03"), ("answers", 12, "deleted", "2025-03"), ("answers", 13, "missing", "2025-03"), ("answers", 16, "deleted", "2025-03")]


def test_extra_columns_and_empty_tables(spark):
    assert _run(spark) == []
    assert _run(spark, asks=[(1, 1, T(2025, 1, 1)), (2, 7, None)]) == [("asks", 2, "missing", None)]


@pytest.mark.parametrize("n_keys", [3, 5000, 300_000])
def test_filter_stays_as_sharp_at_every_size(spark, n_keys):
    """No key is lost, and false positives stay below 5 %, at any number of keys and with repeated rows."""
    key = lambda n: F.concat(F.lit("t"), F.col("id").cast("string")).alias("key")
    keys = spark.range(n_keys).select(key(0))
    bloom = orphans.bloom_filter(keys.unionByName(keys), "key")
    assert bloom.segments * 64 * orphans.SEGMENT_BLOCKS >= 0.8 * orphans.BITS_A_KEY * n_keys
    assert orphans.split_by_filter(keys, bloom).where("not may_exist").count() == 0
    others = spark.range(1 << 40, (1 << 40) + 20_000).select(key(0))
    assert orphans.split_by_filter(others, bloom).where("may_exist").count() < 1000
    nulls = spark.sql("select cast(null as string) as key")
    assert orphans.split_by_filter(nulls, bloom).count() == 1


def test_empty_filter_proves_everything_missing(spark):
    none = spark.range(0).selectExpr("cast(id as string) as key")
    some = spark.range(5).selectExpr("cast(id as string) as key")
    assert orphans.split_by_filter(some, orphans.bloom_filter(none, "key")).where("may_exist").count() == 0


def test_report_counts(spark):
    found = orphans.orphan_references(*_tables(spark, answers=[(1, 5, T(2025, 1, 1)), (2, 6, T(2025, 1, 2)), (3, 6, T(2025, 2, 2))]))
    assert sorted(tuple(r) for r in orphans.orphan_report(found).collect()) == [("answers", "missing", "2025-01", 2), ("answers", "missing", "2025-02", 1)]
