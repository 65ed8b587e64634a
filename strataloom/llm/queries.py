"""Registered queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import credentials, function_docs, packing, pair_defects, shared_spans, source_syntax, tokens
from strataloom.sources.tables import table


_PAIR = ["pair_table", "id"]


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    profiles = pair_defects.learn_profiles(table(spark, folder, "documents"))
    return pair_defects.label_pairs(pair_defects.record_pairs(table(spark, folder, "asks"), table(spark, folder, "answers")), _PAIR, profiles)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.main_defect(_labelled(spark, folder), _PAIR)


def p1_labels(spark: SparkSession, folder: str) -> DataFrame:
    """All labels above their cutoffs, one row each, with the posterior."""
    each = _labelled(spark, folder).select(*_PAIR, F.explode("labels").alias("defect"), "posteriors")
    return each.select(*_PAIR, "defect", F.round(F.element_at("posteriors", F.col("defect")), 6).alias("posterior"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs whose description the language itself takes; the links decide, this check follows."""
    return function_docs.function_pairs(table(spark, folder, "chunks")).where("is_official").select("chunk_id").distinct()


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return function_docs.function_pairs(table(spark, folder, "chunks")).dropDuplicates(["chunk_id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return source_syntax.invalid_files(table(spark, folder, "source_files")).select("file_id").distinct()


def p4_causes(spark: SparkSession, folder: str) -> DataFrame:
    return source_syntax.invalid_files(table(spark, folder, "source_files"))


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files")
    return source_syntax.invalid_rates(files, source_syntax.invalid_files(files))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.embedded_credentials(table(spark, folder, "chunks"))
    return found.select("chunk_id", F.explode("line_nos").alias("line_no")).distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.embedded_credentials(table(spark, folder, "chunks")).select("chunk_id", "redacted").distinct()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_words(table(spark, folder, "documents"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, folder, "documents"))


QUERIES = {
    "p4_found": p4_found, "p4_causes": p4_causes, "p4_rates": p4_rates,
    "p5_found": p5_found, "p5_redacted": p5_redacted,
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p1_found": p1_found, "p1_labels": p1_labels, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_found": p9_found, "p9_spans": p9_spans}
# Every run of 40 words of every document, by its digest: the same result without anchors.
_SHARED = r"""
with w as (select doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') as ws from documents where doc_id is not null and text is not null),
g as (select doc_id, i as pos, md5(array_to_string(ws[i:i + 39], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 38)) as i from w where len(ws) >= 40)),
p as (select distinct doc_id, pos from g where h in (select h from g group by h having count(distinct doc_id) > 1)),"""
ORACLES: dict[str, str] = {
    "p9_found": _SHARED + """
c as (select doc_id, least(40, coalesce(pos - lag(pos) over (partition by doc_id order by pos), 40)) as n from p)
select doc_id, cast(sum(n) as bigint) as n_shared from c group by 1""",
    "p9_spans": _SHARED + """
c as (select doc_id, pos, sum(case when b then 1 else 0 end) over (partition by doc_id order by pos) as stretch
  from (select doc_id, pos, coalesce(pos - lag(pos) over (partition by doc_id order by pos) > 40, true) as b from p))
select doc_id, min(pos) - 1 as first_word, max(pos) - min(pos) + 40 as n_words from c group by doc_id, stretch""",
}
