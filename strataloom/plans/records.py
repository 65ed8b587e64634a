"""Queries over the record tables, incremental indexing and text assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import incremental, overview, project_files, records, text
from strataloom.plans.code import distinct_chunks
from strataloom.sources.tables import table


def _rec(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name).where("id is not null").dropDuplicates(["id"])


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    return records.latest(table(spark, folder, "answers")).select("id", "loaded_at")


def prune_deleted(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.latest(table(spark, folder, "questions"))
    return records.without_deleted(rows, table(spark, folder, "deleted_records"), "questions").select("id", "repo_id")


def verdict_summary(spark: SparkSession, folder: str) -> DataFrame:
    return records.verdict_summary(_rec(spark, folder, "claims"))


def tally(spark: SparkSession, folder: str) -> DataFrame:
    return records.tally(_rec(spark, folder, "answers"), _rec(spark, folder, "claims"))


def repeated_assertions(spark: SparkSession, folder: str) -> DataFrame:
    return records.repeated_claims(_rec(spark, folder, "answers"), _rec(spark, folder, "claims"))


def claims_for(spark: SparkSession, folder: str) -> DataFrame:
    return records.claims_of_answers(_rec(spark, folder, "claims"))


def score_total(spark: SparkSession, folder: str) -> DataFrame:
    return records.scored_answers(_rec(spark, folder, "answers"))


def answered_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return records.answered_questions(_rec(spark, folder, "questions"), _rec(spark, folder, "answers"))


def answered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return _rec(spark, folder, "answers").where("question_id is not null").select("repo_id", "question_text").distinct()


def list_asks_parent(spark: SparkSession, folder: str) -> DataFrame:
    return records.asks_with_parent(_rec(spark, folder, "asks"))


def ask_chain(spark: SparkSession, folder: str) -> DataFrame:
    return records.ask_chain(_rec(spark, folder, "asks"), F.lit(True))


def history_text(spark: SparkSession, folder: str) -> DataFrame:
    asks = _rec(spark, folder, "asks")
    return records.history_text(asks, records.ask_chain(asks, F.lit(True)))


def question_sets(spark: SparkSession, folder: str) -> DataFrame:
    return records.numbered_questions(_rec(spark, folder, "questions"))


def newest_asks(spark: SparkSession, folder: str) -> DataFrame:
    return records.newest_asks(_rec(spark, folder, "asks"))


def feedback_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Answers written as the JSON of a grader, and read again."""
    answers = _rec(spark, folder, "answers")
    raw = answers.select("id", F.concat(F.lit("Result: "), F.to_json(F.struct("specificity", "calibration", "groundedness", "verdict_line")), F.when(F.col("id") % 7 == 0, "").otherwise(" end")).alias("raw"))
    parsed = records.parse_feedback(raw)
    return parsed.select("id", "valid", F.col("specificity").cast("bigint").alias("specificity"), F.col("calibration").cast("bigint").alias("calibration"), F.col("groundedness").cast("bigint").alias("groundedness"), "verdict_line")


_CUT = "2025-09-01"
_STAGED = (_CUT, "2025-10-01", "2025-11-01")


def _manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, folder, "source_files")
    return incremental.manifest(files.where(f"loaded_at < timestamp '{_CUT}'")), incremental.manifest(files)


def manifest_hash(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.manifest(table(spark, folder, "source_files"))


def hash_changed(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.changed_files(*_manifests(spark, folder))


def cache_apply(spark: SparkSession, folder: str) -> DataFrame:
    chunks = distinct_chunks(spark, folder)
    return incremental.reuse_summaries(chunks.withColumn("summary", F.lit(None).cast("string")), chunks, *_manifests(spark, folder))


def manifest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.upsert(*_manifests(spark, folder), ["repo_id", "path"])


def prune_stale(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "source_files").where("listing = 'files'").select("repo_id", F.col("path").alias("file"))
    return incremental.prune(distinct_chunks(spark, folder).select("chunk_id", "repo_id", "file"), kept, ["repo_id", "file"])


def stale_restore(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.restore(distinct_chunks(spark, folder), table(spark, folder, "source_files")).select("chunk_id", "state", F.sha2("code", 256).alias("code_hash"))


def manifest_resume(spark: SparkSession, folder: str) -> DataFrame:
    """A run over the files of before was committed; a later one staged two months of new files and was cut off."""
    files = table(spark, folder, "source_files")
    before, now = _manifests(spark, folder)
    months = [incremental.manifest(files.where(f"loaded_at >= timestamp '{a}' and loaded_at < timestamp '{b}'")) for a, b in zip(_STAGED, _STAGED[1:])]
    return incremental.reusable(before, incremental.stage(*months), now)


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files")
    return overview.index_stats(distinct_chunks(spark, folder), incremental.manifest(files), files.where("listing = 'files'"))


def questions_answered(spark: SparkSession, folder: str) -> DataFrame:
    return records.mark_answered(_rec(spark, folder, "questions"), _rec(spark, folder, "answers"))


def repo_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all repositories that documents name, where only those created before 2024-07 were known."""
    known = table(spark, folder, "repos").where("created_at < '2024-07'").select("id", "path")
    return records.get_or_create(known, table(spark, folder, "documents").select(F.col("source").alias("path")))


def readme_sections(spark: SparkSession, folder: str) -> DataFrame:
    found = project_files.readme_chunks(table(spark, folder, "source_files"))
    return found.select("repo_id", "file", "symbol", "title", "start_line", "end_line", "summary", F.sha2("code", 256).alias("code_hash"))


def readme_first(spark: SparkSession, folder: str) -> DataFrame:
    return project_files.readme_texts(table(spark, folder, "source_files")).select("repo_id", "folder", "path", F.sha2("text", 256).alias("text_hash"))


def project_settings(spark: SparkSession, folder: str) -> DataFrame:
    """What every TOML file with settings says of its project."""
    found = project_files.config_chunks(table(spark, folder, "source_files"), r"\.toml$")
    return found.select("repo_id", "file", "kind", "start_line", "end_line", "summary", F.sha2("code", 256).alias("code_hash"))


def md_sections(spark: SparkSession, folder: str) -> DataFrame:
    return text.markdown_sections(table(spark, folder, "documents"))


def section_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return text.section_keywords(table(spark, folder, "documents"))


def keywords_by_section(spark: SparkSession, folder: str) -> DataFrame:
    return text.keywords_by_section(table(spark, folder, "documents"))


def occurrence_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return text.occurrence_numbers(distinct_chunks(spark, folder))


def file_chunk_assemble(spark: SparkSession, folder: str) -> DataFrame:
    return text.file_chunks(distinct_chunks(spark, folder))


def embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    return text.embedding_text(distinct_chunks(spark, folder)).select("chunk_id", F.sha2("text", 256).alias("text_hash"))


def chunk_locations(spark: SparkSession, folder: str) -> DataFrame:
    return text.context_block(distinct_chunks(spark, folder))


def names_line(spark: SparkSession, folder: str) -> DataFrame:
    return text.names_line(distinct_chunks(spark, folder).where("kind = 'class'"), ["repo_id"], "symbol")


_D = {t: f"{t[0]} as (select distinct on (id) * from {t} where id is not null)" for t in ("questions", "answers", "claims")} | {"asks": "k as (select distinct on (id) * from asks where id is not null)"}
_CH = "ch as (select distinct on (chunk_id) * from chunks)"
_CLAMP = "coalesce(least(2, greatest(0, cast(trunc(try_cast({0} as double)) as int))), 0)"
_RISK = "verdict in ('contradicted', 'unverifiable') and not coalesce(hedged, false)"
_MAN = """{0} as (select repo_id, path, sha256(content) as hash from (select repo_id, path, content, row_number() over (partition by repo_id, path order by loaded_at desc, file_id desc) as r
  from source_files where content is not null and {1}) where r = 1)"""
_MANS = _MAN.format("old", f"loaded_at < timestamp '{_CUT}'") + ", " + _MAN.format("now_", "true")
_DIFF = "diff as (select coalesce(old.repo_id, now_.repo_id) as repo_id, coalesce(old.path, now_.path) as path, case when old.hash is null then 'added' when now_.hash is null then 'removed' when old.hash <> now_.hash then 'changed' else 'same' end as change from old full join now_ on old.repo_id = now_.repo_id and old.path = now_.path)"
_CHAIN = """chain(start, hop, id) as (select e.id, 1, p.id from k e join k p on p.id = e.parent_id
  union all select c.start, c.hop + 1, p.id from chain c join k e on e.id = c.id join k p on p.id = e.parent_id where c.hop < 4)"""
_LINES = "lines as (select doc_id, i - 1 as pos, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split_regex(text, '\\r?\\n') as ls from documents where length(text) > 0)))"
_FENCED = "fenced as (select *, sum(case when regexp_matches(line, '^\\s*```') then 1 else 0 end) over (partition by doc_id order by pos) as fences from lines)"

QUERIES = {f.__name__: f for f in (
    upsert_latest, prune_deleted, verdict_summary, tally, repeated_assertions, claims_for, score_total, answered_attempts, answered_distinct, list_asks_parent, ask_chain, history_text, question_sets, newest_asks, feedback_parse,
    manifest_hash, hash_changed, cache_apply, manifest_upsert, prune_stale, stale_restore, manifest_resume, index_stats, questions_answered, repo_ids, readme_sections, readme_first, project_settings, md_sections, section_keywords, keywords_by_section, occurrence_suffix, file_chunk_assemble, embedding_text, chunk_locations, names_line,
)}
ORACLES = {
    "upsert_latest": "select id, max(loaded_at) as loaded_at from answers where id is not null group by 1",
    "prune_deleted": """with l as (select id, max(loaded_at) as loaded_at, any_value(repo_id) as repo_id from questions where id is not null group by 1)
      select l.id, l.repo_id from l left join (select rec_id, max(deleted_at) as d from deleted_records where rec_table = 'questions' group by 1) x on x.rec_id = l.id where d is null or loaded_at > d""",
    "verdict_summary": f"with {_D['claims']} select verdict, hedged, count(*) as n from c group by 1, 2",
    "tally": f"""with {_D['claims']}, {_D['answers']}, j as (select a.repo_id, c.* from c join a on a.id = c.answer_id), s as (select repo_id, count(*) filter (where verdict = 'confirmed') as n_confirmed,
      count(*) filter (where {_RISK}) as n_asserted, count(*) filter (where verdict in ('contradicted', 'unverifiable') and coalesce(hedged, false)) as n_hedged from j group by 1)
      select *, case when n_asserted + n_hedged >= 3 then round(n_asserted / (n_asserted + n_hedged), 6) end as asserted_share from s""",
    "repeated_assertions": f"with {_D['claims']}, {_D['answers']} select a.repo_id, coalesce(split_part(evidence, '::', 1), '') as file, count(*) as n from c join a on a.id = c.answer_id where {_RISK} group by 1, 2 having count(*) > 1",
    "claims_for": f"with {_D['claims']} select answer_id, count(*) as n_claims, count(*) filter (where {_RISK}) as n_risky, string_agg(coalesce(verdict, ''), ',' order by id) as verdicts from c where answer_id is not null group by 1",
    "score_total": f"with {_D['answers']} select id, cast({' + '.join(_CLAMP.format(x) for x in ('specificity', 'calibration', 'groundedness'))} as bigint) as total from a",
    "answered_attempts": f"with {_D['answers']}, {_D['questions']}, s as (select question_id, {' + '.join(_CLAMP.format(x) for x in ('specificity', 'calibration', 'groundedness'))} as total from a where question_id is not null) select question_id, count(*) as n_attempts, cast(max(total) as bigint) as best from s where question_id in (select id from q) group by 1",
    "answered_distinct": f"with {_D['answers']} select distinct repo_id, question_text from a where question_id is not null",
    "list_asks_parent": f"with {_D['asks']} select e.id, e.parent_id, p.question as parent_question from k e left join k p on p.id = e.parent_id",
    "ask_chain": f"with recursive {_D['asks']}, {_CHAIN} select start, hop, id from chain",
    "history_text": f"""with recursive {_D['asks']}, {_CHAIN} select start, string_agg('Q: ' || coalesce(k.question, '') || case when hop = 1 then chr(10) || 'A: ' || coalesce(k.answer, '') else '' end, chr(10) order by hop desc) as text
      from chain join k on k.id = chain.id group by 1""",
    "question_sets": f"with {_D['questions']} select id, repo_id, row_number() over (partition by repo_id order by ordinal nulls first, id) as number, (number - 1) // 5 + 1 as set_no from q",
    "newest_asks": f"""with {_D['asks']}, t as (select id, repo_id, timezone('UTC', try_cast(case when regexp_matches(created_at, '(Z|[+-]\\d\\d:\\d\\d)$') then created_at else created_at || '+00:00' end as timestamptz)) as made from k),
      r as (select *, row_number() over (partition by repo_id order by made desc nulls last, id desc) as rank from t) select repo_id, rank, id from r where rank <= 3""",
    "manifest_hash": f"with {_MAN.format('m', 'true')} select * from m",
    "hash_changed": f"with {_MANS}, {_DIFF} select * from diff",
    "cache_apply": f"""with {_MANS}, {_DIFF}, {_CH}, known as (select repo_id, file, symbol, start_line, min(summary) as cached from ch where summary is not null and summary <> '' group by 1, 2, 3, 4)
      select ch.chunk_id, case when d.path is not null and k.cached is not null then k.cached else '' end as summary, (d.path is not null and k.cached is not null) as reused from ch
      left join (select * from diff where change = 'same') d on d.repo_id = ch.repo_id and d.path = ch.file left join known k on k.repo_id = ch.repo_id and k.file = ch.file and k.symbol = ch.symbol and k.start_line = ch.start_line""",
    "manifest_upsert": f"with {_MANS} select * from now_ union all select old.* from old anti join now_ on old.repo_id = now_.repo_id and old.path = now_.path",
    "prune_stale": f"with {_CH} select chunk_id, repo_id, file from ch where exists (select 1 from source_files s where s.listing = 'files' and s.repo_id = ch.repo_id and s.path = ch.file)",
    "stale_restore": f"""with {_CH}, f as (select repo_id, path, content, row_number() over (partition by repo_id, path order by loaded_at desc, file_id desc) as r from source_files where content is not null),
      j as (select ch.*, f.content, string_split(f.content, chr(10)) as ls from ch left join f on f.repo_id = ch.repo_id and f.path = ch.file and f.r = 1),
      s as (select *, case when content is not null then array_to_string(ls[start_line:end_line], chr(10)) end as cut from j)
      select chunk_id, case when content is null then 'gone' when end_line > len(ls) then 'beyond' when cut = code then 'fresh' else 'stale' end as state, sha256(cut) as code_hash from s""",
    "md_sections": f"""with {_LINES}, {_FENCED}, h as (select *, fences % 2 = 0 and regexp_matches(line, '^[\\s\\v]*##? [\\s\\v]*[^\\s\\v]') as head from fenced),
      n as (select *, sum(head::int) over (partition by doc_id order by pos) as section from h)
      select doc_id, section, coalesce(title, case when last > 0 then '머리말' else 'README' end) as title, start_line, end_line from (select doc_id, cast(section as bigint) as section, max(case when head then trim(regexp_replace(line, '^[\\s\\v]*#+[\\s\\v]*', ''), ' ') end) as title,
        min(pos) + 1 as start_line, max(pos) + 1 as end_line, max(length(trim(line, ' '))) as filled, max(max(section)) over (partition by doc_id) as last from n group by 1, 2) where filled > 0""",
    "manifest_resume": f"""with {_MANS}, {_MAN.format('since', f"loaded_at >= timestamp '{_STAGED[0]}' and loaded_at < timestamp '{_STAGED[-1]}'")}
      select n.repo_id, n.path, case when s.hash = n.hash then 'pending' when o.hash = n.hash then 'committed' else 'new' end as source from now_ n
      left join since s on s.repo_id = n.repo_id and s.path = n.path left join old o on o.repo_id = n.repo_id and o.path = n.path""",
    "index_stats": f"""with {_CH}, {_MAN.format('m', 'true')}, g as (select repo_id, count(*) as n from m where not exists (select 1 from source_files f where f.repo_id = m.repo_id and f.path = m.path and f.listing = 'files') group by 1)
      select c.*, coalesce(g.n, 0) as n_removed from (select repo_id, count(*) filter (where kind = 'file') as n_files, count(*) as n_chunks, count(*) filter (where kind in ('class', 'method', 'function') and length(summary) > 0) as n_summarised from ch group by 1) c left join g on g.repo_id = c.repo_id""",
    "questions_answered": f"with {_D['questions']}, {_D['answers']} select id, exists (select 1 from a where a.repo_id = q.repo_id and a.question_text = q.text) as answered from q",
    "repo_ids": """with k as (select id, path from repos where created_at < '2024-07'), w as (select distinct source as path from documents where source is not null and source not in (select path from k))
      select id, path from k union all select (select coalesce(max(id), 0) from k) + row_number() over (order by path), path from w""",
    "readme_first": """with f as (select distinct on (repo_id, path) repo_id, path, content, regexp_extract(path, '([^/]*)$', 1) as name, regexp_replace(path, '/?[^/]*$', '') as folder from source_files where content is not null order by repo_id, path, loaded_at desc, file_id desc)
      select repo_id, folder, path, sha256(content) as text_hash from (select *, row_number() over (partition by repo_id, folder order by name) as r from f where lower(name) like 'readme%') where r = 1""",
    "section_keywords": f"""with {_LINES}, {_FENCED}, plain as (select doc_id, pos, trim(regexp_replace(line, '[*_`>|-]+', ' ', 'g'), ' ') as line from fenced where fences % 2 = 0 and not regexp_matches(line, '^\\s*(?:```|#|!\\[|\\[!\\[)')),
      kept as (select *, coalesce(sum(length(line)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from plain where line <> '')
      select doc_id, substring(string_agg(line, ' ' order by pos), 1, 200) as keywords from kept where before < 200 group by 1""",
    "occurrence_suffix": f"""with {_CH} select chunk_id, case when r > 1 then base || '#' || r else base end as numbered from (select chunk_id, base, row_number() over (partition by repo_id, file, base order by start_line, chunk_id) as r
      from (select *, regexp_replace(symbol, '#\\d+$', '') as base from ch where kind in ('class', 'method', 'function')))""",
    "file_chunk_assemble": f"""with {_CH}, m as (select * from ch where kind in ('class', 'method', 'function')), p as (select * from m where parent is null or exists (select 1 from m x where x.kind = 'class' and x.repo_id = m.repo_id and x.file = m.file and x.symbol = m.parent))
      select repo_id, file, count(*) as n_symbols, string_agg(symbol, ', ' order by start_line, symbol, coalesce(summary, '')) || coalesce(chr(10) || string_agg(nullif(summary, ''), ' / ' order by start_line, symbol, coalesce(summary, '')), '') as outline from p group by 1, 2""",
    "embedding_text": f"with {_CH} select chunk_id, sha256(concat_ws(chr(10), file, symbol, kind, nullif(summary, ''), code)) as text_hash from ch",
    "chunk_locations": f"with {_CH} select chunk_id, file || ':' || start_line || '-' || end_line || ' ' || symbol as location from ch",
    "names_line": f"""with {_CH}, s as (select repo_id, list_sort(list(distinct symbol)) as l from ch where kind = 'class' group by 1)
      select repo_id, array_to_string(l[1:6], ', ') || case when len(l) > 6 then ' and ' || (len(l) - 6) || ' more' else '' end as line from s""",
    "feedback_parse": f"""with {_D['answers']} select id, true as valid, cast({_CLAMP.format('specificity')} as bigint) as specificity, cast({_CLAMP.format('calibration')} as bigint) as calibration, cast({_CLAMP.format('groundedness')} as bigint) as groundedness, coalesce(verdict_line, '') as verdict_line from a""",
}
