"""Queries of retrieval, overview, parsing and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import calls, evaluation, overview, parsing, retrieval
from strataloom.operators.overview import ENTRY_FILES, NON_ENTRY
from strataloom.plans import code
from strataloom.plans.code import distinct_chunks
from strataloom.sources.tables import table

_KINDS = "case when label < 4 then 'function' when label < 6 then 'file' when label < 8 then 'doc' else 'config' end"


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every row whose id is divisible by 50) and all rows, with a kind by label."""
    base = table(spark, folder, "embeddings").withColumn("kind", F.expr(_KINDS))
    return base.where("vec_id % 50 = 0"), base


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.vector_topk(*_vectors(spark, folder))


def vector_index_topk(spark: SparkSession, folder: str) -> DataFrame:
    queries, base = _vectors(spark, folder)
    return retrieval.index_topk(queries, base, retrieval.fit_index(base))


def vector_index_recall(spark: SparkSession, folder: str) -> DataFrame:
    """What the index finds of the exact nearest vectors."""
    return retrieval.recall(vector_index_topk(spark, folder), vector_topk(spark, folder))


def vector_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.vector_topk(*_vectors(spark, folder), k=5, keep="kind in ('function', 'doc')")


def kind_quota_union(spark: SparkSession, folder: str) -> DataFrame:
    queries, base = _vectors(spark, folder)
    return retrieval.quota_union(retrieval.vector_topk(queries, base, group="kind"), retrieval.vector_topk(queries, base))


def rerank_pad(spark: SparkSession, folder: str) -> DataFrame:
    """Picks that skip, repeat and overshoot, made valid over the nearest vectors."""
    found = retrieval.vector_topk(*_vectors(spark, folder)).select("query", "rank", F.col("vec_id").alias("item"))
    picks = found.where("rank <= 3").select("query", F.col("rank").alias("pos"), (F.lit(11) - 3 * F.col("rank")).alias("pick"))
    return retrieval.validated_picks(picks, found, 6)


def hit_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """How well the nearest vectors share the query's label."""
    queries, base = _vectors(spark, folder)
    found = retrieval.vector_topk(queries, base)
    gold = queries.select(F.col("vec_id").alias("query"), "label")
    return evaluation.rank_metrics(evaluation.gold_ranks(found.join(base.select("vec_id", "label"), "vec_id"), gold, "label"))


def recall_any_all(spark: SparkSession, folder: str) -> DataFrame:
    """Of the nearest five overall, what a search limited to functions and docs finds among its five."""
    queries, base = _vectors(spark, folder)
    wanted = retrieval.vector_topk(queries, base, k=5).select("query", "vec_id")
    return evaluation.expected_found(retrieval.vector_topk(queries, base, k=5, keep="kind in ('function', 'doc')"), wanted, "vec_id")


def _asks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "asks").dropDuplicates(["id"])


def identifier_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _asks(spark, folder).select("id", F.array_join(retrieval.identifiers(F.col("question")), ",").alias("identifiers"), retrieval.is_identifier_query(F.col("question")).alias("is_identifier"))


def _symbol_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question about every function and method."""
    symbols = distinct_chunks(spark, folder).where("kind in ('function', 'method')")
    return symbols.select(F.col("chunk_id").alias("id"), "repo_id", F.concat(F.lit("Who uses `"), "symbol", F.lit("`?")).alias("question"))


def identifier_count_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.identifier_hits(_symbol_questions(spark, folder), distinct_chunks(spark, folder))


def drop_contained(spark: SparkSession, folder: str) -> DataFrame:
    symbols = distinct_chunks(spark, folder).where("kind in ('class', 'method', 'function')")
    return retrieval.drop_contained(symbols, ["repo_id", "file"]).select("chunk_id")


def mention_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that chunk summaries and codes of kind doc name."""
    docs = distinct_chunks(spark, folder).where("kind = 'doc' or summary is not null").select(F.col("chunk_id").alias("id"), "repo_id", F.concat_ws(" ", "summary", F.when(F.col("kind") == "doc", F.col("code")), "file").alias("body"))
    return retrieval.mentioned_files(docs, table(spark, folder, "source_files"))


def mention_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols that summaries of chunks name."""
    summaries = distinct_chunks(spark, folder).where("summary is not null").select(F.col("chunk_id").alias("id"), "repo_id", F.concat_ws(" ", "summary", "symbol").alias("question"))
    return retrieval.mentioned_symbols(summaries, distinct_chunks(spark, folder))


def search_union_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence for each identifier hit: the hits of a question first, then their files' symbols."""
    chunks = distinct_chunks(spark, folder).select("chunk_id", "repo_id", "file", "kind", "start_line", "end_line")
    hits = retrieval.identifier_hits(_symbol_questions(spark, folder), distinct_chunks(spark, folder)).groupBy(F.col("id").alias("query"), "chunk_id").agg(F.min("rank").alias("rank"))
    first = hits.join(chunks, "chunk_id").withColumn("stage", F.lit(0))
    same = first.select("query", "repo_id", "file").distinct().join(chunks, ["repo_id", "file"]).withColumn("rank", F.col("start_line")).withColumn("stage", F.lit(1))
    columns = ["query", "stage", "rank", "chunk_id", "file", "kind", "start_line", "end_line"]
    return retrieval.union_evidence(first.select(*columns).unionByName(same.select(*columns)), 8)


def overview_totals(spark: SparkSession, folder: str) -> DataFrame:
    return overview.totals(distinct_chunks(spark, folder))


def entry_rank(spark: SparkSession, folder: str) -> DataFrame:
    return overview.entry_points(table(spark, folder, "source_files").where("content is not null"))


def flow_rank(spark: SparkSession, folder: str) -> DataFrame:
    return overview.flow_ranking(calls.stored_edges(distinct_chunks(spark, folder)))


def file_map(spark: SparkSession, folder: str) -> DataFrame:
    return overview.file_map(distinct_chunks(spark, folder))


def file_rank(spark: SparkSession, folder: str) -> DataFrame:
    return overview.file_ranking(distinct_chunks(spark, folder))


def dependency_rank(spark: SparkSession, folder: str) -> DataFrame:
    return overview.dependency_ranking(code.dep_split(spark, folder))


def question_interleave(spark: SparkSession, folder: str) -> DataFrame:
    return overview.interleave(flow_rank(spark, folder), dependency_rank(spark, folder), file_rank(spark, folder))


def type_rank(spark: SparkSession, folder: str) -> DataFrame:
    indexed = distinct_chunks(spark, folder).where("kind = 'file'").select("repo_id", F.col("file").alias("path")).distinct()
    references = parsing.java_type_references(_files(spark, folder)).join(indexed, ["repo_id", "path"], "left_semi")
    return overview.type_ranking(parsing.type_neighbours(references))


def question_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """`question_interleave` with the type questions in the flow family, after the call flows."""
    flows = overview.flows_and_types(flow_rank(spark, folder), type_rank(spark, folder))
    return overview.interleave(flows, dependency_rank(spark, folder), file_rank(spark, folder))


def enclosing_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every call of the Python files with the innermost symbol around it; null outside of all."""
    every = python_calls(spark, folder).withColumnRenamed("path", "file")
    around = calls.enclosing_symbols(distinct_chunks(spark, folder), every)
    return every.join(around, ["repo_id", "file", "line"], "left").select("repo_id", "file", "line", "receiver", "name", "symbol")


def screen_verdict(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder).where("listing = 'files'")
    return overview.screening(files, parsing.documentation_counts(files))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_files")


def python_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.python_symbols(_files(spark, folder))


def python_imports(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.python_imports(_files(spark, folder))


def python_calls(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.python_calls(_files(spark, folder))


def unused_params(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.unused_params(_files(spark, folder))


def quirk_groups(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.unused_groups(unused_params(spark, folder))


def documentation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.documentation_counts(_files(spark, folder))


def stripped_sources(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.stripped_sources(_files(spark, folder)).select("repo_id", "path", F.sha2("code", 256).alias("code_hash"))


def java_facts(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.java_facts(_files(spark, folder))


def java_type_refs(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.java_type_references(_files(spark, folder))


def type_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.type_neighbours(parsing.java_type_references(_files(spark, folder)))


_E = f"e as (select *, {_KINDS} as kind, embedding::DOUBLE[] as v from embeddings where len(embedding) > 0)"
_PAIRS = "pr as (select a.vec_id as query, b.vec_id, b.kind, b.label, round(1 - list_cosine_similarity(a.v, b.v), 6) as distance from e a, e b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)"
_TOP = "select query, row_number() over (partition by query{g} order by distance, vec_id) as rank, vec_id, distance{c} from pr"
_CH = "ch as (select distinct on (chunk_id) * from chunks)"
_K = "k as (select distinct on (id) * from asks where id is not null)"
_IDENT = "list_filter(list_distinct(regexp_extract_all(question, '([A-Za-z_][A-Za-z0-9_]*)', 1)), lambda t: len(t) >= 2 and (contains(t, '_') or (regexp_matches(t, '[a-z]') and regexp_matches(t, '[A-Z]'))))"
_JAVA = "j as (select repo_id, path, regexp_replace(regexp_replace(content, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\r\\n]*', ' ', 'g') as p from (select distinct on (repo_id, path) repo_id, path, content from source_files where path like '%.java' and content is not null order by repo_id, path, loaded_at desc, file_id desc))"
_REFS = """refs as (select repo_id, path, name, count(*) as n from (select repo_id, path, unnest(regexp_extract_all(regexp_replace(p, '"[^"\\r\\n]*"', '""', 'g'), '\\b([A-Z][A-Za-z0-9_]*)\\b', 1)) as name from j) group by 1, 2, 3)"""
_TEST = "regexp_matches({0}, '(^|/)tests?/|(^|/)test_[^/]*$|(_test|Tests?)(\\.[^./]*)?$')"
_FLOW = f"""se as (select distinct repo_id, src, dst from (select repo_id, file || '::' || symbol as src, unnest(calls) as dst from ch) where src <> dst),
fo as (select repo_id, src as id, count(distinct dst) as n_out from se group by 1, 2), fi as (select repo_id, dst as id, count(distinct src) as n_in from se group by 1, 2),
flow as (select *, row_number() over (partition by repo_id order by n_out + n_in desc, id) as place from (select fo.repo_id, fo.id, n_out, coalesce(n_in, 0) as n_in from fo left join fi on fi.repo_id = fo.repo_id and fi.id = fo.id
  where n_out >= 2 and not regexp_matches(fo.id, '__\\w+__$') and not {_TEST.format("split_part(fo.id, '::', 1)")}))"""
_MAP = """own as (select repo_id, file, min(coalesce(summary, '')) as own from ch where kind = 'file' group by 1, 2),
told as (select repo_id, file, string_agg(case when length(summary) > 0 then '    ' || symbol || ': ' || summary end, chr(10) order by start_line, chunk_id) as told from ch where kind in ('class', 'method', 'function') group by 1, 2),
fmap as (select o.repo_id, o.file, own || case when t.file is null then '' else chr(10) || '  symbols' || coalesce(chr(10) || told, '') end as text from own o left join told t on t.repo_id = o.repo_id and t.file = o.file)"""
_FILES = f"""{_MAP}, mainf as (select repo_id, file from (select *, row_number() over (partition by repo_id order by length(text) desc, file) as r from fmap where not {_TEST.format('file')}) where r = 1),
frank as (select *, row_number() over (partition by repo_id order by n_symbols desc, file) as place from (select c.repo_id, c.file, count(*) as n_symbols from ch c anti join mainf m on m.repo_id = c.repo_id and m.file = c.file
  where kind in ('class', 'method', 'function') and not {_TEST.format('c.file')} group by 1, 2))"""
_DEPS = f"drank as (select repo_id, dep, n_files, row_number() over (partition by repo_id order by n_files desc, dep) as place from ({code.ORACLES['dep_split']}) where source = 'third_party' and dep is not null)"

QUERIES = {f.__name__: f for f in (
    vector_topk, vector_index_topk, vector_index_recall, vector_topk_filtered, kind_quota_union, rerank_pad, hit_at_k, recall_any_all, identifier_extract, identifier_count_topk, drop_contained, mention_files, mention_symbols, search_union_fold,
    overview_totals, entry_rank, flow_rank, file_map, file_rank, dependency_rank, question_interleave, type_rank, question_sequence, enclosing_calls, screen_verdict, python_symbols, python_imports, python_calls, unused_params, quirk_groups, documentation_counts, stripped_sources,
    java_facts, java_type_refs, type_neighbors,
)}
_T8 = f"with {_E}, {_PAIRS}, t as ({_TOP.format(g='', c=', label, kind')})"
_FILTERED = "f5 as (select * from (select query, row_number() over (partition by query order by distance, vec_id) as rank, vec_id, distance from pr where kind in ('function', 'doc')) where rank <= 5)"
ORACLES = {
    "vector_topk": f"{_T8} select query, rank, vec_id, distance from t where rank <= 8",
    "vector_topk_filtered": f"with {_E}, {_PAIRS}, {_FILTERED} select * from f5",
    "kind_quota_union": f"""{_T8}, g as ({_TOP.format(g=', kind', c=', kind')}), s as (select query, vec_id, 0 as stage, rank from t where rank <= 4 union all select query, vec_id, 1, rank from g where kind = 'file' and rank <= 2
      union all select query, vec_id, 2, rank from g where kind = 'doc' and rank <= 1 union all select query, vec_id, 3, rank from g where kind = 'config' and rank <= 1 union all select query, vec_id, 4, rank from t where rank <= 8),
      o as (select query, vec_id, min(stage * 1000 + rank) as o from s group by 1, 2) select query, place, vec_id from (select query, vec_id, row_number() over (partition by query order by o, vec_id) as place from o) where place <= 8""",
    "rerank_pad": f"""{_T8}, c as (select query, rank, vec_id as item from t where rank <= 8), p as (select query, rank as pos, 11 - 3 * rank as pick from c where rank <= 3),
      o as (select query, item, min(o) as o from (select p.query, c.item, p.pos as o from p join c on c.query = p.query and c.rank = p.pick union all select query, item, 1000 + rank from c) group by 1, 2)
      select query, place, item from (select query, item, row_number() over (partition by query order by o, item) as place from o) where place <= 6""",
    "hit_at_k": f"""{_T8}, g as (select vec_id as query, label from e where vec_id % 50 = 0), r as (select g.query, min(t.rank) as rank from g left join t on t.query = g.query and t.label = g.label and t.rank <= 8 group by 1)
      select count(*) as n, round(avg(case when rank <= 1 then 1.0 else 0 end), 6) as hit_at_1, round(avg(case when rank <= 5 then 1.0 else 0 end), 6) as hit_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr from r""",
    "recall_any_all": f"""{_T8}, {_FILTERED}, x as (select t.query, count(*) as n_expected, count(f5.vec_id) as n_found from t left join f5 on f5.query = t.query and f5.vec_id = t.vec_id where t.rank <= 5 group by 1)
      select *, n_found > 0 as any_found, n_found = n_expected as all_found from x""",
    "identifier_count_topk": f"""with {_CH}, sq as (select chunk_id as id, repo_id, 'Who uses `' || symbol || '`?' as question from ch where kind in ('function', 'method')), a as (select id, repo_id, unnest({_IDENT}) as identifier from sq), w as (select chunk_id, repo_id, identifier, count(*) as n from (select chunk_id, repo_id, unnest(regexp_extract_all(code, '([A-Za-z0-9_]+)', 1)) as identifier from ch where kind <> 'file') group by 1, 2, 3),
      r as (select *, row_number() over (partition by repo_id, identifier order by n desc, chunk_id) as rank from w) select a.id, a.identifier, r.rank, r.chunk_id, r.n from a join r on r.repo_id = a.repo_id and r.identifier = a.identifier where rank <= 3""",
    "drop_contained": f"""with {_CH}, s as (select * from ch where kind in ('class', 'method', 'function')) select chunk_id from s where not exists (select 1 from s o where o.repo_id = s.repo_id and o.file = s.file and o.start_line <= s.start_line and o.end_line >= s.end_line
      and (o.start_line < s.start_line or o.end_line > s.end_line or o.chunk_id < s.chunk_id))""",
    "mention_files": f"""with {_CH}, b as (select chunk_id as id, repo_id, concat_ws(' ', summary, case when kind = 'doc' then code end, file) as body from ch where kind = 'doc' or summary is not null),
      l as (select id, repo_id, regexp_extract_all(body, '([A-Za-z0-9_./-]+\\.(?:py|java|md|json|toml|ya?ml))', 1) as ns from b), n as (select id, repo_id, name, min(pos) as pos from (select id, repo_id, ns[i] as name, i as pos from (select *, unnest(range(1, len(ns) + 1)) as i from l)) group by 1, 2, 3),
      p as (select distinct repo_id, path from source_files), u as (select repo_id, regexp_extract(path, '([^/]*)$', 1) as name, min(path) as path from p group by 1, 2 having count(*) = 1),
      f as (select id, path, min(pos) as pos from (select n.id, p.path, n.pos from n join p on p.repo_id = n.repo_id and p.path = n.name union all select n.id, u.path, n.pos from n join u on u.repo_id = n.repo_id and u.name = n.name) group by 1, 2)
      select id, row_number() over (partition by id order by pos, path) as place, path from f""",
    "mention_symbols": f"""with {_CH}, a as (select distinct chunk_id as id, repo_id, unnest(regexp_extract_all(summary || ' ' || symbol, '([A-Za-z_][A-Za-z0-9_]*)', 1)) as leaf from ch where summary is not null),
      d as (select distinct repo_id, regexp_extract(regexp_replace(symbol, '#\\d+$', ''), '([A-Za-z_]\\w*)$', 1) as leaf from ch where kind in ('class', 'method', 'function')), h as (select a.id, a.leaf from a join d on d.repo_id = a.repo_id and d.leaf = a.leaf)
      select id, leaf as symbol from h where not exists (select 1 from h o where o.id = h.id and contains(o.leaf, h.leaf) and o.leaf <> h.leaf)""",
    "overview_totals": f"""with {_CH} select repo_id, count(*) filter (where kind = 'file') as n_files, cast(coalesce(sum(end_line) filter (where kind = 'file'), 0) as bigint) as n_lines, count(*) filter (where kind in ('class', 'method', 'function')) as n_symbols,
      count(*) filter (where kind in ('class', 'method', 'function') and length(summary) > 0) as n_summarised from ch group by 1""",
    "entry_rank": f"""with f as (select distinct on (repo_id, path) repo_id, path, content, regexp_extract(path, '([^/]*)$', 1) as name from source_files where content is not null order by repo_id, path, loaded_at desc, file_id desc),
      x as (select *, case when path like '%.java' and regexp_matches(content, '\\bstatic\\s+void\\s+main\\s*\\(') then case when contains(content, '@SpringBootApplication') then 'main method, Spring Boot' else 'main method' end when path like '%.py' and contains(content, '__main__') then 'main block'
        when name in ({', '.join(repr(n) for n in ENTRY_FILES)}) then 'file name' end as evidence from f)
      select repo_id, path, evidence, row_number() over (partition by repo_id order by regexp_matches(lower(name), '{'|'.join(NON_ENTRY)}'), contains(path, '/'), path) as place from x where evidence is not null""",
    "flow_rank": f"with {_CH}, {_FLOW} select * from flow",
    "file_map": f"with {_CH}, {_MAP} select * from fmap",
    "file_rank": f"with {_CH}, {_FILES} select * from frank",
    "dependency_rank": f"with {_DEPS} select * from drank",
    "question_interleave": f"""with {_CH}, {_FLOW}, {_FILES}, {_DEPS}, q as (select repo_id, (place - 1) // 2 as cycle, 2 * ((place - 1) % 2) as slot, 'flow' as family, id as item from flow union all select repo_id, place - 1, 1, 'dependency', dep from drank
      union all select repo_id, place - 1, 3, 'file', file from frank), n as (select *, row_number() over (partition by repo_id order by cycle, slot) as number from q) select repo_id, number, (number - 1) // 5 + 2 as set_no, family, item from n""",
    "java_facts": f"""with {_JAVA}, l as (select *, regexp_extract_all(p, '(?m)^[ \\t]*import[ \\t]+(?:static[ \\t]+)?([A-Za-z_][A-Za-z0-9_.]*[A-Za-z0-9_])(?:\\.\\*)?[ \\t]*;', 1) as ns from j),
      i as (select repo_id, path, string_agg(name, ',' order by pos) as imports from (select repo_id, path, name, min(pos) as pos from (select repo_id, path, ns[i] as name, i as pos from (select repo_id, path, ns, unnest(range(1, len(ns) + 1)) as i from l)) group by 1, 2, 3) group by 1, 2)
      select j.repo_id, j.path, nullif(regexp_extract(p, '(?m)^[ \\t]*package[ \\t]+([A-Za-z0-9_.]+)[ \\t]*;', 1), '') as package, coalesce(i.imports, '') as imports, regexp_matches(p, '\\bstatic\\s+void\\s+main\\s*\\(') as is_entry
      from j left join i on i.repo_id = j.repo_id and i.path = j.path""",
    "java_type_refs": f"with {_JAVA}, {_REFS} select * from refs",
    "type_neighbors": f"""with {_JAVA}, {_REFS}, u as (select repo_id, regexp_extract(path, '([^/]*)\\.java$', 1) as name, min(path) as dst from (select distinct repo_id, path from refs) group by 1, 2 having count(*) = 1)
      select r.repo_id, r.path as src, u.dst, r.n from refs r join u on u.repo_id = r.repo_id and u.name = r.name where r.path <> u.dst""",
}
ORACLES["identifier_extract"] = f"""with {_K}, l as (select id, question, regexp_extract_all(question, '([A-Za-z_][A-Za-z0-9_]*)', 1) as ts from k), d as (select id, t, min(i) as i from (select id, ts[i] as t, i from (select id, ts, unnest(range(1, len(ts) + 1)) as i from l)) where len(t) >= 2 and (contains(t, '_') or (regexp_matches(t, '[a-z]') and regexp_matches(t, '[A-Z]'))) group by 1, 2),
  s as (select id, string_agg(t, ',' order by i) as identifiers from d group by 1)
  select k.id, case when k.question is null then '' else coalesce(s.identifiers, '') end as identifiers, regexp_full_match(trim(k.question), '[A-Za-z0-9_]{{2,}}') and (contains(k.question, '_') or (regexp_matches(k.question, '[a-z]') and regexp_matches(k.question, '[A-Z]'))) as is_identifier from k left join s on s.id = k.id"""
