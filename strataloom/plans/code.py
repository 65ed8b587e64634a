"""Queries over source files and chunks: scans, modules, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.names import BUILTINS, STDLIB
from strataloom.operators import calls, imports, indexing, scan
from strataloom.sources.tables import table


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_files")


def distinct_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").dropDuplicates(["chunk_id"])


def scan_classify(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder).select("file_id", "path", "size_bytes").distinct()
    return scan.classify(files).groupBy("status").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def scan_kept(spark: SparkSession, folder: str) -> DataFrame:
    return scan.classify(_files(spark, folder).select("repo_id", "path", "size_bytes").distinct()).where("status = 'kept'").select("repo_id", "path")


def ext_counts(spark: SparkSession, folder: str) -> DataFrame:
    return scan.extension_counts(_files(spark, folder).where("listing = 'skipped_other'"))


def skip_fold(spark: SparkSession, folder: str) -> DataFrame:
    return scan.fold_counts(ext_counts(spark, folder))


def module_unique(spark: SparkSession, folder: str) -> DataFrame:
    return imports.unique_modules(imports.module_entries(_collected(spark, folder)))


def _collected(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).where("listing = 'files'")


def _imports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return imports.file_imports(distinct_chunks(spark, folder)), imports.module_entries(_collected(spark, folder))


def _imports_and_names(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    found, entries = _imports(spark, folder)
    return found, imports.internal_names(entries, imports.package_names(_collected(spark, folder)))


def internal_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return imports.internal_imports(*_imports_and_names(spark, folder))


def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    return imports.import_edges(*_imports(spark, folder))


def dep_split(spark: SparkSession, folder: str) -> DataFrame:
    return imports.dependencies(*_imports_and_names(spark, folder))


def import_totals(spark: SparkSession, folder: str) -> DataFrame:
    return imports.import_totals(*_imports_and_names(spark, folder))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    chunks = distinct_chunks(spark, folder)
    return calls.resolve_calls(calls.call_sites(chunks), calls.definitions(chunks))


def call_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder)


def call_rule_hist(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder).groupBy("rule").agg(F.count("*").alias("n"))


def call_edges(spark: SparkSession, folder: str) -> DataFrame:
    return calls.call_edges(_resolved(spark, folder))


def neighbors_out(spark: SparkSession, folder: str) -> DataFrame:
    return calls.neighbours(call_edges(spark, folder), "out")


def neighbors_in(spark: SparkSession, folder: str) -> DataFrame:
    return calls.neighbours(call_edges(spark, folder), "in")


def callers_of(spark: SparkSession, folder: str) -> DataFrame:
    return calls.callers(calls.stored_edges(distinct_chunks(spark, folder)))


def enclosing_innermost(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols around every line that mentions a ticket."""
    chunks = distinct_chunks(spark, folder)
    whole = chunks.where("kind = 'file'").select("repo_id", "file", F.posexplode(F.split("code", "\n")).alias("pos", "text"))
    points = whole.where(F.col("text").contains("ticket ")).select("repo_id", "file", (F.col("pos") + 1).alias("line"))
    return calls.enclosing_symbols(chunks, points)


def index_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk of the collected files, its code by hash."""
    found = indexing.index_chunks(_collected(spark, folder))
    return found.select("repo_id", "file", "symbol", "kind", "start_line", "end_line", "parent", "id", F.sha2("code", 256).alias("code_hash"))


def index_against_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """repo_id, n_stored and n_same: of the stored symbols of today's Python and Java files those that the index has with the same lines and code."""
    stored = distinct_chunks(spark, folder).where("kind in ('class', 'method', 'function') and code is not null")
    keys = ["repo_id", "file", "start_line", "end_line"]
    stored = stored.select("repo_id", "file", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.sha2("code", 256).alias("code_hash"))
    found = index_chunks(spark, folder).where("kind <> 'file'").select(*keys, "code_hash", F.lit(1).alias("same")).distinct()
    return stored.join(found, [*keys, "code_hash"], "left").groupBy("repo_id").agg(F.count("*").alias("n_stored"), F.count("same").alias("n_same"))


def file_docs(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.file_docs(_collected(spark, folder))


_CLASSIFIED = f"""
classified as (select *, case
  when len(list_filter(string_split(path, '/')[:-2], lambda s: starts_with(s, '.') or s in ({', '.join(repr(x) for x in scan.EXCLUDED)}))) > 0 then 'excluded'
  when not regexp_matches(path, '\\.(py|java)$') then 'skipped_other' when size_bytes > {scan.MAX_BYTES} then 'skipped_by_size' else 'kept' end as status
  from (select distinct file_id, repo_id, path, size_bytes from source_files))"""
_EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.](\\.[^./]+)$', 1))"
_COUNTS = f"counts as (select repo_id, {_EXT} as ext, count(*) as n from (select distinct repo_id, path from source_files where listing = 'skipped_other') group by 1, 2)"
_CHUNKS = "c as (select distinct on (chunk_id) * from chunks)"
# The anchor of a module is the deepest folder above it that has no __init__.py.
_MODULES = """
py as (select distinct repo_id, path, string_split(path, '/') as parts from source_files where listing = 'files' and (path like '%.py' or path like '%.java')),
pk as (select repo_id, regexp_replace(path, '/?__init__\\.py$', '') as folder from py where regexp_matches(path, '(^|/)__init__\\.py$')),
lv as (select repo_id, path, parts, unnest(range(0, len(parts))) as level from py),
an as (select l.repo_id, l.path, any_value(l.parts) as parts, max(l.level) as level from lv l
  left join pk on pk.repo_id = l.repo_id and pk.folder = array_to_string(l.parts[1:l.level], '/') where pk.folder is null group by 1, 2),
mods as (select * from (select repo_id, path, regexp_replace(regexp_replace(array_to_string(parts[level + 1:], '.'), '\\.(py|java)$', ''), '\\.__init__$', '') as module from an) where module <> '__init__'),
uniq as (select repo_id, module, min(path) as path from mods group by 1, 2 having count(*) = 1),
src as (select distinct on (repo_id, path) repo_id, path, content from source_files where listing = 'files' and content is not null and path like '%.java' order by repo_id, path, loaded_at desc, file_id desc),
pack as (select distinct repo_id, regexp_extract(regexp_replace(regexp_replace(content, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\r\\n]*', ' ', 'g'), '(?m)^[ \\t]*package[ \\t]+([A-Za-z0-9_.]+)[ \\t]*;', 1) as module from src),
own as (select repo_id, module from mods union select repo_id, module from pack where module <> ''),
imp as (select distinct repo_id, file, unnest(imports) as name from c where kind = 'file'),
-- An import of Java names a file by its first class.
tgt as (select *, case when file like '%.java' and len(list_filter(ps, lambda p: regexp_matches(p, '^[A-Z]'))) > 0
  then array_to_string(ps[1:list_position(list_transform(ps, lambda p: regexp_matches(p, '^[A-Z]')), true)], '.') else regexp_replace(name, '\\.\\*$', '') end as target from (select *, string_split(name, '.') as ps from imp)),
suf as (select repo_id, file, name, i as pos, array_to_string(string_split(target, '.')[i:], '.') as module
  from (select *, unnest(range(1, len(string_split(target, '.')) + 1)) as i from tgt)),
internal as (select imp.*, (name like '.%' or exists (select 1 from suf s join own m on m.repo_id = s.repo_id and m.module = s.module where s.repo_id = imp.repo_id and s.file = imp.file and s.name = imp.name)) as internal from imp)"""
_CALL = r"(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)\("
_RESOLVED = f"""
site as (select chunk_id, repo_id, file, coalesce(parent, '') as own, imports, file || '::' || regexp_replace(symbol, '#\\d+$', '') as src,
    regexp_extract(call, '^{_CALL}', 1) as receiver, regexp_extract(call, '^{_CALL}', 2) as name
  from (select *, unnest(list_distinct(regexp_extract_all(regexp_replace(code, '(?s)^\\s*(?:async )?def\\s+\\w+\\(', ''), '({_CALL})', 1))) as call
    from c where kind in ('function', 'method') and file like '%.py')),
defs as (select distinct repo_id, regexp_extract(regexp_replace(symbol, '#\\d+$', ''), '([A-Za-z_]\\w*)$', 1) as name, file, coalesce(parent, '') as parent, symbol, file || '::' || regexp_replace(symbol, '#\\d+$', '') as id
  from c where kind in ('class', 'function', 'method') and file like '%.py'),
dr as (select repo_id, name, count(*) n, min(id) id from defs group by all),
df as (select repo_id, name, file, count(*) n, min(id) id from defs group by all),
dc as (select repo_id, name, file, parent, count(*) n, min(id) id from defs group by all),
di as (select w.chunk_id, w.name, count(*) as n, min(d.id) as id from (select distinct chunk_id, repo_id, name, imports from site) w join defs d on d.repo_id = w.repo_id and d.name = w.name
  where len(list_filter(w.imports, lambda i: regexp_replace(d.file, '\\.py$', '') = replace(i, '.', '/') or ends_with(replace(regexp_replace(d.file, '\\.py$', ''), '/', '.'), '.' || split_part(i, '.', -1)) or ends_with(i, replace(regexp_replace(d.file, '\\.py$', ''), '/', '.')))) > 0 group by 1, 2),
res as (select s.chunk_id, s.repo_id, s.src, s.receiver, s.name,
    case when s.name in ({', '.join(repr(b) for b in BUILTINS)}) then 'builtin' when dr.n is null then 'external' when dr.n = 1 then 'unique'
      when s.receiver = 'self' and s.own <> '' and dc.n = 1 then 'same_class' when df.n = 1 then 'same_file' when di.n = 1 then 'import' else 'ambiguous' end as rule,
    case rule when 'unique' then dr.id when 'same_class' then dc.id when 'same_file' then df.id when 'import' then di.id end as dst
  from site s left join dr on dr.repo_id = s.repo_id and dr.name = s.name left join df on df.repo_id = s.repo_id and df.name = s.name and df.file = s.file
  left join dc on dc.repo_id = s.repo_id and dc.name = s.name and dc.file = s.file and dc.parent = s.own left join di on di.chunk_id = s.chunk_id and di.name = s.name),
edges as (select distinct repo_id, src, dst from res where dst is not null and src <> dst)"""
_SIDES = "select repo_id, split_part(src, '::', 1) as a, split_part(dst, '::', 1) as b from edges"

QUERIES = {f.__name__: f for f in (scan_classify, scan_kept, ext_counts, skip_fold, module_unique, internal_suffix, import_edges, dep_split, import_totals, call_resolve, call_rule_hist, call_edges, neighbors_out, neighbors_in, callers_of, enclosing_innermost, index_chunks, index_against_chunks, file_docs)}
ORACLES = {
    "scan_classify": f"with {_CLASSIFIED} select status, count(*) as n_files, cast(sum(size_bytes) as bigint) as n_bytes from (select distinct file_id, path, size_bytes, status from classified) group by 1",
    "scan_kept": f"with {_CLASSIFIED} select distinct repo_id, path from classified where status = 'kept'",
    "ext_counts": f"with {_COUNTS} select * from counts",
    "skip_fold": f"""with {_COUNTS} select repo_id, case when r <= 5 or k = 6 then ext else 'other' end as ext, cast(sum(n) as bigint) as n
      from (select *, row_number() over (partition by repo_id order by n desc, ext) as r, count(*) over (partition by repo_id) as k from counts) group by 1, 2""",
    "module_unique": f"with {_CHUNKS}, {_MODULES} select repo_id, module, path from uniq",
    "internal_suffix": f"with {_CHUNKS}, {_MODULES} select * from internal",
    "import_edges": f"""with {_CHUNKS}, {_MODULES} select distinct repo_id, file as src, dst from (select s.repo_id, s.file, s.name, arg_min(u.path, s.pos) as dst
      from suf s join uniq u on u.repo_id = s.repo_id and u.module = s.module where s.name not like '.%' group by 1, 2, 3) where file <> dst""",
    "dep_split": f"""with {_CHUNKS}, {_MODULES} select repo_id, case when file like '%.java' then case when regexp_matches(name, '^javax?\\.') then regexp_extract(name, '^(javax?)\\.', 1)
        else nullif(regexp_extract(name, '^([a-z_]\\w*(?:\\.[a-z_]\\w*)?)', 1), '') end else split_part(name, '.', 1) end as dep,
      case when file like '%.java' and regexp_matches(name, '^javax?\\.') then 'stdlib' when file not like '%.java' and split_part(name, '.', 1) in ({', '.join(repr(x) for x in sorted(STDLIB))}) then 'stdlib' else 'third_party' end as source,
      count(distinct file) as n_files from internal where not internal group by 1, 2, 3""",
    "import_totals": f"""with {_CHUNKS}, {_MODULES}, d as (select distinct repo_id, case when file like '%.java' then case when regexp_matches(name, '^javax?\\.') then regexp_extract(name, '^(javax?)\\.', 1)
        else nullif(regexp_extract(name, '^([a-z_]\\w*(?:\\.[a-z_]\\w*)?)', 1), '') end else split_part(name, '.', 1) end as dep,
        case when file like '%.java' and regexp_matches(name, '^javax?\\.') then 'stdlib' when file not like '%.java' and split_part(name, '.', 1) in ({', '.join(repr(x) for x in sorted(STDLIB))}) then 'stdlib' else 'third_party' end as source from internal where not internal)
      select i.repo_id, i.n_internal, coalesce(d.t, 0) as n_third_party, coalesce(d.s, 0) as n_stdlib from (select repo_id, count(*) filter (where internal) as n_internal from internal group by 1) i
      left join (select repo_id, count(*) filter (where source = 'third_party') as t, count(*) filter (where source = 'stdlib') as s from d group by 1) d on d.repo_id = i.repo_id""",
    "index_against_chunks": f"""with {_CHUNKS}, l as (select distinct on (repo_id, path) repo_id, path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) as ls from source_files
        where listing = 'files' and content is not null and regexp_matches(path, '\\.(py|java)$') order by repo_id, path, loaded_at desc, file_id desc)
      select c.repo_id, count(*) as n_stored, count(*) filter (where array_to_string(l.ls[c.start_line:c.end_line], chr(10)) = c.code) as n_same from c left join l on l.repo_id = c.repo_id and l.path = c.file
      where c.kind in ('class', 'method', 'function') and c.code is not null group by 1""",
    "call_resolve": f"with {_CHUNKS}, {_RESOLVED} select chunk_id, repo_id, src, receiver, name, rule, dst from res",
    "call_rule_hist": f"with {_CHUNKS}, {_RESOLVED} select rule, count(*) as n from res group by 1",
    "call_edges": f"with {_CHUNKS}, {_RESOLVED} select * from edges",
    "neighbors_out": f"with {_CHUNKS}, {_RESOLVED} select repo_id, a as file, b as other, count(*) as n from ({_SIDES}) where a <> b group by 1, 2, 3",
    "neighbors_in": f"with {_CHUNKS}, {_RESOLVED} select repo_id, b as file, a as other, count(*) as n from ({_SIDES}) where a <> b group by 1, 2, 3",
    "callers_of": f"""with {_CHUNKS}, e as (select distinct repo_id, file || '::' || symbol as src, unnest(calls) as dst from c)
      select repo_id, dst, count(*) as n_callers, array_to_string(list_sort(list(src))[1:10], ',') as callers from e where src <> dst group by 1, 2""",
    "enclosing_innermost": f"""with {_CHUNKS}, pts as (select distinct repo_id, file, i as line from (select repo_id, file, string_split(code, chr(10)) as ls, unnest(range(1, len(string_split(code, chr(10))) + 1)) as i from c where kind = 'file') where contains(ls[i], 'ticket '))
      select p.repo_id, p.file, p.line, arg_min(s.symbol, {{'a': s.end_line - s.start_line, 'b': s.start_line, 'c': s.symbol}}) as symbol from pts p
      join (select distinct repo_id, file, symbol, start_line, end_line from c where kind in ('function', 'method', 'class')) s on s.repo_id = p.repo_id and s.file = p.file and p.line between s.start_line and s.end_line group by 1, 2, 3""",
}
