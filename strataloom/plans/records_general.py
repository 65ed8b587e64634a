"""Queries of the general problems 3 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.operators import hierarchy, orphans
from strataloom.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    names = {r.table for r in orphans.RECORD_REFERENCES} | {r.parent for r in orphans.RECORD_REFERENCES}
    return orphans.orphan_references({n: table(spark, folder, n) for n in sorted(names)}, table(spark, folder, "deleted_records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, folder, "asks"))


def p6_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.chain_intervals(table(spark, folder, "asks"))


def _orphan_sql() -> str:
    refs = [("answers", "question_id", "questions"), ("claims", "answer_id", "answers"), ("asks", "parent_id", "asks")]
    parts = " union all ".join(
        f"select '{t}' as ref_table, id as ref_id, '{p}' as tab, {c} as target, min(loaded_at) as arrived from {t} where {c} is not null and id is not null group by id, {c}" for t, c, p in refs
    )
    known = " union all ".join(f"select '{p}' as tab, id as target, min(loaded_at) as first_at, max(loaded_at) as last_at from {p} group by id" for p in ("questions", "answers", "asks"))
    return f"""
with refs as ({parts}), known as ({known}),
log as (select rec_table as tab, rec_id as target, max(deleted_at) as deleted_at from deleted_records group by 1, 2)
select distinct ref_table, ref_id, reason, period from (
  select r.ref_table, r.ref_id, strftime(r.arrived, '%Y-%m') as period,
    case when l.target is not null and not coalesce(k.last_at > l.deleted_at, false) then 'deleted'
         when k.target is null then 'missing' when k.first_at > r.arrived then 'late' end as reason
  from refs r left join known k using (tab, target) left join log l using (tab, target))
where reason is not null"""


_TREE_SQL = """
with recursive a as (select id, min(parent_id) as p from asks where id is not null group by id),
e as (select a.id, b.id as p from a left join a b on a.p = b.id),
down as (select id, id as root_id, cast(0 as bigint) as depth, cast(id as varchar) as id_path from e where p is null
  union all select e.id, d.root_id, d.depth + 1, d.id_path || '/' || cast(e.id as varchar) from e join down d on e.p = d.id),
lost as (select e.* from e where id not in (select id from down)),
walk as (select id as start, p as node from lost union select w.start, l.p from walk w join lost l on w.node = l.id),
ring as (select start as id from walk where start = node),
low as (select w.start as id, min(w.node) as root_id from walk w join ring r on w.node = r.id group by 1),
anc as (select id as start, p as node from e where p is not null union select x.start, e.p from anc x join e on x.node = e.id where e.p is not null),
cnt as (select node as id, count(*) filter (where start <> node) as n_desc from anc group by node)
"""

P6_SQL = _TREE_SQL + """
select d.id, 'tree' as status, d.root_id, d.depth, coalesce(c.n_desc, 0) as n_desc, d.id_path from down d left join cnt c using (id)
union all
select l.id, case when r.id is null then 'below_cycle' else 'cycle' end, w.root_id, cast(-1 as bigint), coalesce(c.n_desc, 0), ''
from lost l join low w using (id) left join ring r using (id) left join cnt c using (id)"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p6_found": p6_found, "p6_intervals": p6_intervals}
ORACLES = {
    "p3_found": _orphan_sql(),
    "p3_report": f"select ref_table, reason, period, count(*) as n_refs from ({_orphan_sql()}) group by 1, 2, 3",
    "p6_found": P6_SQL,
}
