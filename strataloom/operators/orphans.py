"""References to records that do not exist.

A blocked Bloom filter over all parent keys proves most orphans without a join against the
parents; only the references that pass the filter are joined exactly. The filter has ten bits
for each key, so the share of false positives stays about 2 % at every size. It is an ordinary
DataFrame of segments (arrays of 64-bit blocks). Up to `BROADCAST_BYTES` it is broadcast; beyond
that both sides meet by a shuffle on the segment, where each task holds its own range of the filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each key, and how many of them each key sets in its block.
BITS_A_KEY, BITS_SET = 10, 4
#: Blocks of 64 bits in one segment, a row of the filter.
SEGMENT_BLOCKS = 64
#: Size of a filter up to which it is broadcast: 10**8 keys.
BROADCAST_BYTES = 125_000_000


@dataclass(frozen=True)
class Reference:
    """`table`.`column` names a record of `parent`; both have `id` and `loaded_at`."""

    table: str
    column: str
    parent: str


#: The references among the record tables.
RECORD_REFERENCES = (
    Reference("answers", "question_id", "questions"),
    Reference("claims", "answer_id", "answers"),
    Reference("asks", "parent_id", "asks"),
)


@dataclass(frozen=True)
class Bloom:
    """Segments (__segment, __blocks) of a filter over `key`, and how many there are."""

    rows: DataFrame
    key: tuple[str, ...]
    segments: int

    @property
    def is_small(self) -> bool:
        return self.segments * SEGMENT_BLOCKS * 8 <= BROADCAST_BYTES


def _mask() -> Column:
    """The bits of a key inside its block: six bits of the hash `__h` for each, apart from those that choose the block."""
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__h, {40 + 6 * k}) & 63 as int))") for k in range(BITS_SET)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _hashed(df: DataFrame, key: tuple[str, ...], segments: int) -> DataFrame:
    # The segment comes from another hash: the low bits of one choose the block, its high bits the mask.
    block = F.col("__h").bitwiseAND(F.lit(SEGMENT_BLOCKS - 1)).cast("int")
    return df.withColumn("__h", F.xxhash64(*key)).withColumns({"__segment": F.pmod(F.xxhash64("__h"), F.lit(segments)), "__block": block, "__mask": _mask()}).drop("__h")


def bloom_filter(keys: DataFrame, *key: str, n_keys: int | None = None) -> Bloom:
    """A filter over all keys; `n_keys` is their number where it is known, else it is estimated by a pass over them.

    Partial `bit_or` runs before the shuffle, which carries each block at most once a task.
    """
    if n_keys is None:
        n_keys = keys.agg(F.approx_count_distinct(F.xxhash64(*key))).first()[0]
    segments = max(1, -(-n_keys * BITS_A_KEY // (64 * SEGMENT_BLOCKS)))
    blocks = _hashed(keys.select(*key), key, segments).groupBy("__segment", "__block").agg(F.bit_or("__mask").alias("__bits"))
    kept = F.map_from_entries(F.collect_list(F.struct("__block", "__bits")))  # at most SEGMENT_BLOCKS entries
    whole = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BLOCKS - 1)), lambda i: F.coalesce(F.element_at("__kept", i), F.lit(0).cast("long")))
    rows = blocks.groupBy("__segment").agg(kept.alias("__kept")).select("__segment", whole.alias("__blocks"))
    return Bloom(rows, key, segments)


def split_by_filter(refs: DataFrame, bloom: Bloom, *key: str, name: str = "may_exist") -> DataFrame:
    """`refs` with `name`: false proves that the filter's keys have no such key (null keys are in no filter)."""
    key = key or bloom.key
    rows = F.broadcast(bloom.rows) if bloom.is_small else bloom.rows
    probed = _hashed(refs, key, bloom.segments).join(rows, "__segment", "left")
    bits = F.element_at("__blocks", F.col("__block") + 1)
    return probed.withColumn(name, F.coalesce(bits.bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))).drop("__segment", "__block", "__mask", "__blocks")


def _stamps(tables: dict[str, DataFrame], name: str) -> DataFrame:
    return tables[name].where(F.col("id").isNotNull()).select(F.lit(name).alias("tab"), F.col("id").cast("long").alias("key"), F.col("loaded_at").alias("loaded"))


def orphan_references(tables: dict[str, DataFrame], deleted: DataFrame, references: tuple[Reference, ...] = RECORD_REFERENCES) -> DataFrame:
    """ref_table, ref_id, reason and period of every reference without a valid target.

    reason, tested in this order: `deleted` (the log of deletions has the target and no row of it
    was loaded after its latest deletion), `missing` (no row of the target), `late` (the target
    arrived after the referring record). A record arrives with the earliest of its rows; period is
    the month of that (null if no row has a time). Repeated rows of a record count once, null
    references and rows without id are no cases; a null time is never "after" another. Empty tables
    give an empty result; further columns are ignored.
    """
    refs = None
    for r in references:
        one = (
            tables[r.table].where(F.col("id").isNotNull() & F.col(r.column).isNotNull())
            .select(F.lit(r.table).alias("ref_table"), F.col("id").cast("long").alias("ref_id"), F.lit(r.parent).alias("tab"), F.col(r.column).cast("long").alias("key"), F.col("loaded_at").alias("loaded"))
        )
        refs = one if refs is None else refs.unionByName(one)
    refs = refs.groupBy("ref_table", "ref_id", "tab", "key").agg(F.min("loaded").alias("arrived"))
    parents = None
    for name in sorted({r.parent for r in references}):
        one = _stamps(tables, name)
        parents = one if parents is None else parents.unionByName(one)
    log = deleted.where(F.col("rec_id").isNotNull()).groupBy(F.col("rec_table").alias("tab"), F.col("rec_id").cast("long").alias("key")).agg(F.max("deleted_at").alias("deleted_at"))

    probed = split_by_filter(split_by_filter(refs, bloom_filter(parents, "tab", "key")), bloom_filter(log, "tab", "key"), name="may_be_deleted")
    proven = ~F.col("may_exist") & ~F.col("may_be_deleted")
    orphans = probed.where(proven).select("ref_table", "ref_id", F.lit("missing").alias("reason"), "arrived")
    known = parents.groupBy("tab", "key").agg(F.min("loaded").alias("first"), F.max("loaded").alias("last"), F.lit(True).alias("present"))
    # One table of what is known of a key, so that what passes a filter is joined once.
    facts = known.join(log, ["tab", "key"], "full")
    back = F.coalesce(F.col("last") > F.col("deleted_at"), F.lit(False))
    reason = F.when(F.col("deleted_at").isNotNull() & ~back, "deleted").when(F.col("present").isNull(), "missing").when(F.col("first") > F.col("arrived"), "late")
    judged = probed.where(~proven).join(facts, ["tab", "key"], "left").select("ref_table", "ref_id", reason.alias("reason"), "arrived").where("reason is not null")
    return orphans.unionByName(judged).select("ref_table", "ref_id", "reason", F.date_format("arrived", "yyyy-MM").alias("period")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, reason and period."""
    return found.groupBy("ref_table", "reason", "period").agg(F.count("*").alias("n_refs"))
