"""Filling containers of fixed capacity by bounded-space online packing.

Each partition packs its items as they come into a fixed number of open containers: best fit
first; when an item fits into none, the fullest is emitted and a new one opened. What is open
at a partition's end is merged by fewer partitions, level by level, until one partition
merges what is left. A merging task receives at most `open_windows` containers from each of
`merged` partitions and has a window for every one of them, so it can take their items from the
largest down; of what it made, the `open_windows` emptiest stay open for the next level.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import tokens
from strataloom.session import cut_lineage

#: Tokens that a container holds.
CAPACITY = 4096
#: Containers that a partition keeps open.
OPEN_WINDOWS = 256
#: Partitions whose open containers one task of the next level merges.
MERGED = 16


class _Open:
    """The open containers of one partition, ordered by the room that is left."""

    def __init__(self, limit: int, capacity: int):
        self.limit, self.capacity, self.rooms, self.content, self.made = limit, capacity, [], {}, 0

    def add(self, size: int, item: tuple) -> list[tuple[int, tuple]]:
        """Places an item; returns (container, item) of a container that had to go."""
        gone = []
        at = bisect_left(self.rooms, (size, -1))  # the least room that suffices
        if at == len(self.rooms):
            if len(self.rooms) == self.limit:
                _, full = self.rooms.pop(0)
                gone = [(full, x) for x in self.content.pop(full)]
            room, bin_no, self.made = self.capacity, self.made, self.made + 1
            self.content[bin_no] = []
        else:
            room, bin_no = self.rooms.pop(at)
        self.content[bin_no].append(item)
        if room > size or size == 0:
            insort(self.rooms, (room - size, bin_no))
            return gone
        return gone + [(bin_no, x) for x in self.content.pop(bin_no)]  # exactly full: emitted at once


def _names(kind: str) -> str:
    return f"__key {kind}, part int, start bigint, n_tokens bigint, container bigint, is_open boolean"


def _pack(items: DataFrame, kind: str, level: int, capacity: int, windows: int, left_open: int) -> DataFrame:
    """One level: rows with their container, named by level, partition and number; the `left_open` emptiest of the last `windows` are marked open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = ((level << 22) + TaskContext.get().partitionId()) << 32
        state, key_type = _Open(windows, capacity), None

        def rows(placed: list[tuple[int, tuple]], is_open: bool) -> pa.RecordBatch:
            keys, parts, starts, sizes = zip(*(x for _, x in placed))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([base + b for b, _ in placed], pa.int64()), pa.array([is_open] * len(placed), pa.bool_())],
                names=["__key", "part", "start", "n_tokens", "container", "is_open"],
            )

        for batch in batches:
            key_type, gone = batch.schema.field("__key").type, []
            for item in zip(*(batch.column(c).to_pylist() for c in ("__key", "part", "start", "n_tokens"))):
                gone += state.add(item[3], item)
            if gone:
                yield rows(gone, False)
        by_room = [b for _, b in reversed(state.rooms)]  # the emptiest first
        for bins, is_open in ((by_room[:left_open], True), (by_room[left_open:], False)):
            if placed := [(b, x) for b in bins for x in state.content[b]]:
                yield rows(placed, is_open)

    return items.select("__key", "part", "start", "n_tokens").mapInArrow(run, _names(kind))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, merged: int = MERGED) -> DataFrame:
    """`key`, part, start, n_tokens and container of every item.

    An item above the capacity is split into full containers and a rest that is packed like any
    other item (part counts its pieces, start is where a piece begins in the item); no other item
    is split. Null and negative sizes are left out, items of size 0 come out in a container. Equal
    rows are separate items. An empty table gives an empty result.
    """
    kind = sizes.schema[key].dataType.simpleString()
    items = sizes.select(F.col(key).alias("__key"), F.col(size).cast("long").alias("n")).where("n >= 0")
    full = F.when(F.col("n") > capacity, F.floor((F.col("n") - 1) / capacity)).otherwise(0).cast("int")
    pieces = items.select("__key", "n", F.posexplode(F.sequence(F.lit(0), full)).alias("part", "__p")).drop("__p")
    pieces = pieces.withColumn("start", F.col("part") * F.lit(capacity).cast("long")).withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start")))
    level, done = 0, []
    placed = cut_lineage(_pack(pieces, kind, 0, capacity, open_windows, open_windows))
    partitions = placed.where("is_open").select(F.shiftright("container", 32)).distinct().count()
    while partitions and (partitions > 1 or level == 0):
        partitions, level = -(-partitions // merged), level + 1
        done.append(placed.where("not is_open"))
        # Containers keep together on their way, so that the windows of a task suffice for all it receives, but for uneven hashing.
        again = placed.where("is_open").repartition(partitions, "container").sortWithinPartitions(F.desc("n_tokens"), "__key", "part")
        placed = cut_lineage(_pack(again, kind, level, capacity, 2 * merged * open_windows, open_windows))
    for earlier in done:
        placed = placed.unionByName(earlier)
    return placed.drop("is_open").withColumnRenamed("__key", key)


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = tokens.VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """`pack` of all documents with text by their number of tokens; null texts are left out."""
    return pack(tokens.token_counts(documents, key, text, vocabulary), key, "n_tokens", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container, n_items, n_tokens and unused of each container."""
    return packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
