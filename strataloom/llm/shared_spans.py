"""Long exact spans that several documents share, by difference-cover anchors.

A difference cover D of period v meets every pair of positions i, j at a common shift below v:
(i + s) % v and (j + s) % v both lie in D. Windows of `SPAN - v + 1` words are hashed only where
the position modulo v is in D, so any two equal runs of SPAN words have an equal anchor at the
same shift. Anchors whose hash lies in one document only are dropped; around the others each
run of SPAN words that holds one is extended word for word and compared as a whole by a
128-bit digest. Work is linear in the words: groups of equal anchors or runs are reduced to
their smallest and largest document, never to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strataloom.operators.orphans import bloom_filter, split_by_filter
from strataloom.session import cut_lineage, drop_table

#: Words of a shared span at least.
SPAN = 40
#: A perfect difference set (Singer, order 4): every difference modulo 21 occurs.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Bytes that are hashed at once.
SLICE_BYTES = 1 << 20

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[9, 10, 13, 32]] = True
# An odd base has an inverse modulo 2**64, so the hash of a part comes from two prefix sums.
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """Anchors of the documents of one slice of an Arrow column."""

    def __init__(self, span: int, period: int, cover: tuple[int, ...]):
        self.span, self.window = span, span - period + 1
        self.in_cover = np.zeros(period, bool)
        self.in_cover[list(cover)] = True
        self.period, self.sizes = period, {}

    def powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.sizes.get(base)
        if have is None or len(have[0]) <= n:
            m = max(n, SLICE_BYTES)
            have = self.sizes[base] = (_powers(base, m), _powers(pow(base, -1, 1 << 64), m))
        return have

    def parts(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
        up, down = self.powers(base, len(values))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
        return _mixed((total[ends] - total[starts]) * down[starts])

    def anchors(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hash, document (index into bounds) and word position of each anchor."""
        gap = np.ones(len(data) + 1, bool)
        gap[:-1] = _SEPARATORS[data]
        before = np.ones(len(data) + 1, bool)
        before[1:] = gap[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True  # a document's first byte begins a word, its last ends one
        starts = np.flatnonzero(~gap & (before | edge))
        ends = np.flatnonzero((gap | edge)[1:] & ~gap[:-1]) + 1
        doc = np.searchsorted(bounds, starts, "right") - 1
        words = self.parts(data.astype(np.uint64) + np.uint64(1), starts, ends, _BASE)
        first = np.searchsorted(starts, bounds[:-1], "left")
        last = np.append(first[1:], len(starts))
        pos = np.arange(len(starts)) - first[doc]
        left = last[doc] - np.arange(len(starts))
        at = np.flatnonzero(self.in_cover[pos % self.period] & (left >= self.window) & ((last - first)[doc] >= self.span))
        return self.parts(words, at, at + self.window, _WORD_BASE).view(np.int64), doc[at], pos[at]


def _anchor_rows(span: int, period: int, cover: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(span, period, cover)
        with np.errstate(over="ignore"):
            for batch in batches:
                texts, keys = batch.column("__text"), batch.column("__key").to_numpy(zero_copy_only=False)
                wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
                offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
                i = 0
                while i < len(texts):
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
                    h, doc, pos = hasher.anchors(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys[i:j][doc], pa.int64()), pa.array(pos.astype(np.int32))], names=["h", "__key", "pos"])
                    i = j

    return run


def _run_rows(span: int, period: int):
    """Digests of all runs of `span` words that hold one of the document's shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import xxhash

        split, digest = re.compile(rb"[^ \t\r\n]+").findall, xxhash.xxh3_128_digest
        for batch in batches:
            keys, places, digests = [], [], []
            for key, text, at in zip(batch.column("__key").to_pylist(), batch.column("__text"), batch.column("at")):
                words = split(text.as_buffer().to_pybytes())
                joined = memoryview(b" ".join(words))
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                marked = np.zeros(len(words) + 1, np.int32)  # runs begin up to period - 1 words before an anchor
                anchors = at.values.to_numpy()
                np.add.at(marked, np.maximum(anchors - period + 1, 0), 1)
                np.add.at(marked, anchors + 1, -1)
                runs = np.flatnonzero(np.cumsum(marked[: max(0, len(words) - span + 1)]) > 0)
                digests += [digest(joined[a:b]) for a, b in zip(starts[runs].tolist(), ends[runs + span - 1].tolist())]
                keys.append(np.full(len(runs), key, np.int64))
                places.append(runs.astype(np.int32))
            if digests:
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["__key", "pos", "g0", "g1"])

    return run


def _in_two(rows: DataFrame, *by: str) -> DataFrame:
    """The keys that occur in at least two documents; partial minima and maxima come before the shuffle."""
    return rows.groupBy(*by).agg(F.min("__key").alias("a"), F.max("__key").alias("b")).where("a <> b").select(*by)


def _shared_positions(documents: DataFrame, key: str, text: str, span: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """__key and pos: where runs of `span` words begin that stand in another document too."""
    texts = documents.where(F.col(key).isNotNull() & (F.length(text) >= 2 * span - 1)).select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    # Written once, so that no text is hashed again for the second look at the anchors.
    anchors = cut_lineage(texts.mapInArrow(_anchor_rows(span, period, cover), "h bigint, __key bigint, pos int"))
    counted = Observation()
    shared = cut_lineage(_in_two(anchors, "h"), counted, n=F.count("*"))
    # The filter only spares the shuffle rows that can't match; the join decides.
    hits = split_by_filter(anchors, bloom_filter(shared, "h", n_keys=counted.get["n"])).where("may_exist").drop("may_exist").join(shared, "h", "left_semi")
    counted = Observation()
    at = cut_lineage(hits.groupBy("__key").agg(F.collect_set("pos").alias("at")), counted, n=F.count("*"))
    drop_table(anchors)
    drop_table(shared)
    wanted = split_by_filter(texts, bloom_filter(at, "__key", n_keys=counted.get["n"])).where("may_exist").drop("may_exist").dropDuplicates(["__key"]).join(at, "__key")
    runs = cut_lineage(wanted.select("__key", F.col("__text").cast("binary").alias("__text"), "at").mapInArrow(_run_rows(span, period), "__key bigint, pos int, g0 bigint, g1 bigint"))
    drop_table(at)
    return runs.join(_in_two(runs, "g0", "g1"), ["g0", "g1"], "left_semi").select("__key", "pos").distinct()


def shared_words(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """`key` and n_shared: word positions in runs of `span` words or more that stand in another document too.

    Words are separated by spaces, tabs, CR and LF only and compared as they are. Documents without
    such a position are left out, as are null keys and texts, blank and short texts. Rows with the
    same key are one document (equal copies change nothing). An empty table gives an empty result.
    """
    found = _shared_positions(documents, key, text, span, period, cover)
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("__key").orderBy("pos"))
    return found.withColumn("new", F.least(F.lit(span), F.coalesce(gap, F.lit(span)))).groupBy("__key").agg(F.sum("new").cast("long").alias("n_shared")).withColumnRenamed("__key", key)


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """`key`, first_word and n_words of every stretch of a document that shared spans cover without a gap (positions from 0).

    A stretch may be put together from spans shared with different documents. Cases as in `shared_words`.
    """
    w = Window.partitionBy("__key").orderBy("pos")
    found = _shared_positions(documents, key, text, span, period, cover)
    begins = F.coalesce(F.col("pos") - F.lag("pos").over(w) > span, F.lit(True)).cast("int")
    numbered = found.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = numbered.groupBy("__key", "stretch").agg(F.min("pos").cast("long").alias("first_word"), (F.max("pos") - F.min("pos") + span).cast("long").alias("n_words"))
    return spans.drop("stretch").withColumnRenamed("__key", key)
