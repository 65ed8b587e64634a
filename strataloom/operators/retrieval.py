"""Retrieval: exact vector search in blocks, identifiers, quotas, containment, mentions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.names import identifiers
from strataloom.functions.windows import numbered
from strataloom.session import cut_lineage

#: Queries that are sent to the tasks at once, queries and base vectors that are multiplied at once, slices whose results are one table.
QUERY_SLICE, QUERY_BLOCK, BASE_BLOCK, SLICES_AT_ONCE = 8192, 1024, 4096, 16
#: What single precision may be wrong by; everything so near to the last place is compared in double precision.
SINGLE_ERROR = 4e-6
# Places by kind in a result of eight, the first for any kind.
QUOTAS = ((None, 4), ("file", 2), ("doc", 1), ("config", 1))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


class _Best:
    """The nearest base vectors of one slice of queries among those seen so far, in arrays."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, k: int):
        self.own, self.exact, self.k = keys, vectors, k
        self.single = vectors.astype(np.float32)
        self.rows, self.least = [], np.full(len(keys), -np.inf, np.float32)

    def see(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        single = vectors.astype(np.float32)
        for i in range(0, len(self.own), QUERY_BLOCK):
            near = self.single[i : i + QUERY_BLOCK] @ single.T
            if near.shape[1] > self.k + 1:  # one more, as a query may meet itself
                last = np.partition(near, near.shape[1] - self.k - 1, axis=1)[:, near.shape[1] - self.k - 1]
                self.least[i : i + QUERY_BLOCK] = np.maximum(self.least[i : i + QUERY_BLOCK], last)
            q, b = np.nonzero(near >= (self.least[i : i + QUERY_BLOCK] - np.float32(SINGLE_ERROR))[:, None])
            q += i
            apart = keys[b] != self.own[q]
            q, b = q[apart], b[apart]
            self.rows.append((q, keys[b], np.round(1.0 - np.einsum("ij,ij->i", self.exact[q], vectors[b]), 6)))
        if len(self.rows) > 64:
            self.rows = [self.top()]

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, keys, distances = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((keys, distances, q))
        q = q[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k
        return q[kept], keys[order][kept], distances[order][kept]


def vector_topk(queries: DataFrame, base: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, keep: str | None = None, group: str | None = None) -> DataFrame:
    """query, rank, `key`, distance: the `k` nearest vectors by cosine distance of each query, itself left out.

    Queries go to the tasks in slices of `QUERY_SLICE`, so what is sent has a bound; every task
    multiplies bounded blocks of the base where it lies and keeps `k` rows a query (of each `group`, if
    given). Only those are shuffled, and a window over k rows of each task gives the result. `keep`
    is a condition on the base. Null and empty vectors are left out; a zero vector has distance 1;
    ties go by key.
    """
    usable = F.size(vector) > 0
    q = queries.where(usable).select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("qv"))
    b = base.where(usable)
    b = (b.where(keep) if keep else b).select(F.col(key).cast("long").alias("__key"), F.col(vector).cast("array<double>").alias("bv"), *([group] if group else []))
    slices = max(1, -(-q.count() // QUERY_SLICE))
    kind = f", {group} {base.schema[group].dataType.simpleString()}" if group else ""
    context = q.sparkSession.sparkContext

    def nearest(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, vectors = sent.value
            best: dict = {}
            kind_type = None
            for whole in batches:
                for at in range(0, whole.num_rows, BASE_BLOCK):
                    batch = whole.slice(at, BASE_BLOCK)
                    keys = batch.column("__key").to_numpy()
                    matrix = _unit(batch.column("bv").flatten().to_numpy().reshape(len(keys), -1))
                    kinds = batch.column(group).to_pylist() if group else [None] * len(keys)
                    kind_type = batch.schema.field(group).type if group else None
                    for g in dict.fromkeys(kinds):
                        part = np.array([x == g for x in kinds])
                        best.setdefault(g, _Best(own, vectors, k)).see(keys[part], matrix[part])
            for g, found in best.items():
                at, keys, distances = found.top()
                columns = [pa.array(own[at]), pa.array(keys), pa.array(distances)] + ([pa.array([g] * len(at), kind_type)] if group else [])
                yield pa.RecordBatch.from_arrays(columns, names=["query", "__key", "distance", *([group] if group else [])])

        return run

    done, parts = [], []
    for number in range(slices):
        rows = q.where(F.pmod(F.xxhash64("query"), F.lit(slices)) == number).collect()  # about QUERY_SLICE rows
        if rows:
            sent = context.broadcast((np.array([r["query"] for r in rows], np.int64), _unit(np.array([r["qv"] for r in rows]))))
            parts.append(b.mapInArrow(nearest(sent), f"query long, __key long, distance double{kind}"))
        if parts and slices > SLICES_AT_ONCE and (len(parts) == SLICES_AT_ONCE or number == slices - 1):
            done.append(cut_lineage(reduce(DataFrame.unionByName, parts)))
            parts = []
    empty = b.select(F.col("__key").alias("query"), "__key", F.lit(0.0).alias("distance"), *([group] if group else [])).where("false")
    local = reduce(DataFrame.unionByName, [*done, *parts]) if done or parts else empty
    rank = numbered(Window.partitionBy("query", *([group] if group else [])).orderBy("distance", "__key"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", F.col("__key").alias(key), "distance", *([group] if group else []))


#: Vectors that an index is fitted on at most, about; rounds of fitting; sample queries and the recall on them by which the number of lists to look into is chosen.
INDEX_SAMPLE, INDEX_ROUNDS, INDEX_QUERIES, INDEX_RECALL = 20_000, 8, 500, 0.97


@dataclass(frozen=True)
class VectorIndex:
    """Centres of the lists and how many lists a query looks into."""

    centres: np.ndarray
    probes: int


def fit_index(base: DataFrame, key: str = "vec_id", vector: str = "embedding", centres: int = 64, sample: int = INDEX_SAMPLE, k: int = 8) -> VectorIndex:
    """Lists around `centres` unit vectors, by spherical k-means on about `sample` rows at most, those with the smallest hashes.

    The number of lists to look into is the least that finds `INDEX_RECALL` of the `k` nearest
    sample vectors of `INDEX_QUERIES` of them.
    """
    rows = base.where(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v"), F.shiftrightunsigned(F.xxhash64(key), 11).alias("h"))
    share = min(1.0, sample / max(1, rows.count()))
    data = np.array([r["v"] for r in rows.where(F.col("h") < F.lit(share * (1 << 53))).orderBy("h").collect()])
    if not len(data):
        return VectorIndex(np.zeros((0, 0)), 0)
    data = _unit(data)
    found = data[np.linspace(0, len(data) - 1, min(centres, len(data))).astype(int)]
    for _ in range(INDEX_ROUNDS):
        nearest = (data @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, data)
        filled = np.bincount(nearest, minlength=len(found)) > 0
        found[filled] = _unit(sums[filled])
    asked = data[:INDEX_QUERIES]
    near = asked @ data.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2.0
    best = np.argsort(-near, axis=1)[:, :k]
    order = np.argsort(-(asked @ found.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list among those of a query
    needed = np.sort(np.take_along_axis(place, (data @ found.T).argmax(axis=1)[best], axis=1).ravel())
    return VectorIndex(found, int(needed[min(len(needed) - 1, int(np.ceil(INDEX_RECALL * len(needed))))]) + 1)


def _lists(df: DataFrame, key: str, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """key, vector and list: one row for each of the `probes` nearest centres of each vector."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key)
            matrix = _unit(batch.column("v").flatten().to_numpy().reshape(len(keys), -1))
            near = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(keys)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([keys.take(at), batch.column("v").take(at), pa.array(near.ravel().astype(np.int32))], names=[key, "v", "list"])

    rows = df.where(F.size(vector) > 0).select(key, F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"{key} {kind}, v array<double>, list int")


def index_topk(queries: DataFrame, base: DataFrame, index: VectorIndex, key: str = "vec_id", vector: str = "embedding", k: int = 8, salts: int = 8) -> DataFrame:
    """query, rank, `key`, distance like `vector_topk`, but each query looks only into the lists of its nearest centres.

    Every base vector lies in the list of its nearest centre; a list is split into `salts` parts, so that
    a hot one is several tasks. Approximate: what lies in other lists isn't found. Ties go by key.
    """
    if not index.probes:
        return vector_topk(queries, base, key, vector, k)
    b = _lists(base, key, vector, index.centres, 1).select(F.col(key).cast("long").alias("__key"), F.col("v").alias("bv"), "list", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"))
    q = _lists(queries, key, vector, index.centres, index.probes).select(F.col(key).cast("long").alias("query"), F.col("v").alias("qv"), "list", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "__key": [], "distance": []})
        own = left["query"].to_numpy()
        best = _Best(own, _unit(np.array(left["qv"].tolist())), k)
        keys, matrix = right["__key"].to_numpy(), _unit(np.array(right["bv"].tolist()))
        for at in range(0, len(keys), BASE_BLOCK):
            best.see(keys[at : at + BASE_BLOCK], matrix[at : at + BASE_BLOCK])
        at, found, distances = best.top()
        return pd.DataFrame({"query": own[at], "__key": found, "distance": distances})

    local = q.groupBy("list", "salt").cogroup(b.groupBy("list", "salt")).applyInPandas(pairs, "query long, __key long, distance double")
    rank = numbered(Window.partitionBy("query").orderBy("distance", "__key"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", F.col("__key").alias(key), "distance")


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: n_exact pairs and the share of them that were found."""
    hits = exact.select("query", key).join(found.select("query", key, F.lit(1).alias("hit")), ["query", key], "left")
    return hits.agg(F.count("*").alias("n_exact"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def quota_union(ranked: DataFrame, all_kinds: DataFrame, key: str = "vec_id", kind: str = "kind", quotas: tuple = QUOTAS, k: int = 8) -> DataFrame:
    """query, place, `key`: first `quotas` places of any kind, then of each kind, then any to fill `k`.

    `ranked` has rank by query and kind, `all_kinds` the rank over all. A quota limits a stage's own
    search, so a hit that an earlier stage brought uses up its place.
    """
    stages = []
    for number, (one, places) in enumerate(quotas):
        source = all_kinds if one is None else ranked.where(F.col(kind) == one)
        stages.append(source.where(F.col("rank") <= places).select("query", key, F.lit(number).alias("stage"), "rank"))
    stages.append(all_kinds.where(F.col("rank") <= k).select("query", key, F.lit(len(quotas)).alias("stage"), "rank"))
    every = stages[0]
    for s in stages[1:]:
        every = every.unionByName(s)
    first = every.groupBy("query", key).agg(F.min(F.struct("stage", "rank")).alias("at"))
    place = numbered(Window.partitionBy("query").orderBy("at", key))
    return first.withColumn("place", place).where(F.col("place") <= k).select("query", "place", key)


def identifier_hits(questions: DataFrame, chunks: DataFrame, limit: int = 3) -> DataFrame:
    """id, identifier, rank, chunk_id, n: the chunks that use an identifier of a question most, files left out.

    A chunk's words are counted once and joined by name, so nothing is compared pairwise.
    """
    asked = questions.select("id", "repo_id", F.explode(identifiers(F.col("question"))).alias("identifier"))
    wanted = asked.select("repo_id", "identifier").distinct()
    words = chunks.where("kind <> 'file'").select("chunk_id", "repo_id", F.explode(F.regexp_extract_all("code", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))).alias("identifier"))
    counted = words.groupBy("chunk_id", "repo_id", "identifier").agg(F.count("*").alias("n")).join(wanted, ["repo_id", "identifier"], "left_semi")
    rank = numbered(Window.partitionBy("repo_id", "identifier").orderBy(F.desc("n"), "chunk_id"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= limit)
    return asked.join(best, ["repo_id", "identifier"]).select("id", "identifier", "rank", "chunk_id", "n")


def drop_contained(spans: DataFrame, by: list[str], start: str = "start_line", end: str = "end_line", order: str = "chunk_id") -> DataFrame:
    """The spans that no other span of their group contains; of equal spans the first stays.

    In order of start (and descending end) a span is contained exactly when an earlier one reaches
    as far, so one running maximum replaces the comparison of pairs.
    """
    w = Window.partitionBy(*by).orderBy(F.col(start), F.desc(end), F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__reach", F.max(end).over(w)).where(F.col("__reach").isNull() | (F.col("__reach") < F.col(end))).drop("__reach")


def mentioned_files(texts: DataFrame, files: DataFrame, text: str = "body") -> DataFrame:
    """id, place, path: files that a text names by path, or by a name that one file of the repository only has."""
    pattern = r"([A-Za-z0-9_./-]+\.(?:py|java|md|json|toml|ya?ml))"
    named = texts.select("id", "repo_id", F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("pos", "name"))
    paths = files.select("repo_id", "path").distinct()
    whole = named.join(paths.withColumn("name", F.col("path")), ["repo_id", "name"])
    base = paths.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).groupBy("repo_id", "name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    found = whole.unionByName(named.join(base, ["repo_id", "name"])).groupBy("id", "path").agg(F.min("pos").alias("pos"))
    return found.withColumn("place", numbered(Window.partitionBy("id").orderBy("pos", "path"))).select("id", "place", "path")


def mentioned_symbols(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, symbol: symbols of the repository whose last part a question names, without those inside a longer hit."""
    asked = questions.select("id", "repo_id", F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("leaf"))
    defs = chunks.where(F.col("kind").isin("class", "method", "function")).select("repo_id", F.regexp_extract(F.regexp_replace("symbol", r"#\d+$", ""), r"([A-Za-z_]\w*)$", 1).alias("leaf")).distinct()
    named = asked.join(defs, ["repo_id", "leaf"]).groupBy("id").agg(F.collect_set("leaf").alias("names"))
    alone = F.filter("names", lambda x: ~F.exists("names", lambda y: (y != x) & F.contains(y, x)))  # one question names few symbols
    return named.select("id", F.explode(alone).alias("symbol"))


def validated_picks(picks: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query, place, item: the 1-based picks that exist, without repetition, filled up in the candidates' order.

    picks: query, pos, pick; candidates: query, rank, item.
    """
    chosen = picks.join(candidates.withColumnRenamed("rank", "pick"), ["query", "pick"]).groupBy("query", "item").agg(F.min(F.struct(F.lit(0).alias("stage"), F.col("pos").cast("long").alias("at"))).alias("o"))
    rest = candidates.select("query", "item", F.struct(F.lit(1).alias("stage"), F.col("rank").cast("long").alias("at")).alias("o"))
    first = chosen.unionByName(rest).groupBy("query", "item").agg(F.min("o").alias("o"))
    return first.withColumn("place", numbered(Window.partitionBy("query").orderBy("o", "item"))).where(F.col("place") <= k).select("query", "place", "item")


def union_evidence(hits: DataFrame, k: int) -> DataFrame:
    """query, place, chunk_id of at most `k` hits taken in `stage`, `rank` order, where a container swallows what lies in it and goes last.

    hits: query, stage, rank, chunk_id, file, kind, start_line, end_line; stage 0 stops at half of `k`.
    The fold is stateful and runs by query, whose hits a search has bounded.
    """

    def fold(hits: list[dict]) -> list[int]:
        seen, kept = set(), []
        for h in hits:
            if h["chunk_id"] in seen or len(kept) >= ((k + 1) // 2 if h["stage"] == 0 else k):
                continue
            seen.add(h["chunk_id"])
            code = [x for x in kept if x["file"] == h["file"] and x["kind"] != "file" and h["kind"] != "file"]
            if any(x["start_line"] <= h["start_line"] and h["end_line"] <= x["end_line"] for x in code):
                continue
            inner = {x["chunk_id"] for x in code if h["start_line"] <= x["start_line"] and x["end_line"] <= h["end_line"]}
            kept = [x for x in kept if x["chunk_id"] not in inner] + [h]
        return [x["chunk_id"] for x in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(q, i, c) for q, hits in zip(batch.column("query").to_pylist(), batch.column("hits").to_pylist()) for i, c in enumerate(fold(hits), 1)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*rows) if rows else ([], [], []))], names=["query", "place", "chunk_id"])

    columns = ("stage", "rank", "chunk_id", "file", "kind", "start_line", "end_line")
    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("hits"))
    return lists.select(F.col("query").cast("long").alias("query"), "hits").mapInArrow(run, "query long, place long, chunk_id long")


def embed_hashed(texts: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """key and embedding: a signed hash of the words, for use where no model is at hand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for t in batch[text]:
                v = np.zeros(dims)
                for word in (t or "").lower().split():
                    h = xxhash.xxh64_intdigest(word)
                    v[h % dims] += 1.0 if h >> 63 else -1.0
                rows.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
            yield pd.DataFrame({key: batch[key], "embedding": rows})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def is_identifier_query(text: Column) -> Column:
    """A single ASCII name with an underscore or mixed case."""
    t = F.trim(text)
    return t.rlike(r"^[A-Za-z0-9_]{2,}$") & (F.contains(t, F.lit("_")) | (t.rlike("[a-z]") & t.rlike("[A-Z]")))
