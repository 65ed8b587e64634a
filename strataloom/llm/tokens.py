"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts up to `LONG_CHARS` are encoded where they are read. Longer ones are cut where the
tokenizer's own pattern breaks, the pieces are spread over the cluster as rows and encoded
there, and the document's ids are put together again. A stretch that the pattern doesn't split
and that is itself long is cut although the tokenizer would not break there; its parts are
joined as a tree, and at each join the tokens around it are decoded and encoded again in a
window that grows until the new tokens agree with the old ones on both sides, so the ids are
exactly those of the whole text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut_lineage, spread

#: Where the vocabulary files lie unless the caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters above which a text is spread over several rows.
LONG_CHARS = 1 << 18
#: Characters of one row of a spread text, about.
PIECE_CHARS = 1 << 16
#: Bytes above which an unsplit stretch is halved.
HALF_BYTES = 1 << 10
#: Tokens at either side of a join that are encoded again at first.
WINDOW = 8

# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """The vocabulary with exact encoding of texts and concatenation of encoded halves."""

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.bpe = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pretokens = regex.compile(PATTERN)

    def piece(self, piece: str, stretch: int) -> list[int]:
        """Ids of a piece of `_cuts`: of a text, or of a part of one unsplit stretch."""
        return self.text(piece) if stretch < 0 else self.tree(piece.encode("utf-8", "replace"))

    def together(self, pieces: list[tuple[int, list[int]]]) -> list[int]:
        """Ids of (stretch, ids) in order: the parts of one stretch are joined as a tree, the rest is laid end to end."""
        out, i = [], 0
        while i < len(pieces):
            stretch, j = pieces[i][0], i + 1
            while stretch >= 0 and j < len(pieces) and pieces[j][0] == stretch:
                j += 1
            out += self.level(list(map(list, (ids for _, ids in pieces[i:j]))))
            i = j
        return out

    def level(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def text(self, text: str) -> list[int]:
        """Ids of a text without special tokens; lone surrogates count as U+FFFD."""
        if len(text) >= HALF_BYTES and max(map(len, text.split()), default=0) >= HALF_BYTES:
            return [i for p in self.pretokens.findall(text) for i in self._pretoken(p)]
        return self.bpe.encode_ordinary(text)

    def _pretoken(self, pretoken: str) -> list[int]:
        raw = pretoken.encode("utf-8", "replace")
        return self.tree(raw) if len(raw) > HALF_BYTES else self._merge(raw)

    def _merge(self, raw: bytes) -> list[int]:
        """Plain merges of bytes that no pattern splits."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        return self.bpe._core_bpe.encode_single_piece(raw) if len(raw) > 1 else [self.ranks[raw]]

    def tree(self, raw: bytes) -> list[int]:
        """Ids of one unsplit stretch: halves, each encoded alone, joined level by level."""
        return self.level([self._merge(raw[i : i + HALF_BYTES]) for i in range(0, len(raw), HALF_BYTES)])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the bytes of `left` and `right` together.

        The window's new ids are taken when they start with the old id before the join's first
        change and end with the old id after its last: a sequence is the encoding of its bytes
        when every two neighbours are, and the neighbours across both edges of the window are
        old neighbours then.
        """
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            new = self._merge(b"".join(map(self.bytes_of.__getitem__, a + b)))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or new[0] == a[0]) and (whole_right or new[-1] == b[-1]):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            size *= 2


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(vocabulary)


def _cuts(text: str, pretokens) -> list[tuple[str, int]]:
    """Pieces of a long text and, for those that need a join, the number of the stretch they are part of (else -1).

    A text is cut before white space that follows something else. Where that is missing for long,
    the stretch is cut between pretokens, and a pretoken that is long itself anywhere; only the
    pieces of such a pretoken depend on each other.
    """
    import regex

    cut = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\r\n])")  # white space to every library's mind
    pieces, at, stretch = [], 0, 0
    while at < len(text):
        found = cut.search(text, at + PIECE_CHARS)
        end = found.start() if found else len(text)
        if end - at <= 2 * PIECE_CHARS:
            pieces.append((text[at:end], -1))
        else:
            begun = at
            for p in pretokens.finditer(text, at, end):
                if p.end() - p.start() > PIECE_CHARS:
                    if begun < p.start():
                        pieces.append((text[begun : p.start()], -1))
                    pieces += [(p[0][i : i + PIECE_CHARS], stretch) for i in range(0, len(p[0]), PIECE_CHARS)]
                    begun, stretch = p.end(), stretch + 1
                elif p.end() - begun > PIECE_CHARS:
                    pieces.append((text[begun : p.end()], -1))
                    begun = p.end()
            if begun < end:
                pieces.append((text[begun:end], -1))
        at = end
    return pieces


def _lists(ids: list[list[int] | None], counts_only: bool) -> pa.Array:
    if counts_only:
        return pa.array([None if x is None else len(x) for x in ids], pa.int64())
    return pa.array(ids, pa.list_(pa.int32()))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, long_chars: int = LONG_CHARS, counts_only: bool = False) -> DataFrame:
    """`key` and ids (array<int>) of every row; with `counts_only` n_tokens (bigint) instead of ids.

    A null text gets null, an empty one an empty list; blank texts are texts. Repeated rows are
    encoded each, so equal rows give one row each. An empty table gives an empty result and further
    columns are ignored.
    """
    out, out_type = ("n_tokens", "bigint") if counts_only else ("ids", "array<int>")
    kind = documents.schema[key].dataType.simpleString()
    rows = spread(documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")))
    is_long = F.coalesce(F.length("__text") > long_chars, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("__key"), _lists([None if t is None else own.text(t) for t in texts], counts_only)], names=["__key", out])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for k, row, t in zip(*(batch.column(c).to_pylist() for c in ("__key", "__row", "__text"))):
                pieces, stretches = zip(*_cuts(t, own.pretokens))
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n, batch.schema.field("__key").type), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(stretches, pa.int32()), pa.array(pieces, pa.string())],
                    names=["__key", "__row", "seq", "stretch", "piece"],
                )

    def pieces_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            ids = [own.piece(p, x) for p, x in zip(batch.column("piece").to_pylist(), batch.column("stretch").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__row"), batch.column("seq"), batch.column("stretch"), _lists(ids, False)], names=["__key", "__row", "seq", "stretch", "ids"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            whole = [own.together([(p["stretch"], p["ids"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), _lists(whole, counts_only)], names=["__key", out])

    done = rows.where(~is_long).mapInArrow(short, f"__key {kind}, {out} {out_type}")
    # The numbers are written with the rows, so that a retried stage can't number them anew.
    long_rows = cut_lineage(rows.where(is_long).withColumn("__row", F.monotonically_increasing_id()))
    pieces = long_rows.mapInArrow(cut, f"__key {kind}, __row bigint, seq int, stretch int, piece string").repartition("__key", "seq")
    encoded = pieces.mapInArrow(pieces_ids, f"__key {kind}, __row bigint, seq int, stretch int, ids array<int>")
    # One group is one row of the input, and its result is one row again.
    parts = encoded.groupBy("__key", "__row").agg(F.array_sort(F.collect_list(F.struct("seq", "stretch", "ids"))).alias("parts"))
    joined = parts.select("__key", "parts").mapInArrow(together, f"__key {kind}, {out} {out_type}")
    return done.unionByName(joined).withColumnRenamed("__key", key)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` and n_tokens of the rows with text; null texts are left out, an empty text has 0."""
    return encode(documents.where(F.col(text).isNotNull()), key, text, vocabulary, counts_only=True)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of an array of ids."""

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        own = encoder(vocabulary)
        return rows.map(lambda r: None if r is None else b"".join(own.bytes_of[int(i)] for i in r).decode("utf-8", "replace"))

    return texts(ids)
