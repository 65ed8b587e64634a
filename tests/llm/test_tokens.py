import random

import pytest
from pyspark.sql import functions as F

from strataloom.llm import packing, tokens

HF = tokens.VOCABULARY.replace(".tiktoken", ".json")


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(HF)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "\n\n\t ", "plain words, it's fine", "한국어 텍스트와 code_like(x)", "\u200b\x00\x1c\x85odd \ufeff", "a\r\n b\r\n", "<|endoftext|> stays text", "🙂" * 50, "x" * 5000, "ab" * 4000 + " " + "한" * 3000, "=" * 3000 + "1" * 2000, "a\x1cb" * 900]


def test_ids_of_a_second_library(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (0, TEXTS[0], "x")], "doc_id bigint, text string, ids string")
    found = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert found[99] is None and found[0] == []
    assert all(found[i] == reference(t) for i, t in enumerate(TEXTS))
    assert tokens.encode(df).count() == len(TEXTS) + 2
    assert tokens.encode(df.limit(0)).count() == 0


def test_long_texts_are_spread_and_joined_exactly(spark, reference, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 300)
    rng = random.Random(3)
    long = "".join(rng.choice(["word ", "두 단어\n", "x_y(1) ", "\r\n", "  ", "é" * 9, "日本", "'ll "]) for _ in range(3000))
    unsplit = "".join(rng.choice(["abc", "한국", "12", "--", "'s", "Xyz", "é"]) for _ in range(2000)) + "q" * 2000 + "".join(rng.choice("ab") for _ in range(5000)) + "漢" * 3000
    df = spark.createDataFrame([(1, long), (2, "z" * 9000), (3, long), (1, long), (4, unsplit), (5, "x " + unsplit + " y")], "doc_id bigint, text string")
    rows = tokens.encode(df, long_chars=200).collect()
    want = {1: reference(long), 2: reference("z" * 9000), 3: reference(long), 4: reference(unsplit), 5: reference("x " + unsplit + " y")}
    assert len(rows) == 6 and all(r["ids"] == want[r["doc_id"]] for r in rows)
    counts = tokens.encode(df, long_chars=200, counts_only=True).collect()
    assert all(r["n_tokens"] == len(want[r["doc_id"]]) for r in counts)


def test_joins_at_every_place():
    encoder, rng = tokens.Encoder(tokens.VOCABULARY), random.Random(1)
    for alphabet in ("ab", "etaoinshr", "0123456789", "한국어글", "=-#*", "é漢🙂"):
        raw = "".join(rng.choice(alphabet) for _ in range(120)).encode()
        whole = encoder._merge(raw)
        assert all(encoder.join(encoder._merge(raw[:i]), encoder._merge(raw[i:])) == whole for i in range(1, len(raw)))


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    back = tokens.encode(df).join(df, "doc_id").select("doc_id", "text", tokens.decode(F.col("ids")).alias("again")).collect()
    assert len(back) == len(TEXTS) and all(r["text"] == r["again"] for r in back)


@pytest.mark.parametrize("partitions", [1, 40])
def test_packing_keeps_every_token_once(spark, partitions):
    rng = random.Random(partitions)
    sizes = [(i, rng.choice([0, 1, 7, 50, rng.randint(1, 100), 100, 101, 350])) for i in range(2000)]
    df = spark.createDataFrame(sizes + [(5000, None), (5001, -3)], "doc_id bigint, n_tokens bigint").repartition(partitions)
    rows = packing.pack(df, capacity=100, open_windows=8).collect()
    pieces, fill = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["part"], r["start"], r["n_tokens"]))
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
    assert max(fill.values()) <= 100 and set(pieces) == {i for i, _ in sizes}
    for i, n in sizes:
        own = sorted(pieces[i])
        assert sum(p[2] for p in own) == n and len(own) == max(1, -(-n // 100))
        assert [p[1] for p in own] == [100 * k for k in range(len(own))]
    assert sum(fill.values()) / (100 * sum(1 for v in fill.values() if v)) > 0.985


def test_leftovers_of_many_partitions_are_merged_to_the_bound(spark):
    """Forty short partitions leave little but leftovers; merged, they must fill like one sorted list."""
    rng = random.Random(7)
    sizes = [(i, rng.randint(51, 90)) for i in range(600)] + [(600 + i, rng.randint(1, 40)) for i in range(1200)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").repartition(40)
    used = packing.pack(df, capacity=100, open_windows=40).select("container").distinct().count()
    rooms = []  # best fit over all items from the largest down, with every container open
    for n in sorted((n for _, n in sizes), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 100) - n)
    assert used <= 1.02 * len(rooms), (used, len(rooms))


def test_packing_documents(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "w " * 5000), (1, "a b c")], "doc_id bigint, text string")
    rows = packing.pack_documents(df).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 1, 3, 4, 4] and packing.fill_report(packing.pack_documents(df)).where("unused < 0").count() == 0
    assert packing.pack_documents(df.limit(0)).count() == 0
