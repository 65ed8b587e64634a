import random
import re

from strataloom.llm import shared_spans


def brute(texts, span):
    """Positions in runs of `span` words that another document has too, by comparing all runs."""
    words = {k: re.findall(r"[^ \t\r\n]+", t or "") for k, t in texts.items()}
    owners = {}
    for k, w in words.items():
        for i in range(len(w) - span + 1):
            owners.setdefault(tuple(w[i : i + span]), set()).add(k)
    out = {}
    for k, w in words.items():
        covered = {j for i in range(len(w) - span + 1) if len(owners[tuple(w[i : i + span])]) > 1 for j in range(i, i + span)}
        if covered:
            out[k] = len(covered)
    return out


def test_cover_meets_every_pair():
    for i in range(shared_spans.PERIOD):
        for j in range(shared_spans.PERIOD):
            assert any((i + s) % shared_spans.PERIOD in shared_spans.COVER and (j + s) % shared_spans.PERIOD in shared_spans.COVER for s in range(shared_spans.PERIOD))


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "낱말", "x,", "é"]) + str(rng.randint(0, 200))
    passages = [[word() for _ in range(rng.choice([38, 39, 40, 41, 57, 90]))] for _ in range(8)]
    texts = {}
    for k in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 60))] + (rng.choice(passages) if rng.random() < 0.5 else [])
        texts[k] = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for w in words)
    texts[n] = texts[0]
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed) | {900: None, 901: "", 902: " \n ", 903: "A b " * 40, 904: "A b " * 60, 905: "a b " * 60}
        df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()] + [(1, texts[1], "x", 1), (None, texts[1], "x", 1)], "doc_id bigint, text string, h string, pos int")
        found = {r["doc_id"]: r["n_shared"] for r in shared_spans.shared_words(df).collect()}
        assert found == brute(texts, 40)


def test_separators_are_only_the_four(spark):
    run = [f"w{i}" for i in range(40)]
    texts = {1: " ".join(run), 2: "\u00a0".join(run), 3: "\t".join(run) + "\x0b", 4: "\r\n".join(run) + " tail", 5: " ".join(run[:39])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_shared"] for r in shared_spans.shared_words(df).collect()} == {1: 40, 4: 40} == brute(texts, 40)


def test_long_copies_and_empty_table(spark):
    text = " ".join(f"t{i % 977}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    assert {r["n_shared"] for r in shared_spans.shared_words(df).collect()} == {60_000}
    assert shared_spans.shared_words(df.limit(0)).count() == 0
