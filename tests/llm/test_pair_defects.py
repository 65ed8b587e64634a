import random

import pytest

from strataloom.llm import pair_defects as pd_

KEY = ["pair_table", "id"]
SOUND = {
    "en": ["The cache is filled by `load_{0}` before the writer starts.", "Only `Reader{0}` knows the format of the file at line {0}.", "If the hash differs, `drop_{0}` removes the entry and asks for it again.", "It reads `conf/{0}.toml` first and then calls `apply_{0}`."],
    "de": ["Die Datei wird zuerst von `lade_{0}` gelesen und dann nicht mehr benutzt.", "Wenn der Wert fehlt, wird `setze_{0}` mit der Zahl {0} aufgerufen."],
    "fr": ["Le fichier est lu par `lit_{0}` et la valeur est gardée pour les autres.", "Quand la clé est absente, `cherche_{0}` ne fait pas une autre lecture."],
    "es": ["El archivo se lee con `lee_{0}` y después se guarda en la tabla.", "Cuando falta la clave, `busca_{0}` no hace una lectura para el valor."],
    "ko": ["`load_{0}`가 파일을 먼저 읽고 결과를 표에 저장한다.", "값이 없으면 `find_{0}`를 다시 부르지 않고 넘어간다."],
}
QUESTIONS = {"en": "What does `f_{0}` do when the file is missing?", "de": "Was macht `f_{0}`, wenn die Datei fehlt?", "fr": "Que fait `f_{0}` quand le fichier est absent ?", "es": "¿Qué hace `f_{0}` cuando falta el archivo?", "ko": "`f_{0}`는 파일이 없으면 어떻게 되나요?"}
REFUSAL = ["I'm sorry, but I cannot answer this.", "I don't know.", "No idea.", "My guidelines prevent me from talking about `X{0}`.", "Das weiß ich leider nicht.", "Je ne sais pas.", "No lo sé.", "모르겠습니다. 다른 질문을 해 주세요.", "As an AI language model, I am not able to read the repository."]
TRAPS = ["I am not sure why, but `a_{0}` calls `b_{0}` in line {0}.", "`x_{0}` cannot open the file while `y_{0}` holds it, so it returns None.", "The endpoint says \"sorry, not found\" with status 40{0} when `z_{0}` is empty.", "`Only{0}`", "See (core/a_{0}.py:1-{0})", "It is short:\n- `one_{0}`\n- `two_{0}`", "The comment says \"Die Datei wird nicht von der Klasse gelesen\" at line {0}.", "Run this:\n\n```python\nx = f({0}\n```", "You ask about `f_{0}`, and this is what the code shows: `a_{0}` writes it in line {0}.", "The words \"nicht\" and \"wird\" stand in the comment of line {0}, as `a_{0}` was written by someone else.", "It prints this and nothing else, which `b_{0}` reads:\n\n```python\nf({0})\n```", "Sorry for the length: `x_{0}` opens the file, then `y_{0}` closes it after line {0}."]


def planted(n, seed):
    rng, rows, truth = random.Random(seed), [], {}
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "fr", "es", "ko"])
        q, a = QUESTIONS[lang].format(i), " ".join(rng.choice(SOUND[lang]).format(i + k) for k in range(rng.randint(1, 3)))
        kind = rng.choices(["", "trap", *pd_.DEFECTS], [80, 8, 3, 3, 3, 3, 3])[0]
        if kind == "empty":
            a = rng.choice([None, "", " \n", "\u200b", "N/A", "...", "(no answer)", "``` ```", "<p></p>", "-", "TBD"])
        elif kind == "copy":
            a = rng.choice([q, q.lower(), f"**{q}**", f"> {q}", f"Question: {q}", q.replace("`", ""), f"Q: {q}\nA: {q}", q.rstrip("? ")])
        elif kind == "refusal":
            a = rng.choice(REFUSAL).format(i)
        elif kind == "other_language":
            a = " ".join(rng.choice(SOUND[rng.choice([x for x in SOUND if x != lang])]).format(i + k) for k in range(1))
        elif kind == "truncated":
            cut = rng.randint(len(a) // 3, len(a) - 3)
            while not (a[cut - 1].isalpha() and a[cut].isalpha()):
                cut -= 1
            a = rng.choice([a[:cut], a + "\n\n```python\nx = 1\n", a + "\n2.", a + " It does three things:", a + " `half_n"])
        elif kind == "trap" and lang == "en":
            a = rng.choice(TRAPS).replace("{0}", str(i))
        rows.append(("asks", i, q, a, "noise", 1.0))
        if kind in pd_.DEFECTS:
            truth[i] = kind
    return rows, truth


@pytest.fixture(scope="module")
def profiles(spark):
    """Languages learned from labelled texts, a tenth of them labelled wrongly."""
    rng, rows = random.Random(1), []
    for i in range(600):
        lang = rng.choice(["en", "de", "fr", "es", "ko"])
        text = " ".join(rng.choice([*SOUND[lang], QUESTIONS[lang]]).format(rng.randint(1, 999)) for _ in range(12))
        rows.append((text, rng.choice(["en", "de", "fr", "es", "ko", None]) if i % 10 == 0 else lang.upper() if i % 7 == 0 else lang, i))
    return pd_.learn_profiles(spark.createDataFrame(rows, "text string, lang string, doc_id int"))


def scored(spark, rows, profiles):
    """id to (labels, posterior of each form, pattern of each form)."""
    df = spark.createDataFrame(rows, "pair_table string, id bigint, question string, answer string, labels string, v_empty double")
    functions, votes = pd_.labelling_functions(), pd_.voted_pairs(df, KEY, profiles).collect()
    out = {r["id"]: ({}, {f: r[f"v_{f}"] for f in pd_.FORMS}) for r in votes}
    for f in pd_.FORMS:
        counts = {}
        for r in votes:
            counts[r[f"v_{f}"]] = counts.get(r[f"v_{f}"], 0) + 1
        fitted = pd_.fit_label_model(counts, len(functions[f]))
        for r in votes:
            out[r["id"]][0][f] = fitted[r[f"v_{f}"]]
    return out


def best_cutoffs(posterior, truth):
    """Of each form the range of cutoffs with the best F1 of its defect, other forms of the defect at their cutoffs."""
    ranges = {}
    for f, defect in pd_.FORMS.items():
        siblings = [x for x, d in pd_.FORMS.items() if d == defect and x != f]
        scores = []
        for cut in [c / 100 for c in range(1, 100)]:
            found = {i for i, (p, _) in posterior.items() if p[f] > cut or any(p[x] > pd_.CUTOFFS[x] for x in siblings)}
            right = sum(truth.get(i) == defect for i in found)
            others = sum(i in truth and truth[i] != defect for i in found)  # a record may have several labels
            total = sum(d == defect for d in truth.values())
            scores.append((2 * right / max(1, len(found) - others + total), cut))
        top = max(scores)[0]
        ranges[f] = (min(c for x, c in scores if x == top), max(c for x, c in scores if x == top))
    return ranges


def test_cutoffs_hold_on_a_held_out_labelled_split(spark, profiles):
    """Every cutoff lies where F1 is best on pairs that no model was fitted to choose by."""
    rows, truth = planted(6000, 21)
    ranges = best_cutoffs(scored(spark, rows, profiles), truth)
    assert all(low <= pd_.CUTOFFS[f] <= high for f, (low, high) in ranges.items()), ranges
    assert len(set(pd_.CUTOFFS.values())) == len(pd_.CUTOFFS)


def test_planted_defects_are_found_at_the_cutoffs(spark, profiles):
    """Held-out accuracy: at least 0.97 precision and recall on pairs that shaped no function."""
    rows, truth = planted(3000, 11)
    df = spark.createDataFrame(rows, "pair_table string, id bigint, question string, answer string, labels string, v_empty double")
    labelled = pd_.label_pairs(df, KEY, profiles)
    found = {r["id"]: r["defect"] for r in pd_.main_defect(labelled, KEY).collect()}
    right = sum(truth.get(i) == d for i, d in found.items())
    missed = [(rows[i][2], rows[i][3], d, found.get(i)) for i, d in truth.items() if found.get(i) != d]
    wrong = [(rows[i][2], rows[i][3], d) for i, d in found.items() if truth.get(i) != d]
    assert right / len(truth) >= 0.97, (right, len(truth), missed[:8])
    assert right / len(found) >= 0.97, (right, len(found), wrong[:8])


def test_the_model_decides_not_any_function(spark, profiles):
    """Taking every pair on which some function fires changes most labels and loses accuracy; so does any single function."""
    rows, truth = planted(3000, 13)
    posterior = scored(spark, rows, profiles)
    labels = fires = more = 0
    for f, defect in pd_.FORMS.items():
        have = {i for i, d in truth.items() if d == defect}
        model = {i for i, (p, _) in posterior.items() if p[f] > pd_.CUTOFFS[f]}
        fired = {i for i, (_, v) in posterior.items() if v[f]}
        labels, fires, more = labels + len(model), fires + len(fired), more + len(fired - have) - len(model - have)
        assert model <= fired and len(fired - have) >= len(model - have), f
        for k, (name, _) in enumerate(pd_.labelling_functions()[f]):
            assert fired == set() or {i for i, (_, v) in posterior.items() if v[f] == 1 << k} & model == set(), (f, name)
    assert fires > 2 * labels and more > labels, (labels, fires, more)


def test_nulls_repeats_and_empty_tables(spark, profiles):
    schema = "pair_table string, id bigint, question string, answer string"
    df = spark.createDataFrame([("asks", 1, None, None), ("asks", 2, None, "Fine, `a_b` does it."), ("asks", 1, None, None), ("answers", 1, "q", ""), ("asks", 3, "", "word " * 50_000 + "end."), ("asks", 4, "why", "a" * 200_000 + "."), ("asks", 5, "why", "a/" * 100_000 + "."), ("asks", 6, "why", "x.y! " * 40_000), ("asks", 7, "a" * 9, "a" * 100_000 + ".")], schema)
    rows = {(r["pair_table"], r["id"]): list(r["labels"]) for r in pd_.label_pairs(df, KEY, profiles).collect()}
    assert rows.items() >= {("asks", 1): ["empty"], ("asks", 2): [], ("answers", 1): ["empty"], ("asks", 3): []}.items() and len(rows) == 8
    assert pd_.label_pairs(df.limit(0), KEY, profiles).count() == 0


def test_label_model_learns_from_patterns_only():
    fitted = pd_.fit_label_model({0b000: 9000, 0b100: 400, 0b001: 90, 0b011: 60, 0b111: 80, 0b110: 10}, 3)
    assert max(fitted[p] for p in (0b000, 0b100, 0b001)) < 0.5 < min(fitted[p] for p in (0b011, 0b111))
    assert set(pd_.fit_label_model({0: 1}, 3)) == {0}


def test_languages_are_learned_from_labelled_texts(spark, profiles):
    assert all({"en": "the", "de": "nicht", "fr": "est", "es": "lee"}[x] in words for x, words in profiles.items())
    assert all(not set(profiles[x]) & set(profiles[y]) for x in profiles for y in profiles if x != y)
    empty = spark.createDataFrame([(None, "en"), ("x", None), ("", "de")], "text string, lang string")
    assert pd_.learn_profiles(empty) == {x: [] for x in pd_.LATIN}


def test_several_labels_are_kept(spark, profiles):
    """A copied question that lost its mark both repeats and breaks off."""
    rows, _ = planted(3000, 12)
    df = spark.createDataFrame(rows, "pair_table string, id bigint, question string, answer string, x string, y double")
    assert ("copy", "truncated") in {tuple(r["labels"]) for r in pd_.label_pairs(df, KEY, profiles).collect()}


DECLINES = [
    "I do not know.", "As an AI, nothing to add here.", "Tut mir leid.", "Je n'ai pas accès au code.", "Je n'ai pas le droit de répondre.", "I don't know.", "I'd rather leave it.", "I am afraid it is gone.", "I never saw it.", "No idea.", "That is not my area.",
    "Our policy stops me.", "It is out of scope.", "I must decline.", "It would not be right.", "Pass.", "Skip!", "Unknown.", "모릅니다.", "Das weiß ich nicht.", "Ich weiß es nicht.", "Keine Ahnung.", "Ich habe keinen Zugriff.", "No lo sé.", "Lo siento.", "No dispongo de eso.", "Me niego.",
    "Je ne sais pas.", "Désolé.", "C'est impossible de répondre.", "Il m'est impossible de le dire.", "Je refuse.", "Je regrette.",
]


def test_every_wording_of_a_refusal_is_searched(spark):
    rows = [("asks", i, "What does `f_1` do when the file is missing?", a) for i, a in enumerate(DECLINES)]
    prepared = pd_._prepared(spark.createDataFrame(rows, "pair_table string, id bigint, __q string, __a string"), {})
    assert [a for a, hit in prepared.select("__a", "__hit").collect() if not hit] == []
    sound = pd_._prepared(spark.createDataFrame([("asks", 1, "q", "The cache is filled by `load`."), ("asks", 2, "q", None)], "pair_table string, id bigint, __q string, __a string"), {})
    assert [r["__hit"] for r in sound.collect()] == [False, False]
