"""Broken question–answer pairs: noisy labelling functions combined by an expectation-maximization label model.

Each defect has five or more noisy labelling functions, written as Spark columns. None of them
decides alone: a latent-class model per defect learns how often each function fires on
defective and on sound pairs, never less than once in a hundred on sound ones, so that a label needs
functions that agree. The model sees only the counts of vote patterns (at most 2**functions of
them, gathered by an aggregation), so its cost doesn't depend on the number of pairs. Every
defect whose posterior exceeds its cutoff is kept as a label. Languages are told apart by the
words that a bounded sample of labelled texts uses much more in one language than in the others.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut_lineage, spread

#: Languages written in Latin letters; Korean is known by its script.
LATIN = ("en", "de", "es", "fr")
#: Labelled texts of each language, words of each text and words of each profile from which languages are learned, at most.
SAMPLE_TEXTS, SAMPLE_WORDS, PROFILE_WORDS = 2_000, 2_000, 500
# Letters that only one of the Latin languages has.
OWN_LETTERS = {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "àâçèêëîïôùûœ"}
# What stands for an absent answer.
PLACEHOLDERS = "none null nil na nan undefined empty noanswer noresponse tbd todo tba pending missing blank unanswered answer placeholder answerhere youranswerhere xxx lorem 답변없음 없음 미정 keineantwort keine leer sinrespuesta vacío aucuneréponse vide ninguna aucune".split()
# Words that introduce a repeated question.
LABELS = "question q a answer you asked ask youask youasked thequestionis thequestionwas query prompt user 질문 답변 질문은 답 문 frage antwort siefragten pregunta respuesta preguntaste réponse vousdemandez r p f".split()
# Phrases by which an answer declines or says that it does not know.
REFUSALS = (
    r"\bI(?:'m| am)? (?:really |simply |honestly )?(?:can't|cannot|can not|couldn't|could not|won't|will not|don't|do not|must decline|decline|refuse|am unable|am not able|have to pass|would rather not|prefer not|haven't|have not|never)\b",
    r"\bI'd (?:rather|prefer)\b|\bI(?:'m| am) (?:sorry|afraid|unable|not able|not allowed|not permitted|not sure|not familiar|not in a position)\b|\bI never (?:looked|saw|worked)",
    r"\b(?:no idea|no clue|not my area|no comment|can't help|cannot help|unable to (?:provide|answer|help|comment|explain|assist)|outside of what i|guidelines prevent|policy|as an ai|language model|don't have access|not able to|out of scope|must decline|decline to|would not be (?:appropriate|right|proper|possible)|not (?:comfortable|at liberty)|can't say|can't really tell|rather not)\b",
    r"^\W*(?:pass|skip|sorry|no idea|unfortunately|unknown)\b",
    r"모르겠|모릅니다|답변(?:을|드리|드릴)|답변을 거절|도와드릴 수 없|말씀드리기 어렵|설명하지 못하|넘어갈게요|대답할 수 없|알 수 없습니다|죄송|답할 수 없|접근할 수 없어서|드릴 수 없",
    r"weiß ich nicht|ich weiß (?:es )?nicht|nicht beantworten|nicht helfen|keine auskunft|keine ahnung|leider (?:nicht|kann|kein)|tut mir leid|darf ich|keinen zugriff|ich kann (?:dazu |das |diese )?(?:leider )?nicht|möchte ich (?:lieber )?nicht|bin nicht befugt",
    r"no lo sé|no sé|lo siento|no puedo|no me es posible|no tengo (?:acceso|idea|permitido)|prefiero no|no estoy (?:autorizado|seguro)|me niego|no dispongo",
    r"je ne sais pas|désolé|je ne peux pas|je ne suis pas|préfère ne pas|impossible de répondre|m'est impossible|aucune idée|je n'ai pas (?:accès|le droit)|je refuse|je regrette",
)
APOLOGIES = r"\b(?:sorry|unfortunately|afraid|honestly|please ask|anything else you would like|ask someone|désolé|merci de demander|lo siento|pregunte a|es tut mir leid|leider|bitte fragen sie)\b|죄송|다른 질문을 해 주세요|모르겠"
CONTRAST = r"\b(?:but|though|although|however|yet|still|aber|jedoch|allerdings|pero|aunque|mais|cependant|toutefois)\b|지만|그러나|다만"


def _lowered(pattern: str) -> str:
    """A pattern for lower-cased text: matching without regard to case is slow."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


REFUSAL, APOLOGY = "|".join(f"(?:{_lowered(p)})" for p in REFUSALS), _lowered(APOLOGIES)

#: Defects in the order in which one is chosen where a record may have one only.
DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Forms in which a defect comes, each with functions and a label model of its own; a form that isn't named is its defect.
FORMS = {**{d: d for d in DEFECTS[:-1]}, "broken_text": "truncated", "broken_code": "truncated", "broken_list": "truncated"}
#: Posterior above which a label is kept: one of those with the best F1 on held-out labelled pairs, see tests/llm/test_pair_defects.py.
CUTOFFS = {"empty": 0.67, "copy": 0.55, "refusal": 0.95, "other_language": 0.7, "broken_text": 0.6, "broken_code": 0.52, "broken_list": 0.5}
#: Where the label model starts: how often a function fires on defective and on sound pairs, and the share of defective ones.
START_SENSITIVITY, START_FALSE, START_SHARE = 0.6, 0.05, 0.02
#: Weight of the starting point against what is learned, as a share of the pairs.
PRIOR_WEIGHT = 0.002
#: Bounds of what is learned: no function may be trusted alone.
SENSITIVITY, FALSE = (0.02, 0.98), (0.01, 0.6)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _prose(text: Column) -> Column:
    """Text without code, quotations, addresses and names from code."""
    steps = [r"(?s)```.*?(?:```|$)", r"`[^`\n]*`?", r'"[^"\n]*"', r"[“«„][^”»“\n]*[”»“]", r"(?m)^>.*$", r"(?<![\w.-])[\w.-]+/[\w./-]+", r"\b\w*(?:_\w+|[a-z][A-Z]\w*)\b", r"<[^>]{0,200}>", r"[\d_]+"]
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), steps, text)


def _names(text: Column) -> Column:
    """Names and numbers that inform: paths, names with underscore or inner capital, numbers."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?<![\w.-])[\w.-]+/[\w./-]+|\b\w*(?:_|[a-z][A-Z]|\d\d)\w*)"), F.lit(1)))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", "")


def learn_profiles(texts: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_TEXTS, words: int = PROFILE_WORDS) -> dict[str, list[str]]:
    """Of each Latin language the words that its texts use most among those four times as frequent as in any other.

    A bounded sample of labelled texts is looked at: about `sample` of each language, those with the
    smallest hashes, with their first `SAMPLE_WORDS` words. Wrong labels are outvoted; other languages,
    null texts and labels are left out. A language without texts has no words.
    """
    known = texts.where(F.lower(lang).isin(*LATIN) & (F.length(text) > 0)).select(F.lower(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # at most one row a language
    share = reduce(lambda x, y: x.when(F.col("lang") == y, F.lit(min(1.0, sample / max(1, sizes.get(y, 0))))), LATIN[1:], F.when(F.col("lang") == LATIN[0], F.lit(min(1.0, sample / max(1, sizes.get(LATIN[0], 0))))))
    some = known.where(F.shiftrightunsigned(F.xxhash64("text"), 11) < share * F.lit(float(1 << 53)))  # where it is read: no text is moved
    words_of = F.slice(F.split(F.lower(_prose(F.col("text"))), r"[^\p{L}']+"), 1, SAMPLE_WORDS)
    each = some.select("lang", F.explode(words_of).alias("word")).where("word <> ''")
    counted = each.groupBy("word").agg(*(F.count_if(F.col("lang") == x).alias(x) for x in LATIN))
    # One bounded table of words by language; its totals and the best words of each language are a few rows.
    counted = cut_lineage(counted)
    total = counted.agg(*(F.sum(x).alias(x) for x in LATIN)).first()
    share = counted.select("word", *((F.col(x) / F.lit(total[x] or 1)).alias(x) for x in LATIN))
    profiles = {}
    for x in LATIN:
        others = F.greatest(*(F.col(y) for y in LATIN if y != x))
        own = share.where((F.col(x) >= 0.00005) & (F.col(x) >= 4 * others)).orderBy(F.desc(x), "word").limit(words)
        profiles[x] = [r["word"] for r in own.collect()]
    return profiles


def labelling_functions() -> dict[str, list[tuple[str, Column]]]:
    """Of each form of a defect (name, column of 0 or 1) over the columns that `_prepared` adds."""
    col = F.col
    tail = col("__tail")
    fences = _count(tail, "```")
    ticks = F.length(F.regexp_replace(tail, r"(?s)```.*?```|[^`]+", ""))
    held = (F.length("__bq") >= 8) & (F.length("__left") < F.length("__ba"))
    label = "^(?:" + "|".join(sorted(LABELS, key=len, reverse=True)) + ")*$"
    total = sum((col(f"__a_{x}") for x in LATIN), F.lit(0))
    best = F.greatest(*(col(f"__a_{x}") for x in LATIN))
    own = F.coalesce(*(F.when(col("__lang") == x, col(f"__a_{x}")) for x in LATIN), F.lit(0))
    latin, korean = col("__lang").isin(*LATIN), col("__lang") == "ko"
    letters, hangul, informs = col("__letters"), col("__hangul"), col("__informs")
    foreign = reduce(lambda x, y: x | y, ((col("__lang") != x) & (col(f"__m_{x}") >= 2) for x in OWN_LETTERS))
    home = reduce(lambda x, y: x | y, ((col("__lang") == x) & (col(f"__m_{x}") >= 1) for x in OWN_LETTERS))
    signs = F.length(F.regexp_replace("__plain", r"[^\p{L}\p{N}]+", ""))
    short_plain = F.length("__plain") < 40
    open_fence = fences % 2 == 1
    lines, last_line = F.contains(tail, F.lit("\n")), F.substring_index(tail, "\n", -1)
    last_piece = F.element_at(F.split(last_line, r"(?<=[.!?。！？:])\s+"), -1)
    found = {
        "empty": [
            ("blank", F.length(F.trim("__seen")) == 0),
            ("no_letters", F.when(short_plain, signs == 0)),
            ("placeholder", F.when(short_plain, F.regexp_replace(F.lower("__plain"), r"[^\p{L}\p{N}]+", "").isin(*PLACEHOLDERS))),
            ("tiny", F.when(short_plain, signs < 4)),
            ("little_prose", (letters < 16) & ~(informs & (signs >= 4))),
            ("wrapped", F.when(short_plain & (~informs | (signs < 4)), col("__plain").rlike(r"^[^\p{L}\p{N}].*[^\p{L}\p{N}]$|^[^\p{L}\p{N}]?$"))),
            ("one_word", F.when(short_plain & (~informs | (signs < 4)), col("__plain").rlike(r"^[^ ]*(?: [^ ]+)?$") & ~col("__plain").rlike(r"[.!?。]$"))),
        ],
        "copy": [
            ("holds_question", held),
            ("only_labels_left", F.when(held & (F.length("__left") < 100), F.regexp_like(F.col("__left"), F.lit(label)))),
            ("nothing_new", ~informs & (F.length("__bq") > 0) & (letters > 0)),
            ("as_long", (F.length("__ba") <= 2.2 * F.length("__bq") + 20) & (F.length("__ba") >= 0.7 * F.length("__bq")) & (F.length("__bq") > 0)),
            ("mostly_question", held & (F.length("__left") <= 0.3 * F.length("__ba"))),
        ],
        "refusal": [
            ("phrase", col("__hit")),
            ("apology", F.regexp_like(col("__searched"), F.lit(APOLOGY))),
            ("tells_nothing", ~informs & (letters > 3)),
            ("short", (letters > 3) & (letters < 160)),
            ("every_sentence", F.when(col("__hit"), F.size(F.filter(F.split("__la", r"[.!?。\n]+"), lambda x: (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) > 1) & ~(F.regexp_like(x, F.lit(REFUSAL)) | F.regexp_like(x, F.lit(APOLOGY))))) == 0)),
            ("no_turn", F.when(col("__hit"), ~(F.regexp_like(col("__la"), F.lit(CONTRAST)) & informs))),
        ],
        "other_language": [
            ("other_script", (latin & (hangul > 0.3 * letters) & (letters >= 6)) | (korean & (hangul == 0) & (letters >= 12))),
            ("other_words", (latin & (best > own)) | (korean & (best >= 1))),
            ("many_other_words", ((latin & (best >= own + 2)) | (korean & (best >= 3) & (hangul < 0.2 * letters)))),
            ("few_own_words", ((latin & (own <= 0.34 * total) & (total + hangul >= 1)) | (korean & (hangul < 0.1 * letters)))),
            ("other_letters", (latin & foreign & ~home) | (korean & foreign) | (latin & (hangul > 6))),
            ("no_own_words", (latin & (own == 0) & (letters >= 30)) | (korean & (hangul == 0) & (letters >= 12))),
        ],
        "broken_text": [
            ("ends_in_word", ~open_fence & tail.rlike(r"[\p{L}\p{N}_]$") & tail.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]")),
            ("no_stop", ~open_fence & (letters > 3) & (~tail.rlike(r"[.!?。！？)\]}`\"'”»]$") | tail.rlike(r"[^.]\.\.\.$"))),
            ("open_backtick", ~open_fence & (ticks % 2 == 1)),
            ("hanging_sign", ~open_fence & tail.rlike(r"(?:[\p{L}\p{N}`)\]\"'][ ]?[,;:(\[{…/&+=<–—-]{1,9}|\.\.\.)$")),
            ("open_bracket", ~open_fence & (F.length(F.regexp_replace("__unfenced", r"[^(]+", "")) > F.length(F.regexp_replace("__unfenced", r"[^)]+", "")))),
            ("fragment", ~open_fence & last_piece.rlike(r"(?:[^.!?。！？)\]}`\"'”»\s]|\.\.\.)$")),
            ("inside_name", ~open_fence & (ticks % 2 == 1) & tail.rlike(r"[\w./-]$")),
        ],
        "broken_code": [
            ("odd_fences", open_fence),
            ("no_fence_at_end", (fences > 0) & ~tail.rlike(r"```$") & ~tail.rlike(r"```\s*\n[^`]*[.!?。:]$")),
            ("ends_like_code", (fences > 0) & last_line.rlike(r"[=(){}\[\]:\"'\w]$|^[ \t]")),
            ("code_line_last", (fences > 0) & ~last_line.rlike(r"^```$") & last_line.rlike(r"[=({\[:]|^[ \t]|^```\w|^(?:return|pass|break|continue|else|try|raise)\b")),
        ],
        "broken_list": [
            ("bare_list_mark", lines & last_line.rlike(r"^[ \t]*(?:[-*•+]|\d{1,3}[.)])$")),
            ("short_last_line", lines & (F.length(last_line) < 9) & ~last_line.rlike(r"\p{L}|[`}\])]$")),
            ("list_before", tail.rlike(r"(?:^|\n)[ \t]*(?:[-*•+]|\d{1,3}[.)])[ \t][^\n]*\n")),
            ("mark_last", last_line.rlike(r"(?:^|\s)(?:[-*•+]|\d{1,3}[.)])$")),
        ],
    }
    return {d: [(n, F.coalesce(c.cast("int"), F.lit(0))) for n, c in fs] for d, fs in found.items()}


def _is_in(words: list[str]):
    return lambda word: word.isin(*words) if words else F.lit(False)


def _prepared(pairs: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """Pairs with what several functions look at, each computed once."""
    q, a = F.coalesce("__q", F.lit("")), F.coalesce("__a", F.lit(""))
    df = pairs.withColumns({"__pa": _prose(a), "__pq": _prose(q), "__bq": _bare(q), "__ba": _bare(a), "__seen": F.regexp_replace(a, r"[\s\p{Z}\p{C}]+", " ")})
    df = df.withColumns({
        "__la": F.lower("__pa"), "__lq": F.lower("__pq"), "__plain": F.trim(F.regexp_replace("__seen", r"<[^>]{0,200}>|&nbsp;", "")), "__tail": F.regexp_replace(F.rtrim(a), r"[\s\p{Z}\p{C}]+$", ""),
        "__letters": F.length(F.regexp_replace("__pa", r"[^\p{L}]+", "")), "__hangul": F.length(F.regexp_replace("__pa", r"[^가-힣]+", "")),
        "__informs": F.size(F.array_except(_names(a), _names(q))) > 0, "__left": F.when(F.length("__bq") >= 8, F.replace("__ba", "__bq", F.lit(""))).otherwise(F.col("__ba")),
    })
    # What informs from its first sentence on is no refusal, whatever is said later; what doesn't is searched whole.
    df = df.withColumn("__searched", F.when(F.col("__informs"), F.regexp_extract("__la", r"(?s)^[^\p{L}]*[^.!?。\n]*", 0)).otherwise(F.col("__la")))
    df = df.withColumns({"__hit": F.regexp_like(F.col("__searched"), F.lit(REFUSAL)), "__unfenced": F.regexp_replace("__tail", r"(?s)```.*?```|`[^`\n]*`", " "), **{f"__w{s}": F.split(f"__l{s}", r"[^\p{L}']+") for s in "aq"}, **{f"__m_{x}": F.length(F.regexp_replace("__la", f"[^{o}]+", "")) for x, o in OWN_LETTERS.items()}})
    df = df.withColumns({f"__{s}_{x}": F.size(F.filter(f"__w{s}", _is_in(profiles.get(x, [])))) for s in "aq" for x in LATIN})
    best = F.greatest(*(F.col(f"__q_{x}") for x in LATIN))
    lang = F.when(F.col("__pq").rlike("[가-힣]"), "ko")
    for x in LATIN:
        lang = lang.when((best > 0) & (F.col(f"__q_{x}") == best), x)
    return df.withColumn("__lang", F.coalesce(lang, F.lit("")))


def fit_label_model(counts: dict[int, int], functions: int, rounds: int = 200) -> dict[int, float]:
    """Posterior of the defect for each vote pattern (bit k: function k fired).

    Two latent classes with independent functions, fitted by expectation-maximization; Beta priors
    of weight `PRIOR_WEIGHT` keep a function that hardly fires near its starting point.
    """
    patterns = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    votes = (patterns[:, None] >> np.arange(functions)) & 1
    weight = max(5.0, PRIOR_WEIGHT * n.sum())
    sens, false, share = np.full(functions, START_SENSITIVITY), np.full(functions, START_FALSE), START_SHARE
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        up = np.log(share) + votes @ np.log(sens) + (1 - votes) @ np.log1p(-sens)
        down = np.log1p(-share) + votes @ np.log(false) + (1 - votes) @ np.log1p(-false)
        new = 1 / (1 + np.exp(np.clip(down - up, -500, 500)))
        w, v = n * new, n * (1 - new)
        sens = np.clip((w @ votes + weight * START_SENSITIVITY) / (w.sum() + weight), *SENSITIVITY)
        false = np.clip((v @ votes + weight * START_FALSE) / (v.sum() + weight), *FALSE)
        share = float(np.clip((w.sum() + weight * START_SHARE) / (n.sum() + weight), 1e-4, 0.5))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return dict(zip(patterns.tolist(), post.tolist()))


#: Bits of the votes of each form in the packed number of a record.
_WIDTH = 9


def voted_pairs(pairs: DataFrame, key: list[str], profiles: dict[str, list[str]], question: str = "question", answer: str = "answer") -> DataFrame:
    """key columns and v_<form>, the vote pattern of each record; of repeated rows the one with the largest votes holds (copies are equal)."""
    rows = spread(pairs.select(*key, F.col(question).alias("__q"), F.col(answer).alias("__a")))
    functions = labelling_functions()
    packed = reduce(lambda x, y: x + y, (F.shiftleft(c.cast("long"), _WIDTH * i + k) for i, f in enumerate(FORMS) for k, (_, c) in enumerate(functions[f])))
    # The functions run where the rows are read; only their votes, packed in one number, are shuffled.
    each_row = _prepared(rows, profiles).select(*key, packed.alias("__v"))
    unpacked = [F.shiftright("__v", _WIDTH * i).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int").alias(f"v_{f}") for i, f in enumerate(FORMS)]
    return each_row.groupBy(*key).agg(F.max("__v").alias("__v")).select(*key, *unpacked)


def label_pairs(pairs: DataFrame, key: list[str], profiles: dict[str, list[str]], question: str = "question", answer: str = "answer", cutoffs: dict[str, float] | None = None) -> DataFrame:
    """key columns, labels (array of defects, in the order of `DEFECTS`) and posteriors (map) of each record.

    Records are told apart by `key`; repeated rows are one. `profiles` are words by language, as
    `learn_profiles` gives them. A null answer is empty; with a null question no copy and no other
    language can be found. Further columns are ignored, an empty table gives an empty result.
    """
    cutoffs = CUTOFFS | (cutoffs or {})
    functions = labelling_functions()
    voted = cut_lineage(voted_pairs(pairs, key, profiles, question, answer))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("form"), F.col(f"v_{f}").alias("pattern")) for f in FORMS))).alias("e")
    counted = voted.select(each).groupBy("e.form", "e.pattern").count().collect()  # at most 2**functions rows a form
    posterior, above = {}, {}
    for f in FORMS:
        fitted = fit_label_model({r["pattern"]: r["count"] for r in counted if r["form"] == f} or {0: 1}, len(functions[f]))
        table = F.create_map(*(F.lit(x) for p, y in fitted.items() for x in (p, float(y))))
        posterior[f] = F.element_at(table, F.col(f"v_{f}"))
        above[f] = posterior[f] > cutoffs[f]
    of = {d: [f for f, x in FORMS.items() if x == d] for d in DEFECTS}
    kept = F.array_compact(F.array(*(F.when(reduce(lambda x, y: x | y, (above[f] for f in of[d])), F.lit(d)) for d in DEFECTS)))
    best = {d: F.greatest(*(posterior[f] for f in of[d])) if len(of[d]) > 1 else posterior[of[d][0]] for d in DEFECTS}
    return voted.select(*key, kept.alias("labels"), F.create_map(*(x for d in DEFECTS for x in (F.lit(d), best[d]))).alias("posteriors"))


def main_defect(labelled: DataFrame, key: list[str]) -> DataFrame:
    """key columns and defect of the records with a label: the first in the order of `DEFECTS`."""
    return labelled.where(F.size("labels") > 0).select(*key, F.col("labels")[0].alias("defect"))


def record_pairs(asks: DataFrame, answers: DataFrame) -> DataFrame:
    """pair_table, id, question and answer of both record tables; rows without id are left out."""
    one = asks.select(F.lit("asks").alias("pair_table"), F.col("id").cast("long").alias("id"), F.col("question"), F.col("answer"))
    two = answers.select(F.lit("answers").alias("pair_table"), F.col("id").cast("long").alias("id"), F.col("question_text").alias("question"), F.col("body").alias("answer"))
    return one.unionByName(two).where("id is not null")
