"""The record tables: questions, answers, claims, asks and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.names import clamp_score
from strataloom.functions.windows import numbered, rank_within

VERDICTS = ("confirmed", "contradicted", "unverifiable")


def latest(df: DataFrame, key: str = "id", order: str = "loaded_at") -> DataFrame:
    """One row per key: the last to arrive. Ties hold equal content; aggregation before the shuffle, no window."""
    others = [c for c in df.columns if c not in (key, order)]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(order, *others), F.coalesce(F.col(order), F.lit("0001-01-01").cast(df.schema[order].dataType))).alias("r"))
    return best.select(key, *(F.col("r")[c].alias(c) for c in [order, *others])).select(*df.columns)


def without_deleted(df: DataFrame, deleted: DataFrame, name: str) -> DataFrame:
    """`latest` rows that were not deleted after they last arrived."""
    log = deleted.where(F.col("rec_table") == name).groupBy(F.col("rec_id").alias("id")).agg(F.max("deleted_at").alias("__deleted"))
    return df.join(log, "id", "left").where("__deleted is null or loaded_at > __deleted").drop("__deleted")


def verdict_summary(claims: DataFrame) -> DataFrame:
    """verdict, hedged and n."""
    return claims.groupBy("verdict", "hedged").agg(F.count("*").alias("n"))


def tally(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """repo_id and its sums: n_confirmed, n_asserted (wrong or open claims told as facts), n_hedged."""
    joined = claims.select("answer_id", "verdict", "hedged").join(answers.select(F.col("id").alias("answer_id"), "repo_id"), "answer_id")
    bad, hedged = F.col("verdict").isin("contradicted", "unverifiable"), F.coalesce("hedged", F.lit(False))
    return joined.groupBy("repo_id").agg(
        F.count_if(F.col("verdict") == "confirmed").alias("n_confirmed"), F.count_if(bad & ~hedged).alias("n_asserted"), F.count_if(bad & hedged).alias("n_hedged"),
    ).withColumn("asserted_share", F.when(F.col("n_asserted") + F.col("n_hedged") >= 3, F.round(F.col("n_asserted") / (F.col("n_asserted") + F.col("n_hedged")), 6)))


def repeated_claims(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """repo_id, file (of the evidence) and n of contradicted or unverifiable claims told as facts, where more than one."""
    risky = claims.where(F.col("verdict").isin("contradicted", "unverifiable") & ~F.coalesce("hedged", F.lit(False)))
    joined = risky.join(answers.select(F.col("id").alias("answer_id"), "repo_id"), "answer_id")
    return joined.groupBy("repo_id", F.coalesce(F.substring_index("evidence", "::", 1), F.lit("")).alias("file")).agg(F.count("*").alias("n")).where("n > 1")


def claims_of_answers(claims: DataFrame) -> DataFrame:
    """answer_id, n_claims, n_risky and verdicts (in order of the claims' ids)."""
    risky = F.col("verdict").isin("contradicted", "unverifiable") & ~F.coalesce("hedged", F.lit(False))
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("verdict", F.lit("")).alias("verdict"))))
    return claims.where("answer_id is not null").groupBy("answer_id").agg(
        F.count("*").alias("n_claims"), F.count_if(risky).alias("n_risky"), F.array_join(F.transform(ordered, lambda x: x["verdict"]), ",").alias("verdicts")
    )


def scored_answers(answers: DataFrame) -> DataFrame:
    """id and total: the sum of the three scores, each held to 0..2 and 0 where unreadable."""
    parts = [clamp_score(F.col(c).cast("string")) for c in ("specificity", "calibration", "groundedness")]
    return answers.select("id", sum(parts[1:], parts[0]).cast("bigint").alias("total"))


def answered_questions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Question id, n_attempts and best total score of the questions with answers."""
    totals = scored_answers(answers)
    return answers.where("question_id is not null").join(totals, "id").groupBy("question_id").agg(F.count("*").alias("n_attempts"), F.max("total").alias("best")).join(questions.select(F.col("id").alias("question_id")), "question_id")


def mark_answered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """id, answered: whether an answer of the same repository repeats the question's text; a null text is answered by none."""
    texts = answers.where("question_text is not null").select("repo_id", F.col("question_text").alias("text"), F.lit(True).alias("found")).distinct()
    return questions.join(texts, ["repo_id", "text"], "left").select("id", F.coalesce("found", F.lit(False)).alias("answered"))


def insert_numbered(existing: DataFrame, new: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """`new` with `key`: numbers after the largest of `existing`, in a total `order`; an empty table begins with 1."""
    last = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("__last"))  # one row
    placed = rank_within(new.withColumn("__all", F.lit(0)), ["__all"], order, "__place").drop("__all")
    return placed.join(F.broadcast(last)).withColumn(key, (F.col("__last") + F.col("__place")).cast("long")).drop("__last", "__place")


def get_or_create(existing: DataFrame, names: DataFrame, name: str = "path", key: str = "id") -> DataFrame:
    """`key`, `name`: the existing rows and one new row for each of `names` that isn't among them, numbered by name. Null names are left out."""
    wanted = names.where(F.col(name).isNotNull()).select(name).distinct()
    missing = wanted.join(existing.select(name), name, "left_anti")
    return existing.select(F.col(key).cast("long").alias(key), name).unionByName(insert_numbered(existing, missing, [name], key).select(key, name))


def asks_with_parent(asks: DataFrame) -> DataFrame:
    """id, parent_id and parent_question (null where the parent is unknown)."""
    parent = asks.select(F.col("id").alias("parent_id"), F.col("question").alias("parent_question"))
    return asks.select("id", "parent_id").join(parent, "parent_id", "left").select("id", "parent_id", "parent_question")


def ask_chain(asks: DataFrame, of: Column, hops: int = 4) -> DataFrame:
    """start, hop, id: up to `hops` ancestors of the asks for which `of` holds, nearest first.

    One join per hop; a chain ends at an unknown parent, and `hops` bounds it within a cycle.
    """
    edges = asks.select("id", "parent_id").distinct()
    step = edges.where(of).select(F.col("id").alias("start"), F.col("parent_id").alias("at"))
    found, up = None, edges.select(F.col("id").alias("at"), F.col("parent_id").alias("next"))
    for hop in range(1, hops + 1):
        step = step.where("at is not null").join(up, "at")
        level = step.select("start", F.lit(hop).alias("hop"), F.col("at").alias("id"))
        found = level if found is None else found.unionByName(level)
        step = step.select("start", F.col("next").alias("at"))
    return found


def history_text(asks: DataFrame, chain: DataFrame) -> DataFrame:
    """start and text: the chain's questions, oldest first, with the answer of the newest only."""
    turns = chain.join(asks.select("id", "question", "answer").dropDuplicates(["id"]), "id")
    text = F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.when(F.col("hop") == 1, F.concat(F.lit("\nA: "), F.coalesce("answer", F.lit("")))).otherwise(F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("hop")).alias("order"), text.alias("text"))))
    return turns.groupBy("start").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def numbered_questions(questions: DataFrame, size: int = 5) -> DataFrame:
    """id, repo_id, number within the repository (by ordinal and id) and the set of `size` it falls into."""
    ordered = rank_within(questions.select("id", "repo_id", "ordinal"), ["repo_id"], ["ordinal", "id"], "number")
    return ordered.select("id", "repo_id", "number").withColumn("set_no", F.floor((F.col("number") - 1) / size) + 1)


def newest_asks(asks: DataFrame, per_repo: int = 3) -> DataFrame:
    """repo_id, rank, id of the newest asks of each repository by their UTC time (top-k report)."""
    made = F.try_to_timestamp(F.replace(F.col("created_at"), F.lit("T"), F.lit(" ")))
    rank = numbered(Window.partitionBy("repo_id").orderBy(F.desc("made"), F.desc("id")))
    return asks.withColumn("made", made).withColumn("rank", rank).where(F.col("rank") <= per_repo).select("repo_id", "rank", "id")


def parse_feedback(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Model output to rows: scores held to 0..2, unknown verdicts as unverifiable, claims kept in order.

    The JSON is what lies between the first { and the last }; without any, or unreadable, `valid` is
    false, the scores are 0 and there are no claims.
    """
    schema = "claims array<struct<claim:string,verdict:string,hedged:boolean,evidence:string,note:string>>, verdict_line string, revision string"
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    df = raw.withColumn("__j", body).withColumn("__p", F.from_json("__j", schema))
    score = lambda name: clamp_score(F.coalesce(F.get_json_object("__j", f"$.{name}"), F.lit("")), F.col("__j").rlike(f'"{name}"\\s*:\\s*"'))
    verdict = lambda c: F.when(c["verdict"].isin(*VERDICTS), c["verdict"]).otherwise("unverifiable")
    claims = F.transform(F.coalesce("__p.claims", F.array().cast("array<struct<claim:string,verdict:string,hedged:boolean,evidence:string,note:string>>")), lambda c: F.struct(
        F.coalesce(c["claim"], F.lit("")).alias("claim"), verdict(c).alias("verdict"), F.coalesce(c["hedged"], F.lit(False)).alias("hedged"), c["evidence"].alias("evidence"), F.coalesce(c["note"], F.lit("")).alias("note")))
    valid = F.coalesce(F.get_json_object("__j", "$").isNotNull(), F.lit(False))
    return df.withColumns({"valid": valid, "specificity": score("specificity"), "calibration": score("calibration"), "groundedness": score("groundedness"), "verdicts": claims, "verdict_line": F.coalesce("__p.verdict_line", F.lit("")), "revision": F.coalesce("__p.revision", F.lit(""))}).drop("__j", "__p")
