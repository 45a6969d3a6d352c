"""Questions answered from verified claims only: relevance, gates before an answer, checks after it, trust gates of an agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T

from .dashboards import asked

ANSWERED, BLOCKED, NO_DATA, REJECTED = "answered", "refused_blocked", "refused_no_data", "rejected_unverified_output"


def relevant(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Questions with each item of their document's ledger that concerns them: its topic is asked for, or a telling word is shared with its text
    (of blocked items, with the reason whose numbers are withheld). questions: doc_id, question_id, question; ledger: doc_id, fact_id (null where
    blocked), topic, said, status, values."""
    q = questions.withColumn("topics", asked(F.col("question")))
    return q.join(ledger, "doc_id").filter(F.array_contains("topics", F.col("topic")) | T.overlaps(F.col("question"), F.col("said")))


def gate(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, question_id, mode, facts): refused before any answer where a topic asked for has only blocked claims, or none at all, or where nothing
    relevant is verified; else answered may follow. facts: the ids that an answer may cite; values of them: what it may state."""
    q = questions.withColumn("topic", F.explode_outer(asked(F.col("question"))))
    topics = ledger.groupBy("doc_id", "topic").agg(F.count("fact_id").alias("v"), F.count_if(F.col("fact_id").isNull()).alias("b"))
    t = q.join(topics, ["doc_id", "topic"], "left").groupBy("doc_id", "question_id").agg(F.max(F.coalesce("v", F.lit(0)).eqNullSafe(0) & (F.col("b") > 0) & F.col("topic").isNotNull()).alias("blocked"), F.max(F.col("topic").isNotNull() & F.col("v").isNull()).alias("absent"))
    ids = F.array_sort(F.collect_set("fact_id"))
    r = relevant(questions, ledger).groupBy("doc_id", "question_id").agg(F.count("fact_id").alias("n_facts"), F.count_if(F.col("fact_id").isNull()).alias("n_blocked"), ids.alias("facts"), F.flatten(F.collect_list(F.when(F.col("fact_id").isNotNull(), F.col("values")))).alias("values"))
    j = t.join(r, ["doc_id", "question_id"], "left")
    mode = F.when(F.coalesce("blocked", F.lit(False)), BLOCKED).when(F.coalesce("absent", F.lit(False)), NO_DATA).when(F.col("n_facts") > 0, ANSWERED).when(F.col("n_blocked") > 0, BLOCKED).otherwise(NO_DATA)
    return j.select("doc_id", "question_id", mode.alias("mode"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), F.coalesce("values", F.array().cast("array<double>")).alias("values"))


def failure(answer: Column, citations: Column, facts: Column, values: Column) -> Column:
    """Why an answer may not be shown, or null: every citation names a fact, there is one, and every number stands in the facts."""
    strange = F.get(F.array_except(citations, facts), F.lit(0))
    invented = F.get(F.filter(T.numbers(answer), lambda n: ~T.allowed(n, values)), F.lit(0))
    return F.when(answer.isNull() | citations.isNull(), "not in the cited format").when(strange.isNotNull(), F.concat(F.lit("unknown citation "), strange)).when(F.size(citations) == 0, "no citations").when(invented.isNotNull(), "number of no verified fact")


def parsed(answers: DataFrame) -> DataFrame:
    """answers (raw) with answer and citations of the first object; null where it can't be read."""
    one = F.from_json(F.regexp_extract("raw", r"(?s)(\{.*\}|\[.*\])", 1), "array<struct<answer: string, citations: array<string>>>")
    o = F.get(one, F.lit(0))
    return answers.withColumns({"answer": o["answer"], "citations": o["citations"]})


def judged(gates: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, question_id, mode, answer, reason): gates first, then, of answers given, those that fail are rejected. answers: doc_id, question_id, raw."""
    j = gates.join(parsed(answers).select("doc_id", "question_id", "answer", "citations"), ["doc_id", "question_id"], "left")
    why = F.when(F.col("mode") == ANSWERED, failure(F.col("answer"), F.col("citations"), F.col("facts"), F.col("values")))
    return j.withColumn("reason", why).select("doc_id", "question_id", F.when(F.col("reason").isNotNull(), REJECTED).otherwise(F.col("mode")).alias("mode"), F.when((F.col("mode") == ANSWERED) & F.col("reason").isNull(), F.col("answer")).alias("answer"), "reason")


def sweep(gates: DataFrame, ledger: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: outcomes of every filer and question, and the gates that must hold: a topic with blocked claims only is refused as blocked, and no
    question is answered without a verified claim of its topic. topics: question_id, topic."""
    own = ledger.groupBy("doc_id", "topic").agg(F.count("fact_id").alias("v"), F.count_if(F.col("fact_id").isNull()).alias("b"))
    x = gates.join(F.broadcast(topics), "question_id").join(own, ["doc_id", "topic"], "left").withColumns({"v": F.coalesce("v", F.lit(0)), "b": F.coalesce("b", F.lit(0))})
    adverse = (F.col("v") == 0) & (F.col("b") > 0)
    n = lambda m: F.count_if(F.col("mode") == m).alias(m)
    return x.agg(n(ANSWERED), n(BLOCKED), n(NO_DATA), F.count_if(adverse).alias("adversarial"), F.count_if(adverse & (F.col("mode") == BLOCKED)).alias("adversarial_refused"), F.count_if((F.col("mode") == ANSWERED) & (F.col("v") == 0)).alias("answered_from_nothing"))


def concerns(claim_text: Column, keywords: list[str]) -> Column:
    low = F.lower(F.coalesce(claim_text, F.lit("")))
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))


def trust(verdicts: DataFrame, keywords: list[str], strict: bool, *keys: str) -> DataFrame:
    """(keys, decision) of what an agent may say: a disputed claim forbids it, a verified one allows it (strict: only where none is gated), a gated
    one leaves it unverified, and without any there is no basis."""
    on = concerns(F.col("claim_text"), keywords)
    has = lambda s: F.coalesce(F.bool_or(on & (F.col("status") == s)), F.lit(False))
    g = verdicts.groupBy(*keys).agg(has(K.WRONG).alias("bad"), has(K.VERIFIED).alias("good"), has(K.INSUFFICIENT).alias("gated"))
    good = F.col("good") & ~F.col("gated") if strict else F.col("good")
    return g.select(*keys, F.when(F.col("bad"), "DECLINE_DISPUTED").when(good, "ANSWER").when(F.col("gated"), "DECLINE_UNVERIFIED").otherwise("NO_BASIS").alias("decision"))


#: Words by which claims of a question are found.
EPS_WORDS, CASH_WORDS = ["eps", "earnings per share"], ["cash tie", "cash flow", "cash tie-out"]
