"""Answering and grading of multiple-choice and true-or-false questions.

Defined results: null predictions and empty ones are none; questions without a right option are skipped but count in the total; of several right options the first counts; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import models, retrieve


def option_scores(options: Column, context: Column) -> Column:
    """For each option its words of more than 3 characters that the context contains.

    A word that is a word of the context is contained; only other ones are looked for in it, each once. Values are passed by way of arrays, so that each is computed once and not for each word.
    """
    once = lambda x, f: F.transform(F.array(x), f)[0]
    long = lambda o: F.filter(T.tokens(F.lower(o)), lambda w: F.length(w) > 3)

    def count(words: Column, low: Column) -> Column:
        lacking = F.filter(F.array_except(F.flatten(F.filter(words, lambda ws: ws.isNotNull())), T.tokens(low)), lambda w: ~F.contains(low, w))
        return once(lacking, lambda none: F.transform(words, lambda ws: F.size(F.when(F.size(none) == 0, ws).otherwise(F.filter(ws, lambda w: ~F.array_contains(none, w))))))

    return once(F.struct(F.transform(options, long).alias("words"), F.lower(context).alias("low")), lambda x: count(x["words"], x["low"]))


def best_option(scores: Column) -> Column:
    """The letter of the first highest score; A where none is above 0."""
    letter = lambda s: F.when(F.array_max(s) > 0, F.char(F.array_position(s, F.array_max(s)) + 64)).otherwise("A")
    return F.transform(F.array(scores), letter)[0]  # by way of an array, so that the scores are computed once


def graded(rows: DataFrame) -> DataFrame:
    """rows: id, q_type, predicted, correct -> with is_correct and status."""
    said = F.coalesce(F.nullif("predicted", F.lit("")), F.lit(T.NO_ANSWER))
    good = F.coalesce(F.col("predicted") == F.col("correct"), F.lit(False))
    status = F.when(good, "correct").when(said == T.NO_ANSWER, "no-answer").otherwise("wrong")
    return rows.select("id", "q_type", said.alias("predicted"), "correct", good.alias("is_correct"), status.alias("status"))


def statistics(results: DataFrame) -> DataFrame:
    """One row a question type and one over all (q_type 'overall')."""
    counted = results.rollup("q_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_correct").alias("correct"),
        F.count_if(F.col("status") == "wrong").alias("wrong"),
        F.count_if(F.col("status") == "no-answer").alias("no_prediction"),
    )
    share = lambda x: F.round(F.coalesce(F.try_divide(x, F.col("total")) * 100, F.lit(0.0)), 6)
    return counted.select(F.coalesce("q_type", F.lit("overall")).alias("q_type"), "total", "correct", "wrong", "no_prediction", share(F.col("correct")).alias("accuracy"), share(F.col("total") - F.col("no_prediction")).alias("prediction_rate"))


def running_accuracy(results: DataFrame, every: int = 5) -> DataFrame:
    """Accuracy so far within each question type, at every fifth question."""
    by = Window.partitionBy("q_type").orderBy("id")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = results.select("q_type", "id", F.row_number().over(by).alias("n"), F.round(F.avg(F.col("is_correct").cast("int")).over(so_far) * 100, 6).alias("accuracy"))
    return rows.where(F.col("n") % every == 0)


def cards(results: DataFrame) -> DataFrame:
    """One HTML card a question, escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return results.select("id", "q_type", F.concat(F.lit('<div class="card '), "status", F.lit('"><b>#'), F.col("id").cast("string"), F.lit("</b> "), safe("predicted"), F.lit(" / "), safe("correct"), F.lit("</div>")).alias("card"))


MARKS = {"lower": ("(correct, predicted)", "(correct)", "(predicted)"), "title": ("(Correct + Predicted)", "(Correct)", "(Predicted)")}


def first_correct(options: Column) -> Column:
    """Place of the first right option, from 1; 0 where there is none."""
    return F.coalesce(F.array_position(F.transform(options, lambda o: F.coalesce(o["isCorrect"], F.lit(False))), F.lit(True)), F.lit(0))


def marked(options: Column, at: Column, predicted: Column, true_false: Column, style: str = "lower") -> Column:
    """Options as structs of letter, text, is_correct, is_predicted and marker; of true-or-false questions all but the first are B."""
    both, right, said = (F.lit(m) for m in MARKS[style])

    def one(o: Column, k: Column) -> Column:
        letter = F.when(true_false & (k > 0), "B").otherwise(F.char(k + 65))
        good, hit = k + 1 == at, F.coalesce(letter == predicted, F.lit(False))
        marker = F.when(good & hit, both).when(good, right).when(hit, said).otherwise("")
        return F.struct(letter.alias("letter"), o["answer"].alias("text"), good.alias("is_correct"), hit.alias("is_predicted"), marker.alias("marker"))

    return F.transform(options, one)


def option_text(options: Column, letter: Column) -> Column:
    """The answer behind a letter; null beyond the options."""
    return F.get(options, (F.ascii(letter) - 65).cast("int"))["answer"]


def evaluated(questions: DataFrame, entities: DataFrame, first: dict[str, int] | None = None, make: Callable | None = None, k: int = 5, style: str = "lower") -> tuple[DataFrame, DataFrame]:
    """(results, skipped): every question retrieved for, answered, its answer extracted and graded.

    questions: q_type, id (from 1 in its type), question, options(answer, isCorrect); entities: label, description, original_text, seq (a number that tells their order). first: how many questions of each type, none or 0
    for all. make: a model as `models.answered` takes it; without one the option whose words the context holds most of is the answer. True-or-false questions are asked by their statement alone.
    """
    asked = questions
    for q_type, n in (first or {}).items():
        asked = asked.where((F.col("q_type") != q_type) | (F.col("id") <= n)) if n else asked
    tf, said = F.col("q_type") == "true_false", T.statement(F.col("question"))
    rows = asked.select("q_type", "id", "question", "options", first_correct(F.col("options")).alias("at"), F.when(tf, said["statement"]).alias("statement"), F.when(tf, said["context"]).alias("given_context"))
    skipped = rows.where("at = 0").select("q_type", "id", "question")
    rows = rows.where("at > 0").withColumn("q_id", F.col("id").cast("long") * 2 + tf.cast("long")).withColumn("asked", F.coalesce("statement", "question"))
    corpus = entities.select(F.col("seq").cast("long").alias("id"), "description", "original_text")
    labels = entities.select(F.posexplode("label").alias("place", "label"), "seq").select("label", F.struct("seq", "place").alias("seq"))
    query = retrieve.expanded(rows.select("q_id", F.col("asked").alias("question")), labels).withColumnRenamed("query", "question")
    context = retrieve.lexical_context(retrieve.lexical_topk(query, corpus, k), corpus, rows.select("q_id").distinct())
    full = rows.join(context, "q_id").withColumn("texts", F.transform("options", lambda o: o["answer"]))
    if make is None:
        answers = full.withColumn("response", best_option(option_scores(F.col("texts"), F.col("context")))).withColumn("a", F.when(tf, T.answer_letter(F.col("response"), True)).otherwise(T.answer_letter(F.col("response"))))
    else:
        one = lambda true: models.answered(full.where(tf if true else ~tf).select("q_id", "context", F.col("asked").alias("question"), F.col("texts").alias("options")), make, true)
        answers = full.join(one(False).union(one(True)).select("q_id", "response", F.struct("letter", "confidence", "method").alias("a")), "q_id")
    correct = F.when(tf & (F.col("at") > 1), "B").otherwise(F.char(F.col("at") + 64))
    graded_ = answers.withColumn("predicted", F.col("a")["letter"]).withColumn("correct", correct).withColumn("is_correct", F.coalesce(F.col("predicted") == F.col("correct"), F.lit(False)))
    status = F.when(F.col("is_correct"), "correct").when(F.col("predicted") == T.NO_ANSWER, "no-answer").otherwise("wrong")
    results = graded_.select(
        "q_type", "id", "question", "statement", "given_context", marked(F.col("options"), F.col("at"), F.col("predicted"), tf, style).alias("options"), "predicted", "correct", "is_correct", status.alias("status"),
        "context", F.length("context").alias("context_length"), "response", F.length("response").alias("response_length"), F.col("a")["method"].alias("method"), F.col("a")["confidence"].alias("confidence"),
    )
    return results, skipped


def totals(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """`statistics` over the questions that were answered and those that were skipped: these are in the total, and no prediction is missing for them."""
    return statistics(results.select("q_type", "is_correct", "status").union(skipped.select("q_type", F.lit(False), F.lit("skipped"))))


def full_cards(results: DataFrame) -> DataFrame:
    """One HTML card a question of `evaluated`: status, question, options with their marks, and what it was answered from, folded; escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    c, text = F.col, lambda x: F.col(x).cast("string")
    options = F.array_join(F.transform("options", lambda o: F.concat(F.lit("<li>"), o["letter"], F.lit(". "), safe(o["text"]), F.when(o["marker"] == "", "").otherwise(F.concat(F.lit(' <span class="badge">'), o["marker"], F.lit("</span>"))), F.lit("</li>"))), "")
    details = F.concat(F.lit("<details><summary>context "), text("context_length"), F.lit(", response "), text("response_length"), F.lit("</summary><pre>"), safe(c("context")), F.lit("</pre><pre>"), safe(c("response")), F.lit("</pre>"), c("method"), F.lit(" "), F.format_number("confidence", 2), F.lit("</details>"))
    card = F.concat(F.lit('<div class="card '), c("status"), F.lit('"><b>#'), text("id"), F.lit("</b> "), safe(c("question")), F.lit("<ul>"), options, F.lit('</ul><span class="answer">'), safe(c("predicted")), F.lit(" / "), c("correct"), F.lit("</span>"), details, F.lit("</div>"))
    return results.select("id", "q_type", card.alias("card"))
