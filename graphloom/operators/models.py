"""Models as pluggable functions over batches: embedders, rerankers, answerers. Each runs in Arrow batches on the executors and is made once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import retrieve


def embedded(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """rows: id, text -> id, v (unit length; a zero vector stays)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                yield pd.DataFrame({"id": part["id"], "v": list(model([t or "" for t in part["text"]]))})

    v = rows.select(F.col("id").cast("long").alias("id"), "text").mapInPandas(run, "id long, v array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("n", norm).select("id", F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")).alias("v"))


def reranked(found: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], k: int) -> DataFrame:
    """found: q_id, question, id, text, rank -> the k best by the model's score; ties keep the old order; a failing model scores 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            try:
                score = list(model(list(zip(f["question"], f["text"], strict=True))))
            except Exception:  # noqa: BLE001 - whatever the model raises, its rows keep their order
                score = [0.0] * len(f)
            yield pd.DataFrame({"q_id": f["q_id"], "id": f["id"], "rank": f["rank"], "score": score})

    scored = found.select("q_id", "question", "id", "text", "rank").mapInPandas(run, "q_id long, id long, rank int, score double")
    by = Window.partitionBy("q_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(by)).where(F.col("new_rank") <= k).select("q_id", "id", "score", F.col("new_rank").alias("rank"))


def prompt(context: Column, question: Column, options: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), question, F.lit("\n"), T.lettered(options), F.lit("\nAnswer:"))


def answered(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], true_false: bool = False, batch: int = 64, template: Callable[[Column, Column, Column], Column] = prompt, most: int | None = None) -> DataFrame:
    """rows: q_id, context, question, options -> q_id, response, letter, confidence, method. Prompts longer than `most` characters are cut; the prompt is cut from a response that repeats it; where the model raises, its batch is answered A."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                try:
                    said = list(model(list(part["prompt"])))
                except Exception:  # noqa: BLE001 - whatever the model raises
                    said = ["A"] * len(part)
                yield pd.DataFrame({"q_id": part["q_id"], "prompt": part["prompt"], "said": said})

    whole = template(F.coalesce("context", F.lit("")), F.coalesce("question", F.lit("")), F.coalesce("options", F.array().cast("array<string>")))
    said = rows.select("q_id", (F.substring(whole, 1, most) if most else whole).alias("prompt")).mapInPandas(run, "q_id long, prompt string, said string")
    bare = T.strip(F.when(F.startswith("said", "prompt"), F.expr("substring(said, length(prompt) + 1)")).otherwise(F.col("said")))
    out = said.select("q_id", bare.alias("response"))
    return out.select("q_id", "response", T.answer_letter(F.col("response"), true_false).alias("a")).select("q_id", "response", "a.*")


def semantic_search(queries: DataFrame, vectors: DataFrame, k: int = 5, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]] | None = None) -> DataFrame:
    """(q_id, id, score, rank): the 2k nearest by inner product, then the k best of them, by the reranker if there is one. queries: q_id, v (and question); vectors: id, v (and text)."""
    near = retrieve.vector_topk(queries, vectors, 2 * k)
    if make is None:
        return near.where(F.col("rank") <= k)
    return reranked(near.join(queries.select("q_id", "question"), "q_id").join(vectors.select("id", "text"), "id"), make, k)


def two_searches(asked: DataFrame, first: DataFrame, second: DataFrame, chunks: DataFrame, most: int = 3, fallback: str = T.NOTHING_FOUND) -> DataFrame:
    """(q_id, context): the texts that the search with the question found, then those of the search with its key words, each text once, `most` of them. asked: q_id; first, second: q_id, id, rank; chunks: id, text."""
    kept = retrieve.merged(first, second, chunks.withColumnRenamed("text", "content"), most).join(chunks, "id")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")
    return asked.select("q_id").join(kept.groupBy("q_id").agg(texts.alias("c")), "q_id", "left").select("q_id", F.coalesce(F.nullif("c", F.lit("")), F.lit(fallback)).alias("context"))
