"""Retrieval: lexical scores by contained words, exact vector top-k, two searches merged.

Defined results: null texts count as empty; questions without a word of more than 2 characters, and null questions, find nothing; null vectors, those with null entries and, beside queries, those of another
length are left out, as are null queries; a zero vector has inner products of 0; repeated rows are hits each; ties go to the lesser id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.shipping import ship

#: Most questions that travel with the code; beyond it they are worked off in as many passes.
TOGETHER = 5000
#: Query vectors, and vectors, of a block.
ASKED, BLOCK = 512, 4096
#: Words of texts that a task holds at most until it scores them.
HELD = 200_000
#: First characters of a label by which it meets questions: of one that has fewer than LONG, SHORT.
SHORT, LONG = 3, 8


def lexical_topk(questions: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, id, score, rank): score = 2 for each word of more than 2 characters that the description contains, 1 for the text; repeated words count again.

    questions: q_id, question; entities: id, description, original_text. One pass over the entities: an automaton of all words of the questions finds those
    that a text contains, lists of the questions of each word give all its scores, and each task keeps its k best a question, so only these are shuffled.
    """
    spark = entities.sparkSession
    ship(spark)
    asked = questions.select("q_id", F.filter(T.tokens(F.lower(F.coalesce("question", F.lit("")))), lambda w: F.length(w) > 2).alias("w")).orderBy("q_id").collect()
    low = entities.select("id", F.lower(F.coalesce("description", F.lit(""))).alias("d"), F.lower(F.coalesce("original_text", F.lit(""))).alias("o"))
    parts = [low.mapInArrow(_scores([(r["q_id"], r["w"]) for r in asked[a : a + TOGETHER]], k), "q_id long, id long, score int") for a in range(0, len(asked), TOGETHER)]
    if not parts:
        return spark.createDataFrame([], "q_id long, id long, score int, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    by = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _scores(asked: list[tuple[int, list[str]]], k: int):
    vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in asked for w in ws}))}
    ids = np.array([q for q, _ in asked], np.int64)
    pairs = np.array([(vocabulary[w], n) for n, (_, ws) in enumerate(asked) for w in ws], np.int64).reshape(-1, 2)
    pairs, times = np.unique(pairs, axis=0, return_counts=True)
    first = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w, n in vocabulary.items():
            machine.add_word(w, n)
        if vocabulary:
            machine.make_automaton()

        def words(text: str) -> frozenset[int]:
            return frozenset(n for _, n in machine.iter(text))

        def scores(of: frozenset[int]) -> np.ndarray:
            """For each question its words among these, with repetition: from the lists of these words alone."""
            found = np.fromiter(of, np.int64, len(of))
            size = first[found + 1] - first[found]
            ends = np.cumsum(size)
            at = np.repeat(first[found] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            return np.bincount(pairs[at, 1], times[at], len(ids)).astype(np.int64)

        def hits(alike: dict[tuple[frozenset[int], frozenset[int]], list[int]]) -> Iterator[np.ndarray]:
            """Rows of equal words have equal scores: the k least ids of them are enough."""
            for (of_d, of_o), rows in alike.items():
                score = 2 * scores(of_d) + scores(of_o) if of_d != of_o else 3 * scores(of_d)
                hit = np.flatnonzero(score)
                yield from (np.stack([hit, np.full(len(hit), i), score[hit]], 1) for i in sorted(rows)[:k])

        best = np.zeros((0, 3), np.int64)
        for b in batches:
            rows, alike, held = [best], {}, 0
            for i, d, o in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if not vocabulary:
                    continue
                of_d = words(d)
                same = alike.setdefault((of_d, of_d if d == o else words(o)), [])
                same.append(i)
                held += len(of_d) if len(same) == 1 else 0
                if held > HELD:
                    rows += hits(alike)
                    alike, held = {}, 0
            best = _few(np.concatenate([*rows, *hits(alike)]), k)
        rows = best
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[:, 0]]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], names=["q_id", "id", "score"])

    return run


def _few(rows: np.ndarray, k: int) -> np.ndarray:
    """The k best rows (question, id, score) of each question."""
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
    first = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - first < k]


def lexical_context(top: DataFrame, entities: DataFrame, questions: DataFrame, most: int = 500) -> DataFrame:
    """(q_id, context): the found texts' first characters by rank; a fixed sentence where nothing is found."""
    texts = F.broadcast(top).join(entities.select("id", F.substring(F.coalesce("original_text", F.lit("")), 1, most).alias("t")), "id")
    joined = texts.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n\n").alias("c"))
    return questions.select("q_id").join(joined, "q_id", "left").select("q_id", F.coalesce(F.nullif("c", F.lit("")), F.lit(T.NOTHING_FOUND)).alias("context"))


def expanded(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """(q_id, query): the question, a space and the labels that it contains (case aside), in order of seq. labels: label, seq.

    A question contains a label only if it contains the label's first characters, SHORT or LONG (all, if it has fewer), so the two meet by an equi-join on these, and are verified then.
    """
    cut = lambda low, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda p: F.substring(low, p, n))
    keys = lambda low: F.array_distinct(F.concat(F.array(F.lit("")), *[cut(low, n) for n in range(1, SHORT + 1)], cut(low, LONG)))  # noqa: E731 - shorter ones at the end do no harm
    low = F.lower(F.coalesce("question", F.lit("")))
    # by way of an array, so that the question is computed once and not for each place
    asked = questions.select("q_id", "question", F.explode(F.transform(F.array(low), lambda x: F.struct(x.alias("low"), keys(x).alias("keys")))).alias("x")).select("q_id", "question", "x.low", F.explode("x.keys").alias("key"))
    name = F.lower("label")
    named = labels.where("label is not null").select("label", "seq", F.when(F.length(name) < LONG, F.substring(name, 1, SHORT)).otherwise(F.substring(name, 1, LONG)).alias("key"))
    near = asked.join(named, "key").where(F.contains("low", F.lower("label")))
    joined = near.groupBy("q_id", "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda x: x["label"]), " ").alias("l"))
    return questions.select("q_id", "question").distinct().join(joined.select("q_id", "question", "l"), ["q_id", "question"], "left").select("q_id", F.concat(F.coalesce("question", F.lit("")), F.lit(" "), F.coalesce("l", F.lit(""))).alias("query"))


def _blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """(ids, vectors) of `size` rows each, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                x = _unit(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], names=["ids", "x", "dim"])

    v = F.col("v").cast("array<double>")
    usable = rows.select(F.col(name).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).where(F.col("id").isNotNull() & (F.col("dim") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e)))
    return usable.select("id", "v").mapInArrow(_by_length(pack), "ids binary, x binary, dim int")


def _by_length(pack):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            for d in np.unique(n):
                yield from pack([pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(n == d)), b.column(1).filter(pa.array(n == d))], names=["id", "v"])])

    return run


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, id, score, rank) by inner product of unit vectors, exact. queries: q_id, v; vectors: id, v.

    Blocks of queries meet blocks of vectors of their length, a matrix product each; a task keeps the k best of each query, and only these are shuffled. Scores are equal if their first 12 digits are.
    """
    ship(vectors.sparkSession)
    asked = _blocks(queries, "q_id", ASKED).toDF("qids", "q", "qdim")
    met = asked.join(_blocks(vectors, "id", BLOCK), F.col("qdim") == F.col("dim")).select("qids", "q", "ids", "x", "dim")
    by = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return met.mapInArrow(_nearest(k), "q_id long, id long, score double").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _nearest(k: int, most: int = 200_000):
    """The k nearest of a task's vectors for each query; what is kept is cut down as soon as it is more than `most` rows."""

    def best(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i, v = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((i, -v, q))
        q, i, v = q[order], i[order], v[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[few], i[few], v[few]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, least = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0, most
        for b in batches:
            for r in range(b.num_rows):
                qids, q, ids, x, dim = (b.column(c)[r].as_py() for c in range(5))
                qids, ids = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                score = np.round(np.frombuffer(q).reshape(-1, dim) @ np.frombuffer(x).reshape(-1, dim).T, 12)
                cut = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                at, j = np.nonzero(score >= cut[:, None])
                kept.append((qids[at], ids[j], score[at, j]))
                n += len(at)
                if n > least:
                    kept = [best(kept)]
                    n = len(kept[0][0])
                    least = max(most, 2 * n)
        q, i, v = best(kept)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(v)], names=["q_id", "id", "score"])

    return run


def merged(first: DataFrame, second: DataFrame, contents: DataFrame, most: int = 3) -> DataFrame:
    """(q_id, id, rank): the hits of the first search, then those of the second, of equal contents the one that comes first; at most `most` a question.

    first, second: q_id, id, rank; contents: id, content.
    """
    both = first.select("q_id", "id", F.lit(0).alias("source"), "rank").union(second.select("q_id", "id", F.lit(1), "rank"))
    once = both.join(contents, "id").groupBy("q_id", "content").agg(F.min(F.struct("source", "rank", "id")).alias("at"))
    return once.select("q_id", "at.id", F.row_number().over(Window.partitionBy("q_id").orderBy("at")).alias("rank")).where(F.col("rank") <= most)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(lists.flatten(), float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)
