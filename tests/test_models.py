from graphloom.operators import models


def test_embedding_is_unit_length(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["aa", "b", None, ""])], "id long, text string")
    got = {r["id"]: r["v"] for r in models.embedded(rows, lambda: lambda ts: [[3.0 * len(t), 4.0 * len(t)] for t in ts], 2).collect()}
    assert got == {0: [0.6, 0.8], 1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_rerank_and_a_model_that_fails(spark):
    found = spark.createDataFrame([(1, "q", 10, "a", 1), (1, "q", 11, "bbb", 2), (1, "q", 12, "bb", 3)], "q_id long, question string, id long, text string, rank int").coalesce(1)
    by_length = models.reranked(found, lambda: lambda pairs: [float(len(t)) for _, t in pairs], 2).orderBy("rank").collect()
    assert [r["id"] for r in by_length] == [11, 12]

    def broken():
        def model(pairs):
            raise ValueError

        return model

    assert [r["id"] for r in models.reranked(found, broken, 2).orderBy("rank").collect()] == [10, 11]


def test_answers_without_the_prompt(spark):
    rows = spark.createDataFrame([(1, "c", "q", ["x", "y"])], "q_id long, context string, question string, options array<string>")
    echo = models.answered(rows, lambda: lambda ps: [p + " it is B" for p in ps]).first()
    assert (echo["response"], echo["letter"], echo["method"]) == ("it is B", "B", "pattern_match")
