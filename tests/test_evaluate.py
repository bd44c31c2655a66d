"""Evaluation end to end, against a plain loop over questions; conversion of collected question sets; the command line."""

import json
import time

from pyspark.sql import functions as F

import graphloom.__main__ as command
from graphloom.operators import evaluate, ingest, models
from graphloom.sources import files, sinks

ENTITIES = [("Hà Nội", "thủ đô của Việt Nam", "Hà Nội nằm bên sông Hồng"), ("Huế", "kinh đô triều Nguyễn", "Huế có sông Hương"), ("sông", "dòng nước", "")]
Q = "q_type string, id long, question string, options array<struct<answer: string, isCorrect: boolean>>"


def questions():
    mc = [
        ("Thủ đô Hà Nội ở đâu?", [("bên sông Hương", False), ("bên sông Hồng", True), ("nơi khác", False)]),
        ("Kinh đô Huế", [("triều Nguyễn", True), ("triều khác", True), ("", False)]),
        ("không có gì", [("xa lạ", False), ("không biết", False), ("khác", True)]),
        ("câu hỏi bỏ qua", [("một", False), ("hai", None), ("ba", False)]),
        ("qqq", [("Hương", False), ("Hồng", False)] * 2 + [("năm", True)]),
    ]
    tf = [("Đọc đoạn tư liệu sau đây: \"x\" Phát biểu sau: \"Huế có sông Hương\" là đúng hay sai", [("Đúng", True), ("Sai", False)]), ("Hà Nội", [("Đúng", False), ("Sai", True)]), ("gì", [("Đúng", False), ("Sai", False)])]
    return [("multiple_choice", k, *q) for k, q in enumerate(mc, 1)] + [("true_false", k, *q) for k, q in enumerate(tf, 1)]


def by_hand(q_type, id_, question, options):
    """One question, step by step."""
    good = [k for k, (_, right) in enumerate(options) if right]
    if not good:
        return None
    asked = question
    if q_type == "true_false":
        parts = question.split("Phát biểu sau:")
        asked = parts[1].strip().strip('"').replace("là đúng hay sai", "").strip() if len(parts) == 2 else question
    query = asked + " " + " ".join(name for name, _, _ in ENTITIES if name.lower() in asked.lower())
    words = [w for w in query.lower().split() if len(w) > 2]
    scores = [sum(2 * (w in d.lower()) + (w in t.lower()) for w in words) for _, d, t in ENTITIES]
    best = [k for k in sorted(range(len(ENTITIES)), key=lambda k: -scores[k]) if scores[k]][:5]
    context = "\n\n".join(ENTITIES[k][2][:500] for k in best) or "No relevant information found."
    hits = [sum(len(w) > 3 and w in context.lower() for w in o.lower().split()) for o, _ in options]
    predicted = "ABCDE"[hits.index(max(hits))] if max(hits) else "A"
    # a letter beyond D is no answer
    predicted = predicted if predicted in "ABCD" else "[NO PREDICTION]"
    letters = ["A" if k == 0 else "B" for k in range(len(options))] if q_type == "true_false" else "ABCDE"
    correct = letters[good[0]]
    marks = []
    for k, letter in zip(range(len(options)), letters):
        right, said = k == good[0], letter == predicted
        marks.append("(correct, predicted)" if right and said else "(correct)" if right else "(predicted)" if said else "")
    return q_type, id_, predicted, correct, predicted == correct, context, len(context), marks


def frames(spark):
    q = spark.createDataFrame([(t, k, x, [(a, c) for a, c in o]) for t, k, x, o in questions()], Q)
    e = spark.createDataFrame([([n], d, t, k) for k, (n, d, t) in enumerate(ENTITIES)], "label array<string>, description string, original_text string, seq long")
    return q, e


def test_evaluation_equals_a_loop(spark):
    q, e = frames(spark)
    results, skipped = evaluate.evaluated(q, e)
    got = [(r["q_type"], r["id"], r["predicted"], r["correct"], r["is_correct"], r["context"], r["context_length"], [o["marker"] for o in r["options"]]) for r in results.orderBy("q_type", "id").collect()]
    assert got == [x for x in (by_hand(*x) for x in questions()) if x]
    assert sorted((r["q_type"], r["id"]) for r in skipped.collect()) == [("multiple_choice", 4), ("true_false", 3)]
    stats = {r["q_type"]: r for r in evaluate.totals(results, skipped).collect()}
    assert (stats["multiple_choice"]["total"], stats["true_false"]["total"], stats["overall"]["total"]) == (5, 3, 8)
    assert stats["overall"]["correct"] == sum(x[4] for x in got)
    few, _ = evaluate.evaluated(q, e, {"multiple_choice": 2, "true_false": 0}, style="title")
    rows = few.collect()
    assert sorted((r["q_type"], r["id"]) for r in rows) == [("multiple_choice", 1), ("multiple_choice", 2), ("true_false", 1), ("true_false", 2)]
    assert {o["marker"] for r in rows for o in r["options"]} >= {"", "(Correct + Predicted)"}
    none, left = evaluate.evaluated(q.where("false"), e)
    assert none.count() == left.count() == evaluate.totals(none, left).where("total > 0").count() == 0


def test_option_words_are_not_looked_for_one_by_one(spark):
    o = "array<string>"
    rows = spark.createDataFrame([(["Alpha alpha beta", "betas gamma", None, ""], "alphabet BETA gamma"), (None, "abcd"), (["abcd x"], None), (["one four-five four", "zzzz"], "FOUR-FIVE ones")], f"o {o}, c string")
    assert [r[0] for r in rows.select(evaluate.option_scores(F.col("o"), F.col("c"))).collect()] == [[3, 1, None, 0], None, [0], [2, 0]]
    n = 150_000  # word by word this takes minutes
    words = [f"w{k:06d}" for k in range(n)]
    one = spark.createDataFrame([([" ".join(words[: n // 2]), " ".join(words[n // 2 :]) + " none"], " ".join(words))], f"o {o}, c string")
    began = time.monotonic()
    assert one.select(evaluate.option_scores(F.col("o"), F.col("c"))).first()[0] == [n // 2, n // 2]
    assert time.monotonic() - began < 15


def test_a_model_answers(spark):
    q, e = frames(spark)
    seen = evaluate.evaluated(q, e, make=lambda: lambda prompts: ["I choose B"] * len(prompts))[0].collect()
    assert {r["predicted"] for r in seen} == {"B"} and {r["method"] for r in seen} == {"pattern_match"}

    def broken():
        def model(prompts):
            raise RuntimeError

        return model

    assert {r["predicted"] for r in evaluate.evaluated(q, e, make=broken)[0].collect()} == {"A"}
    rows = spark.createDataFrame([(1, "c" * 500, "q", ["x", "y"])], "q_id long, context string, question string, options array<string>")
    assert models.answered(rows, lambda: lambda ps: [str(len(p)) for p in ps], most=100).first()["response"] == "100"


def test_two_searches(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "q_id long")
    hits = "q_id long, id long, rank int"
    first = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 7, 1), (2, 9, 2), (2, 5, 3)], hits)
    second = spark.createDataFrame([(1, 9, 1), (1, 6, 2), (2, 6, 1)], hits)
    chunks = spark.createDataFrame([(5, "e"), (6, "f"), (7, "g"), (8, "g"), (9, "i")], "id long, text string")
    assert {r["q_id"]: r["context"] for r in models.two_searches(asked, first, second, chunks, fallback="nothing").collect()} == {1: "g\ni\nf", 2: "g\ni\ne", 3: "nothing"}


def test_collected_question_sets(spark, tmp_path):
    raw = {
        "multiple_choice": [
            {"question": " q1 ", "options": ["A. one", {"text": "(B) two"}, {"answer": "c) three"}, " "], "correct_answer": " b "},
            {"question": "q2", "options": ["x1", "y1"], "correct_answer": "A"},
            {"question": "q3", "options": ["x1", "y1", "z1"]},
        ],
        "true_false": [
            {"main_question": "m (Sách giáo khoa, tr. 5)", "sub_questions": {"b": "second", "A": {"text": "a) first"}}, "correct_answers": "T,F"},
            {"main_question": "", "sub_questions": ["said (theo sach giao khoa)", ""], "correct_answers": ["F", True]},
            {"main_question": "none", "sub_questions": [], "correct_answers": []},
        ],
    }
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    assert command.main(["--convert", f"{tmp_path}/raw.json", "--output", f"{tmp_path}/out", "--unknown"]) == 0
    got = {(r["q_type"], r["id"]): (r["question"], [(o["answer"], o["isCorrect"]) for o in r["options"]]) for r in files.questions_json(spark, f"{tmp_path}/out").collect()}
    yes, no = [("Đúng", True), ("Sai", False)], [("Đúng", False), ("Sai", True)]
    assert got == {
        ("multiple_choice", 1): ("q1", [("one", False), ("two", True), ("three", False)]),
        ("multiple_choice", 2): ("q3", [("x1", False), ("y1", False), ("z1", False)]),
        ("true_false", 1): ('m Phát biểu sau: "first" là đúng hay sai', yes),
        ("true_false", 2): ('m Phát biểu sau: "second" là đúng hay sai', no),
        ("true_false", 3): ('Phát biểu sau: "said" là đúng hay sai', no),
        ("true_false", 4): ("Phát biểu sau là đúng hay sai", yes),
    }
    (tmp_path / "root.json").write_text(json.dumps({"main_question": "m", "sub_questions": ["s"], "correct_answers": "T"}))
    mc, tf = files.raw_questions(spark, f"{tmp_path}/root.json")
    assert mc.count() == 0 and [r["is_true"] for r in ingest.true_false(tf).collect()] == [True]


def test_command_line(spark, tmp_path, capsys):
    kg = {"entities": [{"id": n, "label": [n], "type": "T", "description": d, "original_text": t} for n, d, t in ENTITIES], "triplets": []}
    sets = {t: [{"question": x, "options": [{"answer": a, "isCorrect": bool(c)} for a, c in o]} for u, _, x, o in questions() if u == t] for t in ("multiple_choice", "true_false")}
    (tmp_path / "kg.json").write_text(json.dumps(kg))
    (tmp_path / "q.json").write_text(json.dumps(sets))
    assert command.main([]) == 2
    assert command.main(["--kg-file", f"{tmp_path}/kg.json", "--questions-file", f"{tmp_path}/q.json", "--num-mc", "3", "--output", f"{tmp_path}/page"]) == 0
    said = capsys.readouterr().out
    assert "multiple_choice: " in said and " of 3 right" in said and " a minute" in said
    page = "".join(p.read_text() for p in (tmp_path / "page").glob("part-*"))
    assert page.startswith("<!DOCTYPE html>") and page.count('<div class="card ') == 5 and "<details>" in page and "badge" in page and "&quot;" not in page


def test_cards_are_escaped(spark):
    q = spark.createDataFrame([("multiple_choice", 1, "<b>&", [("<i>", True), ("b", False)])], Q)
    e = frames(spark)[1]
    card = evaluate.full_cards(evaluate.evaluated(q, e)[0]).first()["card"]
    assert "&lt;b&gt;&amp;" in card and "&lt;i&gt;" in card and "<i>" not in card
    assert "0 of 0" not in sinks.summary(evaluate.totals(*evaluate.evaluated(q, e)))
