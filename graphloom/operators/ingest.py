"""Model responses to graph rows: cut out, repair, parse, salvage, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T

MAP = "MAP<STRING,STRING>"
ENTITY = f"STRUCT<id: STRING, label: ARRAY<STRING>, type: STRING, description: STRING, original_text: STRING, properties: {MAP}, metadata: {MAP}>"
TRIPLET = f"STRUCT<subject_id: STRING, predicate: STRING, object_id: STRING, properties: {MAP}, metadata: {MAP}>"


READ = ENTITY.replace("label: ARRAY<STRING>", "label: STRING")


def labels(raw: Column, id_: Column) -> Column:
    """A list as it is; a single label, whatever its kind, as a list of one; without any the id."""
    return F.coalesce(F.from_json(F.when(F.startswith(raw, F.lit("[")), raw), "ARRAY<STRING>"), F.array(F.coalesce(raw, id_)))


def parsed(responses: DataFrame) -> DataFrame:
    """responses: id, response -> id, json (repaired text), ok, entities, triplets. Rows without their needed fields go; a response is ok with one entity or more."""
    fixed = responses.withColumn("json", T.repaired_json(T.json_span("response")))
    valid = F.try_parse_json("json").isNotNull()
    array = lambda name, kind: F.coalesce(F.from_json(F.when(valid, F.get_json_object("json", f"$.{name}")).otherwise(F.regexp_extract("json", rf'(?s)"{name}"\s*:\s*(\[.*?\])', 1)), f"ARRAY<{kind}>"), F.from_json(F.lit("[]"), f"ARRAY<{kind}>"))
    there = lambda r, *names: F.lit(True) if not names else F.coalesce(r[names[0]] != "", F.lit(False)) & there(r, *names[1:])
    rows = fixed.select("id", "json", valid.alias("whole"), array("entities", READ).alias("e"), array("triplets", TRIPLET).alias("t"))
    entities = F.transform(
        F.filter("e", lambda r: there(r, "id", "type", "description")),
        lambda r: F.struct(
            r["id"].alias("id"),
            labels(r["label"], r["id"]).alias("label"),
            r["type"].alias("type"),
            r["description"].alias("description"),
            F.coalesce(F.nullif(r["original_text"], F.lit("")), r["description"]).alias("original_text"),
            F.coalesce(r["properties"], F.create_map().cast("map<string,string>")).alias("properties"),
            F.coalesce(r["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"),
        ),
    )
    out = rows.select("id", "json", "whole", entities.alias("entities"), F.filter("t", lambda r: there(r, "subject_id", "predicate", "object_id")).alias("triplets"))
    return out.withColumn("ok", F.size("entities") > 0)


def first_success(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """attempts: id, attempt, response. The parsed rows of each id's first attempt that gave an entity, and the ids (with their number of attempts) that none did."""
    rows = parsed(attempts.select(F.struct("id", "attempt").alias("id"), "response"))
    best = rows.groupBy(F.col("id")["id"].alias("id")).agg(F.min_by(F.struct(F.col("id")["attempt"].alias("attempt"), "json", "entities", "triplets"), F.when(F.col("ok"), F.col("id")["attempt"])).alias("r"), F.count(F.lit(1)).alias("attempts"), F.bool_or("ok").alias("ok"))
    return best.where("ok").select("id", "r.*", "attempts"), best.where("not ok").select("id", "attempts")


def retry_seconds(message: Column) -> Column:
    """How long a refused request says to wait, and a second more; 10 where it doesn't say."""
    return F.coalesce(F.regexp_extract(message, r"retry in (\d+\.?\d*)", 1).try_cast("double") + 1, F.lit(10.0))


def _said(x: Column) -> Column:
    """Text of an option or statement that is a string or an object with text or answer."""
    given = lambda k: F.nullif(F.get_json_object(x, f"$.{k}"), F.lit(""))
    return F.when(F.startswith(F.ltrim(x), F.lit("{")) & F.try_parse_json(x).isNotNull(), F.coalesce(given("text"), given("answer"), F.lit(""))).otherwise(x)


def multiple_choice(items: DataFrame) -> DataFrame:
    """items: id, question, options array<string> (texts, or objects as JSON), correct (letter) -> those with 3 or 4 options after cleaning, options as struct(answer, isCorrect)."""
    letter = T.strip(F.coalesce(F.col("correct"), F.lit("")))
    at = F.when(F.length(letter) == 1, F.ascii(F.upper(letter)) - 65)
    options = F.filter(F.transform("options", lambda o: T.option_text(_said(o))), lambda o: o != "")
    clean = items.select("id", T.strip(F.coalesce("question", F.lit(""))).alias("question"), options.alias("o"), at.alias("at"))
    return clean.where(F.size("o").between(3, 4)).select("id", "question", F.transform("o", lambda o, k: F.struct(o.alias("answer"), F.coalesce(k == F.col("at"), F.lit(False)).alias("isCorrect"))).alias("options"))


def true_false(blocks: DataFrame) -> DataFrame:
    """blocks: id, main, subs (array<string>, or map<string,string> in order of the upper-cased keys), corrects (array<string>, or a string) -> id, k, question, is_true, options: a question for each statement."""
    kind = blocks.schema["subs"].dataType.typeName()
    subs = F.col("subs") if kind == "array" else F.transform(F.array_sort(F.transform(F.map_entries("subs"), lambda e: F.struct(F.upper(e["key"]).alias("u"), e["key"].alias("k"), e["value"].alias("v")))), lambda e: e["v"])
    given = blocks.schema["corrects"].dataType.typeName() == "array"
    answers = F.slice(F.concat(F.coalesce("corrects", F.array().cast("array<string>")), F.array_repeat(F.lit("F"), F.size("s"))), F.lit(1), F.size("s")) if given else T.answer_vector(F.col("corrects"), F.size("s"))
    spread = blocks.withColumn("s", subs).where("size(s) > 0").select("id", "main", answers.alias("c"), F.posexplode("s").alias("k", "sub"))
    main = T.without_textbook(T.strip(F.coalesce("main", F.lit(""))))
    sub = T.without_textbook(T.option_text(_said(F.coalesce("sub", F.lit("")))))
    ask, end = F.lit("Phát biểu sau"), F.lit(" là đúng hay sai")
    quoted = F.concat(ask, F.lit(': "'), sub, F.lit('"'), end)
    q = F.when((main != "") & (sub != ""), F.concat(main, F.lit(" "), quoted)).when(main != "", F.concat(main, end)).when(sub != "", quoted).otherwise(F.concat(ask, end))
    true = T.truth(F.get("c", F.col("k")))
    option = lambda t, is_: F.struct(F.lit(t).alias("answer"), is_.alias("isCorrect"))
    return spread.select("id", "k", q.alias("question"), true.alias("is_true"), F.array(option("Đúng", true), option("Sai", ~true)).alias("options"))
