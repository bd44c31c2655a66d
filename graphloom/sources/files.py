"""Reading texts, graphs and question sets."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.graph import KnowledgeGraph
from graphloom.operators.ingest import ENTITY, TRIPLET

GRAPH = f"entities ARRAY<{ENTITY}>, triplets ARRAY<{TRIPLET}>"
OPTION = "STRUCT<answer: STRING, isCorrect: BOOLEAN>"
QUESTION = f"ARRAY<STRUCT<question: STRING, options: ARRAY<{OPTION}>>>"


def _plain(path: str) -> str:
    """One spelling of a URI: a single slash behind the scheme, file: where there is none."""
    path = path if re.match(r"^\w[\w+.-]*:", path) else "file:" + str(Path(path).absolute())
    return re.sub(r"^([\w+.-]+):/+", r"\1:/", path)


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_no, path, text of whole files, numbered as listed; files that aren't there or can't be read are passed over, a path that is listed twice comes twice."""
    where = F.regexp_replace(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^([\w+.-]+):/+", "$1:/")
    read = spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").text(sorted(set(paths)), wholetext=True).select(where.alias("name"), F.col("value").alias("text"))
    listed = spark.createDataFrame([(k, p, _plain(p)) for k, p in enumerate(paths)], "file_no long, path string, name string")
    return listed.join(read, "name").select("file_no", "path", "text")


def graph_json(spark: SparkSession, path: str, strict: bool = True) -> KnowledgeGraph:
    """A graph from one JSON document. Not strict: a missing file is an empty graph; a damaged one always fails."""
    try:
        doc = spark.read.schema(GRAPH).json(path, multiLine=True, mode="FAILFAST")
    except Exception as e:
        if strict or "PATH_NOT_FOUND" not in str(e):
            raise
        doc = spark.createDataFrame([], GRAPH)
    e = doc.select(F.posexplode("entities").alias("seq", "r")).select("r.*", F.col("seq").cast("long").alias("seq"))
    t = doc.select(F.posexplode("triplets").alias("seq", "r")).select("r.*", F.col("seq").cast("long").alias("seq"))
    return KnowledgeGraph(e, t)


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """q_type, id (from 1 within its type), question, options of a question set."""
    doc = spark.read.schema(f"multiple_choice {QUESTION}, true_false {QUESTION}").json(path, multiLine=True, mode="FAILFAST")
    one = lambda name: doc.select(F.lit(name).alias("q_type"), F.posexplode(name).alias("k", "r")).select("q_type", (F.col("k") + 1).alias("id"), "r.*")
    return one("multiple_choice").union(one("true_false"))


def raw_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A question set as it is collected: multiple-choice items (id, question, options, correct) and true-or-false blocks (id, main, subs, corrects), as `ingest` takes them.

    Options and statements are texts, or objects with text or answer; statements may be an object by letter; answers a list or a text; the only block may stand at the root.
    """
    item = "STRUCT<question: STRING, options: ARRAY<STRING>, correct_answer: STRING>"
    block = "STRUCT<main_question: STRING, sub_questions: STRING, correct_answers: STRING>"
    doc = spark.read.schema(f"multiple_choice ARRAY<{item}>, true_false ARRAY<{block}>, main_question STRING, sub_questions STRING, correct_answers STRING").json(path, multiLine=True, mode="FAILFAST")
    mc = doc.select(F.posexplode("multiple_choice").alias("k", "r")).select((F.col("k") + 1).alias("id"), "r.question", "r.options", F.col("r")["correct_answer"].alias("correct"))
    root = F.array(F.struct("main_question", "sub_questions", "correct_answers"))
    there = F.col("main_question").isNotNull() & F.col("sub_questions").isNotNull() & F.col("correct_answers").isNotNull()
    blocks = doc.select(F.posexplode(F.when(F.col("true_false").isNotNull(), F.col("true_false")).when(there, root.cast(f"ARRAY<{block}>"))).alias("k", "r")).select((F.col("k") + 1).alias("id"), "r.*")
    listed = lambda c: F.from_json(F.when(F.startswith(F.ltrim(c), F.lit("[")), F.col(c)), "ARRAY<STRING>")
    by_letter = F.array_sort(F.transform(F.map_entries(F.from_json(F.when(F.startswith(F.ltrim("sub_questions"), F.lit("{")), F.col("sub_questions")), "MAP<STRING,STRING>")), lambda e: F.struct(F.upper(e["key"]).alias("u"), e["value"].alias("v"))))
    subs = F.coalesce(listed("sub_questions"), F.transform(by_letter, lambda e: e["v"]), F.array().cast("array<string>"))
    corrects = F.coalesce(listed("correct_answers"), T.answer_vector(F.col("correct_answers"), F.size(subs)))
    return mc, blocks.select("id", F.col("main_question").alias("main"), subs.alias("subs"), corrects.alias("corrects"))


def turtle(spark: SparkSession, path: str) -> KnowledgeGraph:
    """A graph from the Turtle lines that sinks.turtle writes: entity blocks of three lines, then a triple a line; with or without language tags.

    The file is read statement by statement, in splits; seq is where a statement's split begins plus its number there, so it rises along the file.
    """
    read = spark.read.option("lineSep", " .\n").text(path).select(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("n"), "value")
    s = read.select((F.col("at") + F.col("n")).alias("seq"), F.regexp_replace("value", r"(?U)^\s+|\s+\.?$", "").alias("s"))
    block = r'(?s)^:(\S+) a :([^\n]*) ;\n\s+:label "(.*)"(?:@[\w-]+)? ;\n\s+:description "(.*)"(?:@[\w-]+)?$'
    part = lambda k: F.regexp_extract("s", block, k)
    e = s.where(F.col("s").rlike(block)).select(part(3).alias("id"), F.array(part(3)).alias("label"), part(2).alias("type"), part(4).alias("description"), F.lit("").alias("original_text"), "seq")
    shape = r"^:(\S+) :(\S+) :(\S+)$"
    t = s.where(F.col("s").rlike(shape)).select(*[F.regexp_extract("s", shape, k).alias(n) for k, n in ((1, "subject_id"), (2, "predicate"), (3, "object_id"))], "seq")
    return KnowledgeGraph(e, t)
