"""Building a graph from files as they come: each micro-batch is cut into chunks, extracted, and merged into those parts of the tables that it concerns."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.lineage import forget, written
from graphloom.operators.graph import KnowledgeGraph, merge_graphs
from graphloom.operators.ingest import ENTITY, TRIPLET, parsed

#: Turns (id, text) into (id, response); a model behind an Arrow UDF, or a rule in tests. Ids are texts.
Extractor = Callable[[DataFrame], DataFrame]


def extracted(texts: DataFrame, extract: Extractor, most: int = 1200, version: int = 0) -> KnowledgeGraph:
    """texts: path, text. Chunks whose response has no entity give nothing; seq is (version, path, chunk, place), so rows of a later version come after all of an earlier one."""
    pieces = texts.select("path", F.posexplode(T.chunks(F.col("text"), most)).alias("no", "text"))
    rows = parsed(extract(pieces.select(F.concat_ws("|", F.col("no").cast("string"), "path").alias("id"), "text"))).where("ok")
    no = F.substring_index("id", "|", 1)
    seq = F.struct(F.lit(version).cast("long").alias("version"), F.expr("substring(id, length(substring_index(id, '|', 1)) + 2)").alias("path"), no.cast("long").alias("chunk"), F.col("k").cast("long").alias("place"))
    spread = lambda name: rows.select("id", F.posexplode(name).alias("k", "r")).select("r.*", seq.alias("seq"))
    return KnowledgeGraph(spread("entities"), spread("triplets"))


def sequentially(make: Callable[[], Callable[[str, str], str]], most: int = 100) -> Extractor:
    """An extractor that works off the chunks of a file one after another: the model is given a chunk and one line for each of the last `most` entities of the chunks before it.

    Files are independent, so they are the parallelism; a file's chunks are held by one task. A response that is no graph adds nothing to what the next chunk is told.
    """

    def of_file(chunks: pd.DataFrame) -> pd.DataFrame:
        model, known, said = make(), {}, []
        chunks = chunks.assign(no=[int(i.split("|", 1)[0]) for i in chunks["id"]]).sort_values("no")
        for text in chunks["text"]:
            lines = [f"- {e['id']} ({e['type']}): {', '.join(e['label'][:3])}" for e in list(known.values())[-most:]]
            said.append(model(text, "\n".join(lines)))
            known |= {e["id"]: e for e in _entities(said[-1]) if e["id"] not in known}
        return pd.DataFrame({"id": chunks["id"], "response": said})

    def extract(chunks: DataFrame) -> DataFrame:
        return chunks.groupBy(F.expr("substring(id, length(substring_index(id, '|', 1)) + 2)")).applyInPandas(of_file, "id string, response string")

    return extract


def _entities(response: str) -> list[dict]:
    """What a response tells the next chunk: entities with id, type and labels."""
    try:
        found = json.loads(response[response.index("{") : response.rindex("}") + 1]).get("entities", [])
    except (ValueError, AttributeError):
        return []
    listed = lambda e: e["label"] if isinstance(e.get("label"), list) else [e.get("label", e["id"])]
    return [{"id": str(e["id"]), "type": str(e.get("type", "")), "label": [str(x) for x in listed(e)]} for e in found if isinstance(e, dict) and e.get("id")]


#: Parts that a stored graph is cut into, by a hash of an entity's id or a triplet's subject; a batch writes only those that it changes.
BUCKETS = 64
SEQ = "STRUCT<version: BIGINT, path: STRING, chunk: BIGINT, place: BIGINT>"
KEY = {"entities": "id", "triplets": "subject_id"}
SCHEMA = {name: f"{kind.removeprefix('STRUCT<').removesuffix('>')}, seq: {SEQ}" for name, kind in (("entities", ENTITY), ("triplets", TRIPLET))}


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[str, dict[int, int]]:
    """For each table the version that last wrote each bucket."""
    if version < 0:
        return {name: {} for name in KEY}
    rows = spark.read.schema("name string, bucket int, version int").parquet(f"{folder}/manifest/v{version}").collect()  # 2 * BUCKETS at most
    return {name: {r["bucket"]: r["version"] for r in rows if r["name"] == name} for name in KEY}


def _table(spark: SparkSession, folder: str, name: str, at: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
    out = spark.createDataFrame([], SCHEMA[name])
    for version in sorted({v for b, v in at.items() if buckets is None or b in buckets}):
        own = [b for b, v in at.items() if v == version and (buckets is None or b in buckets)]
        part = spark.read.parquet(f"{folder}/{name}/v{version}").where(F.col("bucket").isin(own)).drop("bucket")
        out = out.unionByName(part)
    return out


def stored(spark: SparkSession, folder: str, version: int) -> KnowledgeGraph:
    """The graph as a version left it: each bucket from the version that last wrote it."""
    at = _manifest(spark, folder, version)
    return KnowledgeGraph(*(_table(spark, folder, name, at[name]) for name in KEY))


def build(spark: SparkSession, source: str, folder: str, extract: Extractor, most: int = 1200) -> None:
    """Work off the files of `source` that weren't yet; each batch merges what it found into the buckets concerned and writes these beside their last version, so a batch that is done again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        found = extracted(batch, extract, most, number)
        new = KnowledgeGraph(*(written(getattr(found, name).withColumn("bucket", F.pmod(F.xxhash64(KEY[name]), F.lit(BUCKETS)).cast("int")), f"new-{name}") for name in KEY))
        at = _manifest(spark, folder, number - 1)
        touched = {name: sorted(r["bucket"] for r in getattr(new, name).select("bucket").distinct().collect()) for name in KEY}
        old = KnowledgeGraph(*(_table(spark, folder, name, at[name], touched[name]) for name in KEY))
        whole = merge_graphs(old, KnowledgeGraph(*(getattr(new, name).drop("bucket") for name in KEY)), ordered=True)
        for name in KEY:
            parts = getattr(whole, name).withColumn("bucket", F.pmod(F.xxhash64(KEY[name]), F.lit(BUCKETS)).cast("int"))
            parts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}/v{number}")
            at[name] |= dict.fromkeys(touched[name], number)
        rows = [(name, b, v) for name in KEY for b, v in at[name].items()]
        spark.createDataFrame(rows, "name string, bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v{number}")
        for name in KEY:
            forget(getattr(new, name))

    files = spark.readStream.format("text").option("wholetext", "true").load(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
