"""The driver's star schema as a knowledge graph: rows are entities, foreign keys are triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import KnowledgeGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, kind: str, part: int, mark: str, key: str, name: str, about) -> DataFrame:
    return df.select(
        F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"),
        F.array(F.col(name)).alias("label"),
        F.lit(kind).alias("type"),
        about.alias("description"),
        F.col(name).alias("original_text"),
        (F.lit(part).cast("long") * 1000000000 + F.col(key)).alias("seq"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    out = _rows(t("region"), "region", 0, "r_", "r_regionkey", "r_name", F.concat(F.lit("region "), "r_name"))
    out = out.union(_rows(t("nation"), "nation", 1, "n_", "n_nationkey", "n_name", F.concat(F.lit("nation "), "n_name")))
    out = out.union(_rows(t("supplier"), "supplier", 2, "s_", "s_suppkey", "s_name", F.concat(F.lit("supplier of nation "), F.col("s_nationkey").cast("string"))))
    out = out.union(_rows(t("customer"), "customer", 3, "c_", "c_custkey", "c_name", F.concat(F.lit("customer in "), "c_mktsegment")))
    return out.union(_rows(t("part"), "part", 4, "p_", "p_partkey", "p_name", F.concat("p_brand", F.lit(" "), "p_type")))


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def edge(df, part, a, key, predicate, b, to):
        return df.select(F.concat(F.lit(a), F.col(key).cast("string")).alias("subject_id"), F.lit(predicate).alias("predicate"), F.concat(F.lit(b), F.col(to).cast("string")).alias("object_id"), (F.lit(part).cast("long") * 1000000000 + F.col(key)).alias("seq"))

    out = edge(t("nation"), 0, "n_", "n_nationkey", "in region", "r_", "n_regionkey")
    out = out.union(edge(t("supplier"), 1, "s_", "s_suppkey", "in nation", "n_", "s_nationkey"))
    out = out.union(edge(t("customer"), 2, "c_", "c_custkey", "in nation", "n_", "c_nationkey"))
    return out.union(edge(t("lineitem"), 3, "s_", "l_suppkey", "supplies", "p_", "l_partkey"))


def graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    return KnowledgeGraph(entities(spark, sf_dir), triplets(spark, sf_dir))


ENTITIES = """
e AS (
  SELECT 'r_' || r_regionkey AS id, r_name AS name, 'region' AS type, 'region ' || r_name AS description, 0::BIGINT * 1000000000 + r_regionkey AS seq FROM region
  UNION ALL SELECT 'n_' || n_nationkey, n_name, 'nation', 'nation ' || n_name, 1::BIGINT * 1000000000 + n_nationkey FROM nation
  UNION ALL SELECT 's_' || s_suppkey, s_name, 'supplier', 'supplier of nation ' || s_nationkey, 2::BIGINT * 1000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'c_' || c_custkey, c_name, 'customer', 'customer in ' || c_mktsegment, 3::BIGINT * 1000000000 + c_custkey FROM customer
  UNION ALL SELECT 'p_' || p_partkey, p_name, 'part', p_brand || ' ' || p_type, 4::BIGINT * 1000000000 + p_partkey FROM part
)"""
TRIPLETS = """
t AS (
  SELECT 'n_' || n_nationkey AS subject_id, 'in region' AS predicate, 'r_' || n_regionkey AS object_id, 0::BIGINT * 1000000000 + n_nationkey AS seq FROM nation
  UNION ALL SELECT 's_' || s_suppkey, 'in nation', 'n_' || s_nationkey, 1::BIGINT * 1000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'c_' || c_custkey, 'in nation', 'n_' || c_nationkey, 2::BIGINT * 1000000000 + c_custkey FROM customer
  UNION ALL SELECT 's_' || l_suppkey, 'supplies', 'p_' || l_partkey, 3::BIGINT * 1000000000 + l_suppkey FROM lineitem
)"""
