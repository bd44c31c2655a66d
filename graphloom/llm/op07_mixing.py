"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's share of the budget is its weight; a source that would pass MOST_EPOCHS repetitions is clamped there, and what it leaves
goes to the others in proportion to their weights, until no source passes the cap. With the sources sorted by cap / weight that
fixed point is one pass of running sums: source i is clamped iff cap_i / w_i <= (budget - caps before i) / (weights from i on).
A row is then repeated floor(epochs) times, and once more if a seeded hash of its doc_id falls below the fraction.

Sizes are characters, counted over all rows. The source table has one row a source; it is written and joined as Spark sees fit
(broadcast only below the session's threshold), so texts are not shuffled for it while it is small.

Defined results: a null source is a source of its own; a null text counts 0 characters; a source of 0 characters keeps each row
once; a source without a weight (or with none above 0) is left out; a null doc_id draws by its text; repeated rows draw alike; an
empty table gives an empty result; other columns are passed through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import _shared as S

#: Weight of a source: its characters to this power, unless weights are given.
ALPHA = 0.7
#: Budget in characters, as a multiple of the corpus; most repetitions of a source; seed of the fractional draw.
BUDGET, MOST_EPOCHS, SEED = 1.5, 4.0, 17
SOURCE, EPOCHS, COPY = f"{S.OWN}source", f"{S.OWN}epochs", f"{S.OWN}copy"


def water_fill(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, most: float = MOST_EPOCHS) -> DataFrame:
    """One row a source: source, docs, size, weight, target and allocated characters, epochs, clamped."""
    size = docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("size"))
    if weights is None:
        sized = size.withColumn("weight", F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(ALPHA))).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "s string, weight double")
        sized = size.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    everything = Window.partitionBy(F.lit(1))
    open_to = (F.col("weight") > 0) & (F.col("size") > 0)
    level = F.when(open_to, F.col("cap") / F.col("weight"))
    by = everything.orderBy(F.col("level").asc_nulls_last(), F.col("source").asc_nulls_first())
    filled = (
        sized.withColumn("total", F.sum("size").over(everything) * F.lit(budget))
        .withColumn("cap", F.col("size") * F.lit(most))
        .withColumn("level", level)
        .withColumn("before", F.coalesce(F.sum(F.when(open_to, F.col("cap"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum(F.when(open_to, F.col("weight")).otherwise(0.0)).over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("here", F.when(open_to, (F.col("total") - F.col("before")) / F.col("rest")))
        .withColumn("clamped", F.coalesce(F.col("level") <= F.col("here"), F.lit(False)))
        .withColumn("water", F.max(F.when(~F.col("clamped"), F.col("here"))).over(everything))
    )
    whole = F.sum("weight").over(everything)
    return (
        filled.withColumn("target", F.when(whole > 0, F.col("total") * F.col("weight") / whole).otherwise(0.0))
        .withColumn("allocated", F.when(~open_to, 0.0).when(F.col("clamped"), F.col("cap")).otherwise(F.col("water") * F.col("weight")))
        .withColumn("epochs", F.when(F.col("size") == 0, 1.0).when(F.col("weight") <= 0, 0.0).when(F.col("clamped"), F.lit(float(most))).otherwise(F.col("allocated") / F.col("size")))
        .select("source", "docs", "size", "weight", "target", "allocated", "epochs", "clamped")
    )


def draw(doc_id: F.Column, text: F.Column, seed: int = SEED) -> F.Column:
    """A number in [0, 1) that follows from the seed and the row's id alone (its text where the id is null)."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, most: float = MOST_EPOCHS, copy: str | None = None) -> DataFrame:
    """docs with each row as often as the mix has it; columns as they came, and with `copy` also the number of the repetition, from 1."""
    epochs = S.written(water_fill(docs, weights, budget, most).select(F.col("source").alias(SOURCE), F.col("epochs").alias(EPOCHS)), "mix")
    named = docs.join(epochs, F.col("source").eqNullSafe(F.col(SOURCE)))
    whole = F.floor(EPOCHS)
    times = (whole + F.when(draw(F.col("doc_id"), F.col("text")) < F.col(EPOCHS) - whole, 1).otherwise(0)).cast("int")
    out = named.withColumn(COPY, times).where(F.col(COPY) > 0).withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col(COPY))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(COPY).alias(copy)] if copy else []))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs, copy="copy")


SQL = f"""
WITH size AS (
  SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size FROM documents GROUP BY source
), sized AS (
  SELECT source, size, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), {ALPHA}) ELSE 0.0 END AS weight,
         size * {MOST_EPOCHS}::DOUBLE AS cap, sum(size) OVER () * {BUDGET}::DOUBLE AS total FROM size
), levels AS (
  SELECT *, CASE WHEN size > 0 THEN cap / weight END AS level FROM sized
), running AS (
  SELECT *, coalesce(sum(CASE WHEN size > 0 THEN cap END) OVER (ORDER BY level ASC NULLS LAST, source ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before_,
         sum(weight) OVER (ORDER BY level ASC NULLS LAST, source ASC NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM levels
), here AS (
  SELECT *, CASE WHEN size > 0 THEN (total - before_) / rest END AS here FROM running
), water AS (
  SELECT *, coalesce(level <= here, false) AS clamped, max(CASE WHEN NOT coalesce(level <= here, false) THEN here END) OVER () AS water FROM here
), epochs AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0 WHEN clamped THEN {MOST_EPOCHS} ELSE water * weight / size END AS epochs FROM water
), counted AS (
  SELECT d.doc_id, d.source, d.text,
         CAST(floor(epochs) AS INTEGER) + CASE WHEN CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, '')))), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0
              < epochs - floor(epochs) THEN 1 ELSE 0 END AS times
  FROM documents d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, source, text, CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy FROM counted WHERE times > 0
"""
