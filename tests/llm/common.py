"""Small tables with the awkward cases that every operator must stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=None):
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in extra or []:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("own"))
    return df


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names operators use themselves."""
    long = "lorem ipsum dolor sit amet " * 20000
    rows = [
        (1, "", "en", "a", 0, 1.0),
        (2, None, "en", "a", None, 2.0),
        (None, "some text without an id", "en", "b", 23, 3.0),
        (4, long, None, None, len(long), None),
        (5, "a repeated row of text that comes twice here", "en", "b", 44, 5.0),
        (5, "a repeated row of text that comes twice here", "en", "b", 44, 5.0),
        (7, "   \n\t ", "fr", "", 6, 7.0),
        (8, "x" * 70000, "de", "c", 70000, 8.0),
        (9, "éàü 日本語 \U0001f600 naïve", "xx", "c", 15, 9.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").selectExpr(
        "*", "1 as group_id", "'k' as keep", "0 as copy", "'v' as value", "1 as kind", "0 as label", "'q' as toxic", "3 as rn"
    )
