import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, an extra column with a clashing name."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"word{i % 977} and the{i % 13}" for i in range(60_000))
    prose = " ".join(f"the quick brown fox {i} of the river and it was {i * 7} more" for i in range(12))
    rows = [
        (1, prose, "en", "a", 0),
        (1, prose, "en", "a", 0),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\n ", "de", None, 3),
        (5, long_text, "en", "b", 1),
        (None, prose + " end", "en", "b", 1),
        (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 8, "de", "b", 1),
        (8, "漢字 と 仮名 😀 mixed\x00text", "ja", "c", 1),
        (9, "one", "en", "c", 1),
        (10, prose.replace("river", "stream"), "en", "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("_row", F.lit(1)).withColumn("size", F.lit("x"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
