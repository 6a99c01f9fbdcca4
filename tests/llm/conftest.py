"""Small document tables with the awkward cases every operator must take."""
import pytest

LONG = " ".join(f"w{i % 997}x" for i in range(30_000))

ROWS = [
    (0, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
    (1, "the  quick\tbrown fox\njumps over the lazy dog", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "   \n\t ", "en", None, 0),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG, None, "b", len(LONG)),
    (7, "the quick brown fox jumps over the lazy dog", "de", "c", 1),
    (7, "the quick brown fox jumps over the lazy dog", "de", "c", 1),
    (None, "a row without an id and the lazy dog", "en", "c", 1),
    (9, "çà et là ß Straße Ñandú İstanbul ΟΔΟΣ é 日本語 1234 don't <|endoftext|>", "fr", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows, with extra columns whose names clash with internal ones."""
    from pyspark.sql import functions as F
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in ("kept", "size", "src", "id", "component_id", "score", "uid", "key", "n", "u"):
        d = d.withColumn(c, F.lit("x"))
    return d.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
