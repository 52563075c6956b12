import pytest

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
SF = "/root/testdata/sf0.001"
#: Nulls in every column, empty and very long texts, ties and repeated rows.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "src0", 43),
    (1, "The quick brown fox jumps over the lazy dog", "en", "src0", 43),
    (2, "the quick  brown fox jumps over the lazy dog", "en", "src1", 44),
    (3, None, "en", "src2", None),
    (4, "", None, None, 0),
    (5, "   \n\t ", "de", "unknown", 6),
    (6, "wörd " * 40_000, "de", "src3", 200_000),
    (None, "no id", "fr", "src4", 5),
    (None, None, None, None, None),
    (7, "<|endoftext|> it's  a\ntest 日本語 \x1c x", "en", "src0", 30),
    (8, "x", "en", "src0", 1),
    (9, "call +1 (555) 123-4567 or a@b.co, 10.0.0.1, 4111 1111 1111 1111", "en", "src1", 60),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(edge):
    """Further columns whose names the operators use."""
    from pyspark.sql import functions as F

    names = ("fp", "key", "component_id", "slot", "place", "stream", "block", "_h", "_row", "score", "predicted", "held_out", "n_tokens", "start", "ids", "part", "media", "bin", "length", "cluster", "toxic")
    return edge.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
