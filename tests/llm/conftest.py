import pytest
from pyspark.sql import types as T

LONG = "x " * 200_000
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for columns of their own.
        T.StructField("s", T.StringType()),
        T.StructField("rest", T.StringType()),
        T.StructField("starts", T.LongType()),
        T.StructField("_copies", T.LongType()),
    ]
)
PROSE = " ".join(f"word{i % 97} runs{i % 13}" for i in range(60))
OTHER = " ".join(f"thing{i} goes{i % 7}" for i in range(60))


def rows(*texts_and_sources, first=0):
    return [
        (first + i, t, "en", s, len(t) if t is not None else None, "a", "b", 1, 2)
        for i, (t, s) in enumerate(texts_and_sources)
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, clashing names."""
    data = rows(
        (PROSE, "a"),
        (PROSE, "a"),
        (OTHER, "b"),
        (OTHER + " end", "b"),
        (None, "a"),
        ("", None),
        (" \n\t ", None),
        (LONG, "c"),
        ("Üñí \U0001f600 ￿ " + OTHER, None),
    )
    data.append((None, PROSE, None, None, None, None, None, None, None))
    data += [data[2], data[2]]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
