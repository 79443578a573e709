import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 977} tail{i}." for i in range(20_000))
PROSE = "The river ran past the old mill and the miller counted every sack of grain that left the yard before the evening bell rang in the valley below."


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make


#: Nulls, empty and blank texts, a very long one, repeated rows, repeated and null ids, ties.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (5, PROSE), (6, LONG), (None, PROSE), (None, None), (4, "another text with the same id"),
    (7, "Straße ñandú été 漢字 \U0001f600 ok"), (8, "a"), (9, "a\x00b\r\nc")]
CLASHING = ("score", "size", "fp", "uid", "raw", "found", "p", "label", "y", "kept", "mix_copy")


@pytest.fixture(scope="session")
def awkward(documents):
    return documents([(a, b, None if i % 3 == 0 else f"s{i % 3}") for i, (a, b) in enumerate(AWKWARD)], CLASHING)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
