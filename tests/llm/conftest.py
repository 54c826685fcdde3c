import pytest

from pyspark.sql import types as T

#: Names that operators use inside; as extra columns they must not disturb.
CLASHING = ["kept", "keep_id", "score", "label", "key", "node", "row", "size", "before", "bucket", "salt", "body", "_part", "_g", "at", "n", "c1", "word", "part", "held", "host"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING],
])


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * (seed % 13 + 3)) % 5003}" for i in range(n))


def texts():
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "a"), (2, base.upper().replace("W", "w"), "a"), (3, base, "b"), (4, " ".join(near), "b"), (5, "", "a"), (6, None, None),
        (7, " \t\n ", None), (8, "one", "c"), (9, "One", "c"), (None, base, "a"), (None, "alone without an id", "c"), (11, words(2, 40), None),
        (11, words(2, 40), None), (12, words(3, 30_000), "d"), (13, "Ünïcode Ä\u00a0b ÄÖ ß İ.\nNext line! \u2003x", "c"), (14, "ünïcode Ä\u00a0b ÄÖ ß İ.\nnext LINE! \u2003x", "c"),
        (15, words(2, 40) + " " + words(4, 200), "a"), (16, words(4, 200), "a"), (17, "<|endoftext|> a,b. c", "a"),
    ]


@pytest.fixture
def rows():
    return texts()


@pytest.fixture
def make(spark):
    def build(rows, schema=SCHEMA):
        full = [(i, t, "en", s, len(t or ""), *("x",) * len(CLASHING)) for i, t, s in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return build


@pytest.fixture
def messy(make, rows):
    return make(rows)
