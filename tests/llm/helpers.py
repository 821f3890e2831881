"""Small inputs shared by the operator tests."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                     StructField("lang", StringType()), StructField("source", StringType()),
                     StructField("n_chars", LongType())])
# names that operators use or add, as extra input columns
CLASHING = ("shard", "SLOT", "size", "copies", "rec", "k1", "h", "bucket", "n_lines", "m", "kept", "spans", "id", "fp",
            "target", "u", "x", "gone", "lines", "clean", "octave", "of", "b", "place")


def words(rng, n):
    pool = ["the", "of", "and", "tree", "stone", "river", "light", "Über", "naïve", "12", "x7", "wind,", "rain.", "sun!"]
    return " ".join(rng.choice(pool) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long_text = "\n".join(words(rng, 12) for _ in range(3000))
    plain = "\n".join(words(rng, 9) for _ in range(6))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t \x0b\n", None, None), (None, plain, "en", None),
            (None, None, None, None), (5, "w" * 100_000, "de", "b"), (6, long_text, "en", "a"),
            (7, plain, "de", "b"), (7, plain, "de", "b"), (7, plain + " other", "de", "b"), (8, plain, None, "a"),
            (9, "漢字 かな 한글 кириллица", "zh", "c"), (10, "one two", "en", "c")]
    rows += [(20 + i, words(rng, rng.randint(1, 60)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(40)]
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]


def edges(spark, clashing=False):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    if clashing:
        df = df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHING])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
