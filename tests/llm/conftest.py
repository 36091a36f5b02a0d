import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use for their own.
CLASHES = ("id", "key", "row", "size", "kept", "blocks", "pii", "_id", "_key", "a", "b", "found", "spread", "component_id")


def prose(k: int, n: int) -> str:
    """n words that no other k shares."""
    return " ".join(f"w{k}x{(i * i + 7 * i) % 1009}" for i in range(n))


@pytest.fixture
def documents(spark):
    """make(rows, extra): documents of (doc_id, text, lang, source); extra adds columns with clashing names."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.concat(F.lit("own "), F.col("doc_id").cast("string")) for c in CLASHES})
        return df

    return make


#: Nulls in every column, empty and long texts, repeated rows, repeated ids.
ODD = [
    (1, None, None, None),
    (2, "", "en", "s"),
    (3, " \t\n ", "en", None),
    (4, "word", None, "s"),
    (5, prose(5, 30_000), "en", "s"),
    (6, "the same text twice over and over", "en", "t"),
    (6, "the same text twice over and over", "en", "t"),
    (None, "no id but a text of some words", "en", "t"),
    (7, "Ünïcödé – 中文 text and \U0001f600", "xx", "t"),
    (7, "another text of one id", "en", "s"),
]
