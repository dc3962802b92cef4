"""Small tables and plain Python versions that the tests share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over a lazy dog and runs away from here\n" * 6000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASHING = ("row", "kept", "found", "hit", "hits", "bits", "root", "digest", "content", "tokens", "weight", "topic",
            "shard", "slot", "label", "words", "text_key", "__id", "spans", "group", "size", "item", "id", "code")


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties and clashing columns."""
    rows = [(1, "alpha beta gamma delta epsilon", "en", "a"), (1, "alpha beta gamma delta epsilon", "en", "a"),
            (2, "alpha beta gamma delta epsilon", None, None), (3, None, "en", "a"), (None, None, None, None),
            (None, "une phrase sans numéro et sans langue", None, "b"), (4, "", "en", "a"), (5, " \n\t ", "fr", "b"),
            (6, LONG, "en", "a"), (7, "Привет мир это текст", "ru", "c"), (8, "12345 67890", "en", "c"),
            (9, "released under the MIT License.\nzwei\x00drei", "de", "c"), (9, "another text with the same id", "en", "a")]
    df = spark.createDataFrame([(i, t, l, s, len(t) if t is not None else None) for i, t, l, s in rows], SCHEMA)
    return df.select("*", *[F.lit(7).alias(n) for n in CLASHING])


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


class Groups:
    """Union-find."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def python_nodes(df: DataFrame) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("Python", "Pandas", "Arrow") if x in plan]
