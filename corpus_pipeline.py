"""From raw documents to shards of a training corpus: five stages, each one operator of ``riskgrid.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm import decontaminate, language, mixing, sharding, simhash
from riskgrid.llm.common import table
from riskgrid.llm.queries import POWERS
from riskgrid.sources.workdir import materialize

# Documents with a smaller share of letters in learned languages, all together, are rejected: texts of several
# languages stay, text in scripts that no learned language uses goes.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those with hardly any text in a known language.

    A document without a language gets the one that was found. Null and empty texts go.
    """
    model = language.fit(docs, "doc_id", "text", "lang")
    found = docs.select(F.struct(*docs.columns).alias("row"),
                        language.identify(spark, model, docs["text"]).alias("found"))
    kept = found.where((F.col("found.lang") != language.UNKNOWN) & (F.col("found.known") >= LEAST_SCORE))
    return kept.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "found.lang"))).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near-duplicates, the one with the smallest id."""
    return simhash.one_per_group(docs, "doc_id", "text")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics have their target shares of tokens."""
    mixed = mixing.mix(docs, "doc_id", mixing.document_margins(), mixing.token_weight(F.col("text")),
                       powers=POWERS, keep=[F.struct(*docs.columns).alias("row")], content=F.col("text"))
    return mixed.where("sampled").select("row.*")


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left."""
    return sharding.assign(docs, "doc_id", "text")


STAGES = [("language_id", identify_language), ("simhash_dedup", drop_near_duplicates),
          ("decontaminate", decontaminate_benchmark), ("mix", mix_sources), ("shards", deal_shards)]

# Language models, fingerprint anchors and packing have no SQL; tests/llm compares each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, name)
    return docs
