"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.sources.workdir import materialize

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"

# Entries of a worker's memo of pieces; it starts anew when full.
MEMO_ENTRIES = 400_000

# A single space between a visible character and a Latin letter: the pre-tokenizer of byte-level BPE
# always starts a new word there, and no merge and no special string reaches across, so the counts of
# the pieces add up to the count of the text.
_SEAM = re.compile("(?<=[!-~À-ÖØ-öø-ÿ]) (?=[A-Za-zÀ-ÖØ-öø-ÿ])")


def no_normalisation(text: Column) -> Column:
    """Null becomes empty. Byte-level BPE counts differ for any wider folding of a text."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(tokenizer_file: str) -> str:
    """The version of a tokenizer: the digest of its file and of the library that reads it."""
    import tokenizers
    with open(tokenizer_file, "rb") as source:
        return hashlib.sha256(source.read() + tokenizers.__version__.encode()).hexdigest()


@lru_cache(maxsize=4)
def _tokenizer(tokenizer_file: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file)


@lru_cache(maxsize=4)
def _memo(tokenizer_file: str) -> dict[str, int]:
    return {}


def _splits_at_words(tokenizer_file: str) -> bool:
    """Whether the file is byte-level BPE with its standard word pattern and no special string with a space."""
    import json
    with open(tokenizer_file, encoding="utf-8") as source:
        spec = json.load(source)
    words = spec.get("pre_tokenizer") or {}
    return (words.get("type") == "ByteLevel" and words.get("use_regex", True)
            and not words.get("add_prefix_space") and not spec.get("normalizer")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]
                        for t in spec.get("added_tokens", [])))


def encoded_lengths(tokenizer_file: str) -> Callable[[Column], Column]:
    """A column function: the number of tokens of a text, as the library counts them.

    Texts are cut at word seams and every distinct piece is encoded once per worker; where the file's
    word pattern gives no such seams, whole texts are encoded.
    """
    seams = _splits_at_words(tokenizer_file)

    def count(texts: pd.Series) -> list[int]:
        tokenizer = _tokenizer(tokenizer_file)
        if not seams:
            return [len(tokenizer.encode(x, add_special_tokens=False)) for x in texts]
        memo = _memo(tokenizer_file)
        counts = []
        for text in texts:
            first, *rest = _SEAM.split(text)
            pieces = [first, *[" " + x for x in rest]]
            missing = list({x for x in pieces if x not in memo})
            if len(memo) + len(missing) > MEMO_ENTRIES:
                memo.clear()
                missing = list(set(pieces))
            total = None
            if len(missing) > MEMO_ENTRIES:
                total = sum(len(tokenizer.encode(x, add_special_tokens=False)) for x in pieces)
            elif missing:
                for x, e in zip(missing, tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
                    memo[x] = len(e)
            counts.append(sum(map(memo.__getitem__, pieces)) if total is None else total)
        return counts

    @F.pandas_udf("bigint")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for texts in batches:
            yield pd.Series(count(texts), dtype="int64")

    return lengths


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest.

    Runs that append at the same time may store a digest twice, with the same count.
    """
    if _exists(spark, cache_path):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    else:
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return (stored.where(F.col("tokenizer") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(documents: DataFrame, text: str, keep: Sequence[str], tokenizer_file: str, cache_path: str,
                 normalise: Callable[[Column], Column] = no_normalisation) -> DataFrame:
    """Token counts of whole texts: ``keep`` columns, ``n_bytes`` and ``n_tokens``.

    Normalised contents are digested (SHA-256). Digests that the cache at ``cache_path`` lacks for this
    tokenizer version are encoded, once for each distinct content, and appended to the cache; all counts
    are then read from it. Only contents that miss the cache are shuffled.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows each get a row. An empty table gives an
    empty result. Other columns of the input take no part, whatever their names.
    """
    spark = documents.sparkSession
    version = tokenizer_digest(tokenizer_file)
    content = normalise(F.col(text))
    digest = F.unhex(F.sha2(content, 256))
    known = read_cache(spark, cache_path, version)
    rows = documents.select(digest.alias("digest"), content.alias("content"))
    if _exists(spark, cache_path):
        rows = rows.join(known, "digest", "left_anti")
    misses = rows.dropDuplicates(["digest"])
    (misses.select(F.lit(version).alias("tokenizer"), "digest",
                   encoded_lengths(tokenizer_file)("content").alias("n_tokens"))
     .write.mode("append").parquet(cache_path))
    # Written out, so that the join is between two plain shuffles and a digest of very many rows can be split.
    counts = materialize(read_cache(spark, cache_path, version), "counts")
    kept = documents.select(F.struct(*keep).alias("kept"), digest.alias("digest"),
                            F.octet_length(content).cast("bigint").alias("n_bytes"))
    return kept.join(counts, "digest").select("kept.*", "n_bytes", "n_tokens")
