"""Column helpers that several operators of this folder share."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> Column:
    """A 64-bit hash that tells rows with the same id and different texts apart; null texts get their own."""
    return F.xxhash64(text, text.isNull())


def code_points(text: str) -> np.ndarray:
    """The characters of a text as uint32."""
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def spans(lengths: np.ndarray) -> np.ndarray:
    """For runs of the given lengths laid end to end: the place of every element in its run."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def by_size(texts: Iterable[str | None], limit: int) -> Iterator[list[str]]:
    """Split texts into lists of about ``limit`` characters, so that working arrays stay small.

    A null text counts as empty. A text longer than the limit makes up a list of its own.
    """
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
