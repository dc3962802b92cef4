"""Language identification: scripts narrow the candidates, a Viterbi path over words labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.llm.common import by_size, code_points

UNKNOWN = "und"
RESULT = "struct<lang: string, score: double, known: double, spans: array<struct<start: int, end: int, lang: string>>>"
# Labelled documents that the model is fitted on, per language. A table with more languages is refused: the model
# takes a quarter of a megabyte for each.
DOCS_PER_LANGUAGE = 400
MAX_LANGUAGES = 1024
# Letter trigrams are hashed to so many cells.
CELL_BITS = 16
# A switch of language must gain so many nats.
SWITCH_PENALTY = 12.0
# A language uses a script that makes up at least this share of its letters.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.05
# Characters whose words are scored at once, and whose texts advance side by side, for up to so many languages;
# the more languages beyond, the fewer characters, so that working arrays stay as small.
SCORE_CHARS = 500_000
PATH_CHARS = 6_000_000
LANGUAGES_AT_ONCE = 8

# Unicode blocks by script. Fixed values.
SCRIPTS = (
    ("latin", ((0x0041, 0x024F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A))), ("greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x0400, 0x052F),)), ("armenian", ((0x0530, 0x058F),)), ("hebrew", ((0x0590, 0x05FF),)),
    ("arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x0900, 0x097F),)), ("bengali", ((0x0980, 0x09FF),)), ("gurmukhi", ((0x0A00, 0x0A7F),)),
    ("gujarati", ((0x0A80, 0x0AFF),)), ("tamil", ((0x0B80, 0x0BFF),)), ("telugu", ((0x0C00, 0x0C7F),)),
    ("kannada", ((0x0C80, 0x0CFF),)), ("malayalam", ((0x0D00, 0x0D7F),)), ("thai", ((0x0E00, 0x0E7F),)),
    ("georgian", ((0x10A0, 0x10FF),)), ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)), ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: lower case of letters (0 for all else) and the script (0 for all others)."""
    letters = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            low = char.lower()
            letters[point] = ord(low) if len(low) == 1 else point
    scripts = np.zeros(0x110000, dtype=np.uint8)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            scripts[first: last + 1] = number
    return letters, scripts


def _cells(low: np.ndarray) -> np.ndarray:
    """The hashed trigram around every place; what is not a letter is one symbol."""
    x = low.astype(np.uint32)
    around = np.r_[np.uint32(0), x, np.uint32(0)]
    mixed = (around[:-2] * np.uint32(0x9E3779B1)) ^ (around[1:-1] * np.uint32(0x85EBCA77)) ^ (
        around[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - CELL_BITS)


@dataclass
class Model:
    """Log probabilities of hashed letter trigrams and the scripts of every language."""
    languages: list[str]
    scores: np.ndarray  # cells x languages
    uses: np.ndarray  # scripts x languages


def held_out(doc_id: Column) -> Column:
    """Rows that no model is fitted on: the CRC-32 of the id as text is a multiple of 5. False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(languages: list[str]):
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, scripts = _tables()
        # Scripts follow the trigram cells. Counted text by text, so that no array has all cells of all languages.
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for at in range(0, len(text), SCORE_CHARS):
                    points = code_points(text[at: at + SCORE_CHARS])
                    low = letters[points]
                    is_letter = low > 0
                    own = np.bincount(_cells(low)[is_letter], minlength=1 << CELL_BITS)
                    own = np.r_[own, np.bincount(scripts[points[is_letter]], minlength=len(SCRIPTS) + 1)]
                    cell = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(cell), place[lang], dtype=np.int32)), pa.array(cell.astype(np.int32)),
                        pa.array(own[cell])], names=["lang", "cell", "n"])
    return count


def fit(documents: DataFrame, doc_id: str, text: str, lang: str, docs_per_language: int = DOCS_PER_LANGUAGE,
        max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn the languages of labelled documents that are not held out.

    At most ``docs_per_language`` documents per language, those with the smallest hash of the id, so the
    sample does not depend on the order of rows. Rows with a null id, text or language are not used. All
    languages are learned; more than ``max_languages`` raise a ValueError. The driver receives the counts only:
    at most languages x (cells + scripts) numbers.
    """
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")) \
        .where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()) \
        .where(~held_out(F.col("id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "digest")
    seen = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(seen) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn; none is left out, so clean the column "
                         "or allow more")
    languages = sorted(r["lang"] for r in seen)
    # Smallest hashes lie below this part of all hashes; it leaves ten standard deviations to spare, so that the
    # window gets few rows however large the table is.
    spare = docs_per_language + 10 * docs_per_language ** 0.5 + 100
    if not languages:
        return Model([], np.zeros((1 << CELL_BITS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    key = F.xxhash64("text").alias("digest")
    bounds = rows.sparkSession.createDataFrame(
        [(r["lang"], min(2 ** 63 - 1, int(-2 ** 63 + spare / r["count"] * 2 ** 64))) for r in seen],
        "lang string, bound bigint")
    low = rows.join(F.broadcast(bounds), "lang").where(F.xxhash64("id") <= F.col("bound"))
    picked = (low.select("lang", "id", key)
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_language)
              .select("lang", "id", "digest").distinct())
    sample = (rows.select("lang", "id", key, "text")
              .join(F.broadcast(picked), ["lang", "id", "digest"], "left_semi").select("lang", "text"))
    found = (sample.mapInArrow(_counts(languages), "lang int, cell int, n bigint")
             .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow())
    number, cell, n = (found[c].to_numpy() for c in ("lang", "cell", "n"))
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange(len(languages) + 1))
    scores = np.empty((1 << CELL_BITS, len(languages)), dtype=np.float32)
    uses = np.empty((len(SCRIPTS) + 1, len(languages)), dtype=bool)
    for i in range(len(languages)):
        own = order[edges[i]: edges[i + 1]]
        counts = np.zeros((1 << CELL_BITS) + len(SCRIPTS) + 1)
        counts[cell[own]] = n[own]
        grams, script = counts[: 1 << CELL_BITS], counts[1 << CELL_BITS:]
        scores[:, i] = np.log((grams + SMOOTHING) / (grams.sum() + SMOOTHING * (1 << CELL_BITS)))
        uses[:, i] = script >= SCRIPT_SHARE * max(script.sum(), 1)
    return Model(languages, scores, uses)


def _words(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all words (runs of letters of one script): text, begin, end, scores per language, evidence."""
    letters, scripts = _tables()
    sizes = np.array([len(x) + 1 for x in texts])
    points = code_points("\n".join([*texts, ""]))
    low = letters[points]
    script = np.where(low > 0, scripts[points], 255).astype(np.uint8)
    edge = np.flatnonzero(np.r_[True, script[1:] != script[:-1], True])
    begin, end = edge[:-1], edge[1:]
    is_word = low[begin] > 0
    begin, end = begin[is_word], end[is_word]
    many = len(model.languages)
    if not len(begin):
        return *(np.empty(0, dtype=np.int32),) * 3, np.empty((0, many), np.float32), np.empty(0, dtype=bool)
    at = np.flatnonzero(low > 0)
    place = np.cumsum(np.r_[0, end - begin])[:-1]
    scores = np.add.reduceat(model.scores[_cells(low)[at]], place, axis=0)
    uses = model.uses[script[begin]]
    evidence = uses.any(axis=1)
    scores[~evidence] = 0
    scores[evidence[:, None] & ~uses] = -1e6
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    text = (np.searchsorted(starts, begin, side="right") - 1).astype(np.int32)
    return text, (begin - starts[text]).astype(np.int32), (end - starts[text]).astype(np.int32), scores, evidence


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of every word. Words lie text by text, ``counts`` of them per text.

    All texts advance one word at a time side by side. Staying wins ties, else the first state.
    """
    order = np.argsort(-counts, kind="stable")
    begins = (np.cumsum(counts) - counts)[order]
    counts = counts[order]
    state_type = np.min_scalar_type(max(scores.shape[1] - 1, 0))
    states = np.arange(scores.shape[1], dtype=state_type)
    back = np.empty(scores.shape, dtype=state_type)
    path = np.empty(len(scores), dtype=state_type)
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more than t words
    value = np.zeros((len(counts), scores.shape[1]))
    for t in range(longest):
        n = active[t]
        at = begins[:n] + t
        v = value[:n]
        top = v.argmax(axis=1)
        jump = v[np.arange(n), top][:, None] - penalty
        stay = v >= jump
        back[at] = np.where(stay, states, top[:, None])
        value[:n] = np.where(stay, v, jump) + scores[at]
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return path


def _chars_at_once(limit: int, languages: int) -> int:
    return limit * LANGUAGES_AT_ONCE // max(languages, LANGUAGES_AT_ONCE)


def _label(model: Model, texts: list[str], penalty: float) -> list[dict]:
    blank = {"lang": UNKNOWN, "score": 0.0, "known": 0.0, "spans": []}
    results = [dict(blank) for _ in range(len(texts))]
    many = len(model.languages)
    if not many:
        return results
    parts, offset = [], 0
    for group in by_size(texts, _chars_at_once(SCORE_CHARS, many)):
        found = _words(model, group)
        parts.append((found[0] + offset, *found[1:]))
        offset += len(group)
    if not parts:
        return results
    text, begin, end, scores, evidence = (np.concatenate(x) for x in zip(*parts))
    path = viterbi(scores, np.bincount(text, minlength=len(texts)), penalty)
    letters = end - begin
    weight = np.bincount(text * many + path, weights=letters * evidence, minlength=len(texts) * many)
    weight = weight.reshape(-1, many)
    every = np.bincount(text, weights=letters, minlength=len(texts))
    anyhow = np.bincount(text * many + path, weights=letters, minlength=len(texts) * many).reshape(-1, many)
    best = np.where(weight.any(axis=1), weight.argmax(axis=1), anyhow.argmax(axis=1))
    run = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (path[1:] != path[:-1])]) if len(text) else []
    for i in np.flatnonzero(every > 0):
        results[i] = {"lang": model.languages[best[i]], "score": float(weight[i, best[i]] / every[i]),
                      "known": float(weight[i].sum() / every[i]), "spans": []}
    last = np.r_[run[1:], len(text)] - 1 if len(text) else []
    for first, to in zip(run, last):
        results[text[first]]["spans"].append({"start": int(begin[first]), "end": int(end[to]),
                                              "lang": model.languages[path[first]]})
    return results


def identify(spark: SparkSession, model: Model, text: Column, penalty: float = SWITCH_PENALTY) -> Column:
    """The language of every whole text as a struct of ``lang``, ``score``, ``known`` and ``spans``.

    Runs of letters of one script are words. The script narrows a word's languages to those that use it;
    hashed letter trigrams score the rest. A Viterbi path with a penalty for each switch labels the words;
    ``spans`` are its stretches of one language (character positions). ``lang`` has the most letters on
    the path; ``score`` is its share of all letters, from 0 to 1, where words of a script that no language
    uses count for none; ``known`` is the share of all languages together. Null texts, texts without a letter, and any text when nothing was learned are
    ``und`` with score and known 0.
    """
    handle = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            limit = _chars_at_once(PATH_CHARS, len(handle.value.languages))
            found = [x for group in by_size(texts, limit) for x in _label(handle.value, group, penalty)]
            yield pd.DataFrame({k: [x[k] for x in found] for k in ("lang", "score", "known", "spans")}, index=texts.index)
    # Else a filter on the result makes the planner run the function again below the filter.
    return label.asNondeterministic()(text)
