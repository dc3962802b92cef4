"""Ranked lexical search: best-first over document intervals, bounded by range maxima of the posting lists."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.llm.packing import _slices, _text_buffers
from riskgrid.sources.workdir import materialize

TOP = 50
# The constants of the score. Fixed values.
SCALE, BASE, SLOPE, FLAT, PER_CENT = 1_000_000_000, 1000, 20, 50, 50
# Query texts are searched in blocks of about so many bytes; a block is one pass over the documents.
QUERY_BYTES = 4_000_000
# Documents are indexed in blocks of so many postings, or documents.
BLOCK_POSTINGS, BLOCK_DOCS = 1_000_000, 60_000
SLICE_BYTES = 8_000_000
# Queries that are searched side by side, and the intervals of each that are split at a time.
SIDE_BY_SIDE, SPLITS = 64, 24
# Results of a query are merged in so many parts first.
PARTS = 64
NO_ID = np.iinfo(np.int64).max

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, with repeats."""
    return _TERM.findall((text or "").translate(_LOWER))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    inside = np.ones(256, dtype=bool)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        inside[low:high + 1] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    return inside, lower


INSIDE, LOWER = _byte_tables()


def _counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of every text in all, and (text, term, occurrences) of the terms that the vocabulary has."""
    offsets, data = _text_buffers(texts)
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(len(texts), dtype=np.int64), none, none, none
    inside = INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    begins[starts] = inside[starts]
    at = np.flatnonzero(begins)
    before = np.searchsorted(at, offsets)
    # Terms end to end without what stands between them.
    place = np.cumsum(inside, dtype=np.int32)
    edges = np.append(place[at] - 1, place[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(LOWER[data[inside]]))
    found = pc.index_in(words, value_set=vocabulary)
    hits = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    term = found.take(pa.array(hits)).to_numpy().astype(np.int64)
    text = np.searchsorted(before, hits, side="right") - 1
    keys, counts = np.unique(text * len(vocabulary) + term, return_counts=True)
    return np.diff(before), keys // max(len(vocabulary), 1), keys % max(len(vocabulary), 1), counts


BLOCKS = ("ids binary, has_id binary, lengths binary, terms binary, sizes binary, docs binary, tfs binary, "
          "large_at binary, large_tf binary, with_terms bigint, occurrences bigint")


def _index(documents: DataFrame, doc_id: str, text: str, vocabulary: Sequence[str], block_postings: int) -> DataFrame:
    """Posting lists of the vocabulary in blocks of documents, one row each; documents in the order of their ids.

    Documents without a term of the vocabulary are only counted.
    """
    rows = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = documents.sparkSession.sparkContext.broadcast(list(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(known.value, pa.string())
        ids, lengths, docs, terms, tfs = [], [], [], [], []
        n_docs = n_postings = with_terms = occurrences = 0

        def block() -> pa.RecordBatch:
            doc_ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
            order = np.argsort(doc_ids, kind="stable")
            doc_ids = doc_ids[order]
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            doc = rank[np.concatenate(docs)] if docs else np.zeros(0, dtype=np.int64)
            term = np.concatenate(terms) if terms else np.zeros(0, dtype=np.int64)
            tf = np.concatenate(tfs) if tfs else np.zeros(0, dtype=np.int64)
            by = np.argsort(term * max(len(order), 1) + doc, kind="stable")
            doc, term, tf = doc[by], term[by], tf[by]
            used, sizes = np.unique(term, return_counts=True)
            large = np.flatnonzero(tf > 255)
            own = np.concatenate(lengths)[order] if lengths else np.zeros(0, dtype=np.int64)
            cells = [doc_ids, doc_ids != NO_ID, own, used.astype(np.int32), sizes.astype(np.int32), doc.astype(np.uint16),
                     np.minimum(tf, 255).astype(np.uint8), large.astype(np.int32), tf[large]]
            return pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells]
                + [pa.array([with_terms], pa.int64()), pa.array([occurrences], pa.int64())],
                names=[c.split()[0] for c in BLOCKS.split(", ")])

        for whole in batches:
            for batch in _slices(whole, 1, SLICE_BYTES):
                own_ids = batch.column(0).fill_null(NO_ID).to_numpy()
                counts, doc, term, tf = _counted(batch.column(1), words)
                with_terms += int((counts > 0).sum())
                occurrences += int(counts.sum())
                some = np.unique(doc)
                # A slice is cut where a block is full.
                at = 0
                while at < len(some):
                    room = max(1, min(BLOCK_DOCS - n_docs, len(some) - at))
                    first = np.searchsorted(doc, some[at])
                    stop = int(np.searchsorted(some, doc[min(first + max(block_postings - n_postings, 1), len(doc)) - 1]))
                    take = some[at:min(at + room, max(stop, at + 1))]
                    last = np.searchsorted(doc, take[-1], side="right")
                    ids.append(own_ids[take])
                    lengths.append(counts[take])
                    docs.append(np.searchsorted(take, doc[first:last]) + n_docs)
                    terms.append(term[first:last])
                    tfs.append(tf[first:last])
                    n_docs += len(take)
                    n_postings += last - first
                    at += len(take)
                    if n_docs >= BLOCK_DOCS or n_postings >= block_postings or at < len(some):
                        yield block()
                        ids, lengths, docs, terms, tfs = [], [], [], [], []
                        n_docs = n_postings = with_terms = occurrences = 0
        if n_docs or with_terms:
            yield block()

    return rows.mapInArrow(run, BLOCKS)


def _statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, occurrences of terms, and the documents that hold each term of the vocabulary."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for used, sizes in zip(batch["terms"], batch["sizes"]):
                total[np.frombuffer(used, dtype=np.int32)] += np.frombuffer(sizes, dtype=np.int32)
        term = np.flatnonzero(total)
        yield pd.DataFrame({"term": term, "n": total[term]})

    sums = index.agg(F.sum("with_terms"), F.sum("occurrences")).first()
    held = np.zeros(n_terms, dtype=np.int64)
    counted = index.select("terms", "sizes").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n"))
    for term, n in counted.collect():  # at most a row for each term of the block of queries
        held[term] = n
    return sums[0] or 0, sums[1] or 0, held


class Lists:
    """The posting lists of a block end to end, with sparse tables of the place of the largest impact.

    Level j of a table gives, for place i, the place of the largest impact among i .. i + 2^j - 1; ranges never go
    over the end of a list.
    """

    def __init__(self, row, weights: np.ndarray, n_docs: int, n_occurrences: int):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.has_id = np.frombuffer(row["has_id"], dtype=bool)
        lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        terms = np.frombuffer(row["terms"], dtype=np.int32)
        sizes = np.frombuffer(row["sizes"], dtype=np.int32).astype(np.int64)
        docs = np.frombuffer(row["docs"], dtype=np.uint16).astype(np.int64)
        tf = np.frombuffer(row["tfs"], dtype=np.uint8).astype(np.int64)
        tf[np.frombuffer(row["large_at"], dtype=np.int32)] = np.frombuffer(row["large_tf"], dtype=np.int64)
        norm = 100 - FLAT + (PER_CENT * lengths * n_docs) // n_occurrences
        weight = weights[terms]
        self.impact = np.repeat(weight, sizes) * ((SCALE * tf) // (BASE * tf + SLOPE * norm[docs]))
        # Terms without weight add nothing and are left out.
        used = np.repeat(weight > 0, sizes)
        self.impact, docs = self.impact[used], docs[used]
        terms, sizes = terms[weight > 0], sizes[weight > 0]
        self.width = len(self.ids)
        self.docs = docs
        self.keys = np.repeat(np.arange(len(terms)), sizes) * self.width + docs
        ends = np.cumsum(sizes)
        self.start, self.end = ends - sizes, ends
        self.row_of = np.full(len(weights), -1, dtype=np.int64)
        self.row_of[terms] = np.arange(len(terms))
        levels = [np.arange(len(docs), dtype=np.int32)]
        step = 1
        while step * 2 <= (sizes.max() if len(sizes) else 0):
            low = levels[-1]
            high = np.append(low[step:], np.full(min(step, len(low)), len(docs) - 1, dtype=np.int32))
            levels.append(np.where(self.impact[low] >= self.impact[high], low, high))
            step *= 2
        self.levels = np.stack(levels)

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the largest impact in every range a .. b - 1 (not empty) of a list."""
        level = np.frexp((b - a).astype(float))[1] - 1
        x, y = self.levels[level, a], self.levels[level, b - (1 << level)]
        return np.where(self.impact[x] >= self.impact[y], x, y)


class Best:
    """The ``top`` best (score, id) of every query so far. Ids are compared when scores are equal."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.id = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)
        self.least = np.zeros(queries, dtype=np.int64)
        self.last_id = np.zeros(queries, dtype=np.int64)
        self.full = np.zeros(queries, dtype=bool)

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray, null: np.ndarray) -> None:
        keep = (score > 0) & self.promising(query, score, id)
        if not keep.any():
            return
        query = np.concatenate([self.query, query[keep]])
        score = np.concatenate([self.score, score[keep]])
        id = np.concatenate([self.id, id[keep]])
        null = np.concatenate([self.null, null[keep]])
        order = np.lexsort((id, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        order, query = order[rank < self.top], query[rank < self.top]
        rank = rank[rank < self.top]
        self.query, self.score, self.id, self.null = query, score[order], id[order], null[order]
        last = rank == self.top - 1
        self.full[query[last]] = True
        self.least[query[last]] = self.score[last]
        self.last_id[query[last]] = self.id[last]

    def promising(self, query: np.ndarray, bound: np.ndarray, id: np.ndarray) -> np.ndarray:
        """Whether scores up to a bound, of ids from ``id`` on, can still get among the best."""
        least = self.least[query]
        return ~self.full[query] | (bound > least) | ((bound == least) & (id < self.last_id[query]))


class Intervals:
    """Document intervals of queries: bound, first document, splitting document, and the ranges of their lists."""

    FIELDS = ("query", "bound", "low", "split", "size")

    def __init__(self, query, bound, low, split, size, row, a, b):
        self.query, self.bound, self.low, self.split, self.size = query, bound, low, split, size
        self.row, self.a, self.b = row, a, b

    @staticmethod
    def of(lists: Lists, query: np.ndarray, low: np.ndarray, owner: np.ndarray, row, a, b) -> Intervals:
        """Intervals with the given ranges (owner: which interval, ascending); those without postings go."""
        some = a < b
        owner, row, a, b = owner[some], row[some], a[some], b[some]
        kept, first, size = np.unique(owner, return_index=True, return_counts=True)
        if len(kept) == 0:
            none = np.zeros(0, dtype=np.int64)
            return Intervals(none, none, none, none, none, none, none, none)
        place = lists.best(a, b)
        value = lists.impact[place]
        bound = np.add.reduceat(value, first)
        # The document with the largest impact of all; of equal ones that of the first list.
        top = np.maximum.reduceat(value, first)
        is_top = np.flatnonzero(value == np.repeat(top, size))
        which = np.repeat(np.arange(len(kept)), size)[is_top]
        split = lists.docs[place[is_top[np.unique(which, return_index=True)[1]]]]
        return Intervals(query[kept], bound, low[kept], split, size, row, a, b)

    def where(self, mask: np.ndarray) -> Intervals:
        pairs = np.repeat(mask, self.size)
        return Intervals(*(getattr(self, f)[mask] for f in self.FIELDS), self.row[pairs], self.a[pairs], self.b[pairs])

    def plus(self, other: Intervals) -> Intervals:
        return Intervals(*(np.concatenate([getattr(self, f), getattr(other, f)])
                           for f in (*self.FIELDS, "row", "a", "b")))


def _search(lists: Lists, queries: list[np.ndarray], numbers: np.ndarray, best: Best) -> None:
    """Add a block's documents to the best of some queries (term numbers; ``numbers`` tells which they are).

    Each time the intervals with the highest bounds are split at their document of the largest impact: its score is
    exact, the rest are two new intervals. A bound is the sum of the largest impacts of the query's lists in the
    interval. It ends when no bound can get among the best.
    """
    rows = [lists.row_of[q] for q in queries]
    rows = [r[r >= 0] for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
    pool = Intervals.of(lists, numbers, np.zeros(len(rows), dtype=np.int64), owner, row, lists.start[row], lists.end[row])
    while True:
        pool = pool.where(best.promising(pool.query, pool.bound, lists.ids[pool.low]))
        if len(pool.query) == 0:
            return
        order = np.lexsort((pool.low, -pool.bound, pool.query))
        sorted_query = pool.query[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        chosen = np.zeros(len(order), dtype=bool)
        chosen[order[rank < SPLITS]] = True
        taken, pool = pool.where(chosen), pool.where(~chosen)
        n = len(taken.query)
        owner = np.repeat(np.arange(n), taken.size)
        wanted = taken.row * lists.width + np.repeat(taken.split, taken.size)
        place = np.searchsorted(lists.keys, wanted)
        inside = place < taken.b
        present = inside & (lists.keys[np.minimum(place, len(lists.keys) - 1)] == wanted)
        score = np.zeros(n, dtype=np.int64)
        np.add.at(score, owner[present], lists.impact[place[present]])
        best.add(taken.query, score, lists.ids[taken.split], ~lists.has_id[taken.split])
        # The document itself belongs to neither half.
        both = Intervals.of(
            lists, np.concatenate([taken.query, taken.query]), np.concatenate([taken.low, taken.split + 1]),
            np.concatenate([owner, owner + n]), np.concatenate([taken.row, taken.row]),
            np.concatenate([taken.a, place + present]), np.concatenate([place, taken.b]))
        pool = pool.plus(both)


def _found(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, occurrences: int,
           top: int) -> DataFrame:
    """The best of every task: ``query, doc_id, score``. What a task has found bounds its later blocks."""
    context = index.sparkSession.sparkContext
    shipped = context.broadcast((queries, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, weight = shipped.value
        best = Best(len(asked), top)
        for batch in batches:
            for _, row in batch.iterrows():
                if len(row["docs"]) == 0:
                    continue
                lists = Lists(row, weight, n_docs, occurrences)
                for at in range(0, len(asked), SIDE_BY_SIDE):
                    some = asked[at:at + SIDE_BY_SIDE]
                    _search(lists, some, np.arange(at, at + len(some)), best)
        yield pd.DataFrame({"query": best.query, "doc_id": pd.array(best.id, dtype="Int64").astype(object),
                            "score": best.score}).assign(doc_id=lambda x: x["doc_id"].mask(best.null, None))

    return index.mapInPandas(run, "query bigint, doc_id bigint, score bigint")


def _blocks(spark: SparkSession, texts: DataFrame, query_bytes: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Distinct query texts as (digest, distinct terms), a bounded block at a time."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // query_bytes))
    for number in range(n):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == number)
        yield [(r["digest"], sorted(set(terms_of(r["text"])))) for r in part.orderBy("digest").collect()]


def search(documents: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str,
           top: int = TOP, query_bytes: int = QUERY_BYTES, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The highest-scoring documents of every query: ``query_id, rank, doc_id, score``.

    Terms are maximal runs of ASCII letters, digits and all other than ASCII characters, A-Z lower-cased. A term in df
    of N documents that have terms weighs floor(1000 ln((2N + 2) / (2 df + 1))); with tf occurrences in a document of
    n terms it adds weight * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L, L all occurrences of terms.

    A pass over the texts writes the posting lists of the queries' terms, block by block of documents, and one over the
    blocks searches them; only counts of terms and the best of every task are shuffled. Queries beyond ``query_bytes``
    are searched in several passes, each with what it broadcasts (the distinct terms) within that bound.

    Results are ordered by score, then by id (nulls last); scores of 0 are left out. Null and empty texts have no term;
    repeated documents are results of their own; repeated queries and those with one id each have their results.
    Ids are 64-bit numbers below the largest one. Empty tables give an empty result; other columns take no part.
    """
    spark = documents.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.coalesce(F.col(query_text), F.lit("")).alias("text"),
                           F.md5(F.coalesce(F.col(query_text), F.lit("")).cast("binary")).alias("digest"))
    asked = asked.withColumn("row", F.monotonically_increasing_id())
    asked = materialize(asked, "queries")
    results = None
    for block in _blocks(spark, asked.select("digest", "text").dropDuplicates(["digest"]), query_bytes):
        vocabulary = sorted({t for _, terms in block for t in terms})
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        index = materialize(_index(documents, doc_id, text, vocabulary, block_postings), "postings")
        n_docs, occurrences, held = _statistics(index, len(vocabulary))
        if not occurrences:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in held], dtype=np.int64)
        terms = [np.array([number[t] for t in words], dtype=np.int64) for _, words in block]
        found = _found(index, terms, weights, n_docs, occurrences, top).withColumn(
            "part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        few = found.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(
            F.col("r") <= top)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(
            F.col("rank") <= top)
        names = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(block)], "query bigint, digest string")
        part = ranked.join(F.broadcast(names), "query").select("digest", "rank", "doc_id", "score")
        part = materialize(part, "ranked")
        results = part if results is None else results.unionByName(part)
    if results is None:
        results = spark.createDataFrame([], "digest string, rank int, doc_id bigint, score bigint")
    return asked.select("query_id", "digest").join(results, "digest").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
