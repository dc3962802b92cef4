"""Substring deduplication by content-defined chunking with a gear hash."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.llm.common import by_size, text_key
from riskgrid.sources.workdir import materialize

# A cut follows any byte where the top CUT_BITS of the gear hash are 0, but not within MIN_BYTES of the
# last cut; after MAX_BYTES without a cut one is set.
WINDOW = 16
CUT_BITS = 5
MIN_BYTES = 16
MAX_BYTES = 1024
# Cuts at minima of the hash: the smallest one in any stretch of so many bytes (a power of 2) is a place to cut.
REACH = 64
# Repeated stretches shorter than this are left alone.
MIN_SPAN = 64
TEXT_CHARS = 4_000_000
# Stands for a null id: rows without an id count as one document, before all others.
NO_ID = -(2 ** 63)


@lru_cache(maxsize=1)
def _gears() -> np.ndarray:
    """A random 16-bit number per byte, from digests; 0 for the zero byte, which stands between texts."""
    gears = np.array([int.from_bytes(blake2b(bytes([b]), digest_size=2).digest(), "little") for b in range(256)],
                     dtype=np.uint16)
    gears[0] = 0
    return gears


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At every byte the sum of the last 16 bytes' gears, each shifted left by its distance."""
    hashes = _gears()[data]
    width = 1
    while width < WINDOW:
        moved = np.zeros_like(hashes)
        moved[width:] = hashes[:-width] << np.uint16(width)
        hashes = hashes + moved
        width *= 2
    return hashes


def minima(hashes: np.ndarray) -> np.ndarray:
    """For every stretch of REACH hashes the place of its smallest one, of equal ones the last."""
    places = np.empty(max(0, len(hashes) - REACH + 1), dtype=np.int64)
    # Place and hash share 32 bits, so that one minimum gives both.
    step = (1 << 16) - REACH
    for at in range(0, len(places), step):
        part = hashes[at: at + step + REACH - 1]
        least = (part.astype(np.uint32) << np.uint32(16)) | np.arange(65535, 65535 - len(part), -1, dtype=np.uint32)
        width = 1
        while width < REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        places[at: at + len(least)] = 65535 - (least & np.uint32(65535)).astype(np.int64) + at
    return places


def cut(natural: list[int], size: int) -> list[int]:
    """The ends of the chunks of a text of ``size`` bytes, from the places where its hash asks for a cut."""
    ends, last = [], 0
    for at in [*natural, size]:
        while at - last > MAX_BYTES:
            last += MAX_BYTES
            ends.append(last)
        if at - last >= MIN_BYTES or (at == size and at > last):
            last = at
            ends.append(at)
    return ends


def _chunk_group(texts: list[str], at_minima: bool = False) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Per text: its place in the group, the chunks' ends, and their 16-byte digests."""
    raw = [x.encode() for x in texts]
    gap = bytes(WINDOW)
    hashes = gear_hashes(np.frombuffer(gap.join([*raw, b""]), dtype=np.uint8))
    cuts = minima(hashes) + 1 if at_minima else np.flatnonzero(hashes >> np.uint16(16 - CUT_BITS) == 0) + 1
    begin = 0
    for i, data in enumerate(raw):
        if at_minima:
            # Only stretches that lie wholly in the text; neighbours often have the same smallest hash.
            own = cuts[begin: begin + max(0, len(data) - REACH + 1)]
            own = own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own
        else:
            low, high = np.searchsorted(cuts, [begin + 1, begin + len(data)])
            own = cuts[low:high]
        ends = cut((own - begin).tolist(), len(data))
        yield i, ends, [blake2b(data[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends)]
        begin += len(data) + WINDOW


def _chunk_rows(batches: Iterator[pa.RecordBatch], at_minima: bool = False) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "place", "start", "end", "high", "low", "again"]
    for batch in batches:
        ids, keys, at = (batch.column(0).to_numpy(zero_copy_only=False),
                         batch.column(1).to_numpy(zero_copy_only=False), 0)
        for group in by_size(batch.column(2).to_pylist(), TEXT_CHARS):
            rows, sizes, ends, starts, digests, again = [], [], [], [], [], []
            for i, stops, own in _chunk_group(group, at_minima):
                seen: set[bytes] = set()
                for d in own:
                    again.append(d in seen)
                    seen.add(d)
                rows.append(at + i)
                sizes.append(len(stops))
                ends += stops
                starts += [0, *stops][: len(stops)]
                digests += own
            at += len(group)
            if digests:
                halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                place = np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[rows], sizes)), pa.array(np.repeat(keys[rows], sizes)),
                    pa.array(place.astype(np.int32)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                    pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(again)], names=names)


def chunks(documents: DataFrame, doc_id: str, text: str, at_minima: bool = False) -> DataFrame:
    """The chunks of every text: ``doc_id`` (NO_ID for null), ``text_key``, ``place``, ``start`` and ``end``
    in UTF-8 bytes, the digest as ``high`` and ``low``, and ``again`` if the text had the chunk before.

    Where a text is cut depends on the last 16 bytes only, so after an insertion the cuts fall into step
    again. With ``at_minima`` a cut follows the smallest hash of every stretch of REACH bytes instead, but not
    within MIN_BYTES of the last one: there is always one within reach, in a text of few distinct words too,
    and it depends on the bytes around it only. Null and empty texts have no chunks.
    """
    return documents.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
                            text_key(F.col(text)).alias("text_key"),
                            F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        partial(_chunk_rows, at_minima=at_minima), "doc_id bigint, text_key bigint, place int, start int, end int, high bigint, low bigint, "
                     "again boolean")


def repeated_spans(documents: DataFrame, doc_id: str, text: str, min_span: int = MIN_SPAN,
                   at_minima: bool = False) -> DataFrame:
    """Stretches of chunks that stand in the corpus more than once.

    Returns ``doc_id``, ``text_key``, ``start``, ``end`` (UTF-8 bytes), ``n_chunks``, ``first_doc_id``
    (id of the first document that has any chunk of it) and ``removed``: false where the document is the first that has
    these chunks, true for all later copies, in other documents or further down in the same one. Adjacent
    chunks with the same ``removed`` make one stretch; stretches under ``min_span`` bytes are left out.
    ``at_minima`` cuts the texts as in ``chunks``, so that short and repetitive passages are found too.

    Chunks are counted by digest with partial sums, so a chunk that very many texts share is one row per task.
    The first document is the one with the smallest id, null ids before others, and of several texts under one id the
    one with the smallest key; all other rows lose the chunk. Rows that repeat id and text give the same spans once.
    """
    rows = chunks(documents, doc_id, text, at_minima)
    # Written out, so that the join is between two plain shuffles and a chunk of very many texts can be split.
    known = materialize(rows.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("first"))
                        .where(F.col("n") > 1).select("high", "low", F.col("first.doc_id").alias("first_doc_id"),
                                                      F.col("first.text_key").alias("first_key")), "repeated")
    found = rows.join(known, ["high", "low"]).withColumn(
        "removed", (F.col("doc_id") != F.col("first_doc_id")) | (F.col("text_key") != F.col("first_key")) | F.col("again"))
    by_text = Window.partitionBy("doc_id", "text_key", "removed").orderBy("place")
    runs = (found.withColumn("run", F.col("place") - F.dense_rank().over(by_text))
            .groupBy("doc_id", "text_key", "removed", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"),
                 F.countDistinct("place").alias("n_chunks")))
    return runs.where(F.col("end") - F.col("start") >= min_span).select(
        _id("doc_id"), "text_key", "start", "end", F.col("n_chunks").cast("int").alias("n_chunks"),
        _id("first_doc_id"), "removed")


def _id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def without_repeats(documents: DataFrame, doc_id: str, text: str, keep: Sequence[str] = (),
                    min_span: int = MIN_SPAN, at_minima: bool = False) -> DataFrame:
    """``keep`` columns and ``kept_text``, the text without its removed stretches; null texts stay null.

    Bytes are cut, and a character that a cut divides is dropped with its stretch's edge.
    """
    gone = (repeated_spans(documents, doc_id, text, min_span, at_minima).where("removed")
            .groupBy("doc_id", "text_key")
            .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone")))
    rows = documents.select(F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"),
                            F.col(doc_id).cast("bigint").alias("own_id"), text_key(F.col(text)).alias("own_key"),
                            F.col(text).alias("own_text"))
    joined = rows.join(gone, rows["own_id"].eqNullSafe(gone["doc_id"]) & (rows["own_key"] == gone["text_key"]), "left")
    raw = F.encode("own_text", "UTF-8")
    pieces = F.aggregate(
        "gone", F.struct(F.lit(0).alias("at"), F.lit("").cast("binary").alias("text")),
        lambda s, g: F.struct(g["end"].alias("at"), F.concat(
            s["text"], F.substring(raw, s["at"] + 1, g["start"] - s["at"])).alias("text")),
        lambda s: F.concat(s["text"], F.substring(raw, s["at"] + 1, F.length(raw))))
    text_left = F.when(F.col("gone").isNull(), F.col("own_text")).otherwise(
        F.regexp_replace(F.decode(pieces, "UTF-8"), "�", ""))
    return joined.select(*(["kept.*"] if keep else []), text_left.alias("kept_text"))
