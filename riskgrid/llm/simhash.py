"""Near-duplicates by SimHash fingerprints and anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import spans, text_key
from riskgrid.llm.components import components
from riskgrid.operators.sizes import lookup_join
from riskgrid.sources.workdir import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
# The binary Golay code: length 23, 12 information bits, covering radius 3, perfect. Fixed values.
CODE_LENGTH = 23
CODE_RADIUS = 3
CODE_POLYNOMIAL = 0xC75
# Shingles whose bits are counted at once; fingerprints that are replicated at once; members that look up
# their words at once; distances at once.
COUNT_AT_ONCE = 65_536
REPLICATE_AT_ONCE = 8_192
MEMBERS_AT_ONCE = 32_768
CELLS = 2_000_000
# Up to so many homes are compared with every member; more are looked up by their words in the second block.
FEW_HOMES = 32
# Fingerprints that call an anchor home in one slice; an anchor with more is dealt over slices.
SLICE = 524_288


def _fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), COUNT_AT_ONCE):
        s, e = starts[at: at + COUNT_AT_ONCE], ends[at: at + COUNT_AT_ONCE]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(s, e)), dtype=np.uint64, count=len(s))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    majority = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(majority.view(np.int64)[0])


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """The 64-bit SimHash of a text as a bigint.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``width`` words
    joined by spaces, repeats included; fewer words make one shingle, none (or null) gives 0. A bit is set
    where it is set in over half of the shingles' XXH64 hashes.
    """
    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_fingerprint(x, width) for x in texts], index=texts.index, dtype="int64")
    return of(text)


def fingerprint_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits of a block by the code's polynomial."""
    def remainder(values: np.ndarray) -> np.ndarray:
        values = values.copy()
        for bit in range(CODE_LENGTH - 1, 10, -1):
            values ^= np.where(values >> bit & 1, CODE_POLYNOMIAL << (bit - 11), 0)
        return values
    return remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)


def _syndrome(blocks: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[blocks & 0xFFF] ^ high[blocks >> 12]


@lru_cache(maxsize=4)
def _ways(threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every cost c = bits beyond the covering radius, up to the threshold: the flips that lead from a
    block with a given syndrome to a code word, and where each syndrome's flips begin."""
    every = np.arange(1 << CODE_LENGTH)
    weight = np.bitwise_count(every)
    flips, begins = [], []
    for cost in range(threshold + 1):
        own = every[weight <= CODE_RADIUS] if cost == 0 else every[weight == CODE_RADIUS + cost]
        syndrome = _syndrome(own)
        flips.append(own[np.argsort(syndrome, kind="stable")])
        begins.append(np.r_[0, np.cumsum(np.bincount(syndrome, minlength=1 << 11))])
    return flips, begins


def _block(bits: np.ndarray, number: int) -> np.ndarray:
    """The 23 bits of a fingerprint that make up a block."""
    return (bits >> np.uint64(number * CODE_LENGTH)).astype(np.int64) & ((1 << CODE_LENGTH) - 1)


def _words_near(blocks: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every code word within covering radius plus the row's budget: rows of ``blocks``, numbers of the words
    (their high 12 bits), and bits beyond the covering radius."""
    syndrome = _syndrome(blocks)
    flips, begins = _ways(int(budget.max(initial=0)))
    found: list[list[np.ndarray]] = [[], [], []]
    for cost, (own, begin) in enumerate(zip(flips, begins)):
        rows = np.flatnonzero(budget >= cost)
        s = syndrome[rows]
        many = begin[s + 1] - begin[s]
        word = np.repeat(blocks[rows], many) ^ own[np.repeat(begin[s], many) + spans(many)]
        for held, x in zip(found, (np.repeat(rows, many), word >> 11, np.full(len(word), cost))):
            held.append(x)
    return tuple(np.concatenate(x) for x in found)


def anchors_of(bits: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor that a fingerprint is sent to: rows of ``bits``, anchors, and whether it is home.

    Anchors are the code words of the first block. A fingerprint's home is the nearest one. Another that
    differs in at most ``threshold`` bits lies at most that much farther from that anchor than the covering
    radius, so it is sent there as well.
    """
    rows, anchors, spent = _words_near(_block(bits, 0), np.full(len(bits), threshold))
    return rows, anchors, spent == 0


def _packed(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of fingerprints, given by their ends, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [
        None, pa.py_buffer(np.r_[0, ends * 8].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _replicate(threshold: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), REPLICATE_AT_ONCE):
                own = every[at: at + REPLICATE_AT_ONCE]
                rows, anchors, home = anchors_of(own.view(np.uint64), threshold)
                order = np.argsort(anchors, kind="stable")
                anchors, rows, home = anchors[order], own[rows[order]], home[order]
                ends = np.flatnonzero(np.r_[anchors[1:] != anchors[:-1], True]) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors[ends - 1]), _packed(rows[home], np.cumsum(home)[ends - 1]), _packed(rows, ends),
                ], names=["anchor", "homes", "members"])
    return deal


class _Homes:
    """The home fingerprints of an anchor in the order of their home words in the second block.

    ``label`` holds for each the smallest place of a home it is connected to, so far.
    """

    def __init__(self, anchor: int, homes: np.ndarray):
        # The high 12 bits of a code word fix its low 11.
        self.anchor = anchor << 11 | int(_syndrome(np.array([anchor << 11]))[0])
        words = _words_near(_block(homes.view(np.uint64), 1), np.zeros(len(homes), dtype=np.int64))[1]
        self.homes = homes[np.argsort(words, kind="stable")]
        self.begins = np.r_[0, np.cumsum(np.bincount(words, minlength=1 << 12))]
        self.label = np.arange(len(homes))

    def _compared(self, members: np.ndarray, m: np.ndarray, begin: np.ndarray, many: np.ndarray,
                  threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members (falling into runs) and places of homes within the threshold, from ranges of homes."""
        slices = (np.cumsum(many) - many) // CELLS
        edges = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True]) if len(many) else [0]
        for first, end in zip(edges[:-1], edges[1:]):
            own = many[first:end]
            row, home = np.repeat(m[first:end], own), np.repeat(begin[first:end], own) + spans(own)
            near = np.bitwise_count((members[row] ^ self.homes[home]).view(np.uint64)) <= threshold
            yield row[near], home[near]

    def near(self, members: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of members, ascending, and of homes that differ in at most ``threshold`` bits."""
        if len(self.homes) <= FEW_HOMES:
            step = max(1, CELLS // len(self.homes))
            for at in range(0, len(members), step):
                part = members[at: at + step]
                m, h = np.nonzero(np.bitwise_count((part[:, None] ^ self.homes).view(np.uint64)) <= threshold)
                yield m + at, h
            return
        for at in range(0, len(members), MEMBERS_AT_ONCE):
            bits = members[at: at + MEMBERS_AT_ONCE].view(np.uint64)
            # What a member has spent in the first block is not left for the second one.
            spent = np.bitwise_count(_block(bits, 0) ^ self.anchor).astype(np.int64) - CODE_RADIUS
            m, word, _ = _words_near(_block(bits, 1), threshold - np.maximum(spent, 0))
            many = self.begins[word + 1] - self.begins[word]
            some = np.flatnonzero(many)
            some = some[np.argsort(m[some], kind="stable")]
            yield from self._compared(members, m[some] + at, self.begins[word[some]], many[some], threshold)

    def links(self, members: np.ndarray, threshold: int) -> list[np.ndarray]:
        """Links that connect what the pairs within the threshold connect: at most one per fingerprint."""
        out = []
        homes, label = self.homes, self.label
        for m, h in self.near(members, threshold):
            if not len(m):
                continue
            first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
            count = np.diff(np.r_[first, len(m)])
            before = label.copy()
            while True:
                least = np.minimum.reduceat(label[h], first)
                lower = label.copy()
                np.minimum.at(lower, h, np.repeat(least, count))
                np.minimum.at(lower, label, lower)
                lower = lower[lower]
                if (lower == label).all():
                    break
                label[:] = lower
            moved = np.flatnonzero(label != before)
            out.append(np.stack([homes[moved], homes[label[moved]]], axis=1))
            linked = members[m[first]]
            to = homes[label[h[first]]]
            other = linked != to
            out.append(np.stack([linked[other], to[other]], axis=1))
        return out


def _compare(threshold: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, homes = None, [], None
        for batch in batches:
            out: list[np.ndarray] = []
            waiting: list[np.ndarray] = []

            def flush() -> None:
                if waiting and homes is not None:
                    out.extend(homes.links(np.concatenate(waiting), threshold))
                waiting.clear()

            for anchor, part, kind, load in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, part) != key:
                    flush()
                    key, gathered, homes = (anchor, part), [], None
                if kind == 0:
                    gathered.append(np.frombuffer(load, dtype=np.int64))
                    continue
                if gathered:
                    homes, gathered = _Homes(anchor, np.concatenate(gathered)), []
                waiting.append(np.frombuffer(load, dtype=np.int64))
            flush()
            if out:
                links = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])
    return compare


def anchor_links(fingerprints: DataFrame, threshold: int = MAX_BITS) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of distinct fingerprints (column
    ``bits``) that differ in at most ``threshold`` bits.

    Every fingerprint is sent to all anchors within covering radius plus threshold, packed into one row per
    anchor and batch. The anchors are the 4,096 words of the code in the first block of 23 bits; with
    threshold 4 that is 191 copies. Within an anchor the second block is covered the same way, without another
    shuffle: home fingerprints lie at their home word, and a member looks at the words within covering radius plus
    what the first block has left of the threshold, 6.5 on average. So a member is compared with about one in 630
    of the anchor's homes: on one core 0.6 microseconds a member with 3,662 homes an anchor (15 million distinct
    fingerprints), where all comparisons took 31. Links that keep the same components are passed on, at most one
    per fingerprint and batch.

    Members are streamed past the homes. An anchor that is home to very many fingerprints is dealt over slices
    of its homes, and every slice sees all members, so memory is bounded and nothing is dropped.
    """
    if not 0 <= threshold <= CODE_LENGTH - CODE_RADIUS:
        raise ValueError("threshold must be 0 to 20")
    dealt = materialize(fingerprints.select("bits").mapInArrow(
        _replicate(threshold), "anchor bigint, homes binary, members binary"), "anchors")
    hot = (dealt.groupBy("anchor").agg(F.sum(F.octet_length("homes") / 8).alias("n"))
           .where(F.col("n") > SLICE).select("anchor", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")))
    rows = dealt.withColumn("slices", F.lit(1)) if hot.isEmpty() else lookup_join(
        dealt, hot, ["anchor"]).fillna(1, ["slices"])
    homes = rows.where(F.octet_length("homes") > 0).select(
        "anchor", F.pmod(F.xxhash64("homes"), F.col("slices")).cast("int").alias("slice"),
        F.lit(0).alias("kind"), F.col("homes").alias("load"))
    members = rows.select("anchor", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                          F.lit(1).alias("kind"), F.col("members").alias("load"))
    return (homes.unionByName(members).repartition("anchor", "slice")
            .sortWithinPartitions("anchor", "slice", "kind")
            .mapInArrow(_compare(threshold), "a bigint, b bigint"))


def near_duplicates(documents: DataFrame, doc_id: str, text: str, width: int = SHINGLE,
                    threshold: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``text_key``, ``bits``, ``root`` (smallest fingerprint reachable) and ``component_id``
    (smallest id reachable) for every row.

    Only distinct fingerprints are compared, so exact copies cost one aggregation. Null and empty texts have
    fingerprint 0 and are linked like others. Ids that repeat are kept row by row. A null id takes no part in
    the minimum; a component with null ids only has a null id. Other columns take no part.
    """
    rows = materialize(documents.select(
        F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"),
        fingerprint(F.col(text), width).alias("bits")), "fingerprints")
    distinct = materialize(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(anchor_links(distinct, threshold))
    rooted = distinct.join(roots, distinct["bits"] == roots["node"], "left").select(
        "bits", "first_id", F.coalesce("root", "bits").alias("root"))
    linked = roots.join(distinct, roots["node"] == distinct["bits"]).groupBy("root").agg(
        F.min("first_id").alias("least_id"))
    # Written out, so that the join is between two plain shuffles and a fingerprint of very many rows can be split.
    ids = materialize(rooted.join(linked, "root", "left").select(
        "bits", "root", F.coalesce("least_id", "first_id").alias("component_id")), "ids")
    return rows.join(ids, "bits").select("doc_id", "text_key", "bits", "root", "component_id")


def one_per_group(documents: DataFrame, doc_id: str, text: str, width: int = SHINGLE,
                  threshold: int = MAX_BITS) -> DataFrame:
    """The documents with all their columns, one per component: its smallest id, then smallest text key.

    Of rows that repeat id and text one is kept. A component with null ids only keeps one of its rows.
    """
    rows = near_duplicates(documents, doc_id, text, width, threshold)
    keys = ["kept_missing", "kept_id", "kept_key"]

    def keyed(missing: Column, own: Column, key: Column) -> list[Column]:
        return [missing.alias(keys[0]), F.coalesce(own.cast("string"), F.lit("")).alias(keys[1]), key.alias(keys[2])]

    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key"))
    kept = rows.groupBy("root").agg(least.alias("first")).select(
        *keyed(F.col("first.missing"), F.col("first.doc_id"), F.col("first.text_key")))
    whole = documents.select(F.struct(*documents.columns).alias("row"), *keyed(
        F.col(doc_id).isNull(), F.col(doc_id), text_key(F.col(text))))
    # Plain keys without nulls: repeated rows are dropped in the partitions of the join, so texts are shuffled once.
    return whole.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")
