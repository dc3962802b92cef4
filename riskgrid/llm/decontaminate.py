"""Benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import by_size, code_points, spans
from riskgrid.sources.workdir import materialize

HITS = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"
GRAM = 8
EDIT_RATE = 0.08
# Benchmark characters that one broadcast index covers (about 16 bytes each). A larger benchmark is
# searched in several passes over the texts, one after the other, each with its own index.
BLOCK_CHARS = 4_000_000
# Text characters that are hashed at once, and alignment cells that are filled at once.
TEXT_CHARS = 1_000_000
CELLS = 400_000
# Shared q-grams (place in the text, place in an item) that are counted at once.
SHARED_AT_ONCE = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """Per code point: its lower case if that is one character, a space for white space, else itself."""
    folds = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x20000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        low = char.lower()
        folds[point] = 32 if char.isspace() else ord(low) if len(low) == 1 else point
    return folds


def folded(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters with white space as single spaces, and where each stood."""
    low = _folds()[points]
    blank = low == 32
    kept = np.flatnonzero(~(blank & np.r_[False, blank[:-1]]))
    return low[kept], kept


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from every place on, built by doubling."""
    if len(points) < q:
        return np.empty(0, dtype=np.uint64)
    total, done, block, width = None, 0, points.astype(np.uint64) + np.uint64(1), 1
    scale = int(_BASE)
    while True:
        if q & width:
            total = block if total is None else (
                total[: len(points) - done - width + 1] * np.uint64(pow(scale, width, 2 ** 64))
                + block[done: done + len(points) - done - width + 1])
            done += width
        width *= 2
        if width > q:
            return total
        half = width // 2
        block = block[:-half] * np.uint64(pow(scale, half, 2 ** 64)) + block[half:]


def gram_length(size: int, q: int, rate: float) -> int:
    """The longest grams, up to q characters, of which an item within its edit budget must share one at least.

    With e edits an item of n characters keeps n - q + 1 - e q of its grams, which is 1 or more for q up to n / (e + 1).
    """
    return min(q, size // (math.floor(size * rate) + 1))


@dataclass
class Index:
    """The q-grams of some benchmark items."""
    item_ids: list[int | None]
    items: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    q: int

    @staticmethod
    def classes(rows: list[tuple[int | None, str | None]], q: int, rate: float) -> "list[Index]":
        """One index for every gram length that the items need."""
        by_gram: dict[int, list[tuple[int | None, str | None]]] = {}
        for row in rows:
            size = len(folded(code_points((row[1] or "").strip()))[0])
            if size >= q:
                by_gram.setdefault(gram_length(size, q, rate), []).append(row)
        return [Index.build(own, gram, rate) for gram, own in sorted(by_gram.items(), reverse=True)]

    @staticmethod
    def build(rows: list[tuple[int | None, str | None]], q: int, rate: float) -> "Index":
        ids, items = [], []
        for item_id, text in rows:
            points = folded(code_points((text or "").strip()))[0]
            if len(points) >= q:
                ids.append(item_id)
                items.append(points)
        sizes = np.array([len(x) for x in items], dtype=np.int64)
        budgets = np.floor(sizes * rate).astype(np.int64)
        hashes = [gram_hashes(x, q) for x in items]
        every = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(items)), [len(x) for x in hashes]).astype(np.int64)
        place = spans(np.array([len(x) for x in hashes], dtype=np.int64))
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        # An item with e edits keeps at least this many of its q-grams (the q-gram lemma).
        needed = np.maximum(sizes - q + 1 - budgets * q, 1)
        return Index(ids, items, budgets, needed, grams, np.r_[first, len(every)], item[order], place[order], q)

    def filter_table(self) -> np.ndarray:
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[(self.grams * _BASE) >> np.uint64(64 - _FILTER_BITS)] = True
        return seen


def _candidates(index: Index, seen: np.ndarray, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Items and diagonal bands that share enough q-grams.

    Band b takes the diagonals from b * width on, ``width`` of them plus the largest edit budget, so the
    bands overlap and any alignment within the budget lies in one of them.
    """
    nothing = np.empty(0, dtype=np.int64)
    hashes = gram_hashes(points, index.q)
    at = np.flatnonzero(seen[(hashes * _BASE) >> np.uint64(64 - _FILTER_BITS)])
    gram = np.searchsorted(index.grams, hashes[at])
    same = index.grams[np.minimum(gram, len(index.grams) - 1)] == hashes[at]
    at, gram = at[same], gram[same]
    if not len(at):
        return nothing, nothing
    many = index.first[gram + 1] - index.first[gram]
    reach, budget = int(max(len(x) for x in index.items)), int(index.budgets.max())
    bands = int((len(points) + reach) // width) + 2
    slices = (np.cumsum(many) - many) // SHARED_AT_ONCE
    edges = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True])
    held, held_counts, full = nothing, nothing, [nothing]
    for first, end in zip(edges[:-1], edges[1:]):
        own, each = slice(first, end), many[first:end]
        entry = np.repeat(index.first[gram[own]], each) + spans(each)
        item = index.item[entry]
        diagonal = np.repeat(at[own], each) - index.place[entry] + reach
        band = diagonal // width
        low = (diagonal % width < budget) & (band > 0)
        keys, counts = np.unique(np.r_[item * bands + band, item[low] * bands + band[low] - 1], return_counts=True)
        held, place = np.unique(np.r_[held, keys], return_inverse=True)
        held_counts = np.bincount(place, weights=np.r_[held_counts, counts]).astype(np.int64)
        # A band gets no q-gram from beyond its last diagonal's end in the longest item: it is counted in full.
        done = np.full(len(held), True) if end == len(at) else (held % bands + 1) * width + budget <= at[end]
        full.append(held[done & (held_counts >= index.needed[held // bands])])
        held, held_counts = held[~done], held_counts[~done]
    keys = np.sort(np.concatenate(full))
    return keys // bands, (keys % bands) * width - reach


def _aligned(index: Index, items: np.ndarray, starts: np.ndarray, points: np.ndarray, lows: np.ndarray,
             highs: np.ndarray, width: int) -> np.ndarray:
    """Fewest edits and their text range for each item along the band that begins at its start.

    Cells hold edits * scale + (place of the range's start in the band), so the smallest cell is the
    alignment with the fewest edits that begins first. ``lows`` and ``highs`` bound each text.
    """
    budget = int(index.budgets.max())
    band = width + 3 * budget + 1
    starts = starts - budget
    scale = 1 << 12
    while scale <= band:
        scale *= 2
    sizes = np.array([len(index.items[i]) for i in items])
    longest = int(sizes.max())
    wanted = np.zeros((len(items), longest), dtype=np.uint32)
    for row, i in enumerate(items):
        wanted[row, : len(index.items[i])] = index.items[i]
    offsets = np.arange(band)
    cells = np.tile(offsets.astype(np.int64), (len(items), 1))
    final = np.empty_like(cells)
    steps = offsets * scale
    for i in range(longest):
        at = starts[:, None] + i + offsets
        inside = (at >= lows[:, None]) & (at < highs[:, None])
        char = np.where(inside, points[np.clip(at, 0, len(points) - 1)], np.uint32(0xFFFFFFFF))
        aligned = cells + (char != wanted[:, i, None]) * scale
        skipped = np.concatenate([cells[:, 1:], np.full((len(items), 1), 1 << 40)], axis=1) + scale
        cells = np.minimum(aligned, skipped)
        cells = np.minimum.accumulate(cells - steps, axis=1) + steps
        done = sizes == i + 1
        final[done] = cells[done]
    # Of equal alignments the one that ends first.
    end = final.argmin(axis=1)
    best = final[np.arange(len(items)), end]
    return np.stack([best // scale, np.clip(starts + best % scale, lows, highs),
                     np.clip(starts + sizes + end, lows, highs)], axis=1)


def _group_hits(index: Index, seen: np.ndarray, texts: list[str]) -> list[list[dict]]:
    """Per text: the retained regions that align within the budget, one per overlapping range."""
    width = 1 << max(4, int(index.budgets.max()).bit_length())
    parts = [folded(code_points(x)) for x in texts]
    sizes = np.array([len(p[0]) + 1 for p in parts])
    ends = np.cumsum(sizes) - 1
    begins = ends - sizes + 1
    # One character that no item has keeps q-grams within a text.
    points = np.concatenate([y for p in parts for y in (p[0], np.array([0x10FFFF], dtype=np.uint32))])
    items, starts = _candidates(index, seen, points, width)
    hits: list[list[dict]] = [[] for _ in texts]
    if not len(items):
        return hits
    # A band can meet the end of one text and the beginning of others: it is aligned with each.
    lengths = np.array([len(index.items[i]) for i in items])
    first = np.searchsorted(ends, np.maximum(starts, 0), side="left")
    last = np.minimum(np.searchsorted(ends, starts + width + 2 * int(index.budgets.max()) + lengths, side="left"),
                      len(texts) - 1)
    many = np.maximum(last - first + 1, 0)
    text = np.repeat(first, many) + spans(many)
    items, starts = np.repeat(items, many), np.repeat(starts, many)
    whole = sizes[text] - 1 + index.budgets[items] >= np.repeat(lengths, many)
    text, items, starts = text[whole], items[whole], starts[whole]
    found = []
    budget = int(index.budgets.max())
    band = width + 3 * budget + 1
    step = max(1, CELLS // band)
    lows, highs = begins[text], ends[text]
    # An alignment gives one range of its band: the band is aligned again left and right of it while there is room.
    while len(items):
        left = []
        for at in range(0, len(items), step):
            s = slice(at, at + step)
            got = _aligned(index, items[s], starts[s], points, lows[s], highs[s], width)
            good = got[:, 0] <= index.budgets[items[s]]
            t, i, start, low, high = (x[s][good] for x in (text, items, starts, lows, highs))
            edits, first, end = got[good].T
            found += list(zip(t, i, edits, first, end))
            size = np.array([len(index.items[x]) for x in i], dtype=np.int64)
            least = np.maximum(size - index.budgets[i], 1)
            before = first - np.maximum(low, start - budget) >= least
            after = np.minimum(high, start - budget + band + size) - end >= least
            left += [(t[before], i[before], start[before], low[before], first[before]),
                     (t[after], i[after], start[after], end[after], high[after])]
        text, items, starts, lows, highs = (np.concatenate(x) for x in zip(*left))
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, i, edits, start, end in sorted(found, key=lambda x: (x[0], x[1], x[2], x[3])):
        held = taken.setdefault((t, i), [])
        if all(end <= a or start >= b for a, b in held):
            held.append((start, end))
            where = parts[t][1]
            hits[t].append({"item_id": index.item_ids[i], "start": int(where[start - begins[t]]),
                            "end": int(where[end - 1 - begins[t]]) + 1 if end > start else
                            int(where[start - begins[t]]), "edits": int(edits)})
    return hits


def _search(handle) -> Column:
    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexes: list[tuple[Index, np.ndarray]] = [(x, x.filter_table()) for x in handle.value]
        for texts in batches:
            hits: list[list[dict]] = []
            for group in by_size(texts, TEXT_CHARS):
                found: list[list[dict]] = [[] for _ in group]
                for index, seen in indexes:
                    for own, more in zip(found, _group_hits(index, seen, group)):
                        own += more
                hits += found
            yield pd.Series(hits, index=texts.index, dtype=object)
    # Else a filter on the result makes the planner run the function again below the filter.
    return search.asNondeterministic()


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> list[DataFrame]:
    """The benchmark's ``id`` and ``item`` in parts of about BLOCK_CHARS characters, by hash; one part at least."""
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("item"))
    chars = rows.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    return [rows.where(F.pmod(F.xxhash64("id", "item"), F.lit(blocks)) == block) for block in range(blocks)]


def _broadcast(block: DataFrame, q: int, rate: float) -> Broadcast:
    """The indexes of one block on the executors, one for every gram length."""
    if not 0 <= rate < 1 / q:
        raise ValueError("the edit rate must be below 1 / q, else the q-gram lemma keeps every region")
    items = sorted((tuple(r) for r in block.collect()), key=lambda r: (
        r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    return block.sparkSession.sparkContext.broadcast(Index.classes(items, q, rate))


def leaks(benchmark: DataFrame, item_id: str, item_text: str, text: Column, q: int = GRAM,
          rate: float = EDIT_RATE) -> Column:
    """A column with the places of ``text`` that hold a benchmark item up to floor(rate * length) edits.

    Texts are compared in lower case with runs of white space as one space; ``start`` and ``end`` are
    character positions in the text as given. Shared q-grams are counted in overlapping diagonal bands;
    bands that reach the bound of the q-gram lemma are aligned with the item in the band, and alignments
    within the item's edit budget are returned, the best one of overlapping ranges.

    The column holds the index of the whole benchmark, so one of over BLOCK_CHARS characters is refused with a
    ValueError: ``contaminated`` and ``clean_documents`` take it block by block. Items for which the lemma asks for no
    shared q-gram are searched by shorter ones. Null and empty texts have no hits. Items that are null or shorter than
    q characters are not searched, as most texts hold such words by chance. Repeated items are all reported. An empty
    benchmark gives empty arrays.
    """
    blocks = _blocks(benchmark, item_id, item_text)
    if len(blocks) > 1:
        raise ValueError(f"the benchmark has over {BLOCK_CHARS} characters: use contaminated or clean_documents")
    return _search(_broadcast(blocks[0], q, rate))(text)


def contaminated(documents: DataFrame, text: str, keep: list[str], benchmark: DataFrame, item_id: str,
                 item_text: str) -> DataFrame:
    """One row per hit: ``keep`` columns, ``item_id``, ``start``, ``end``, ``edits``. See ``leaks``.

    A benchmark of any size: beyond BLOCK_CHARS characters it is searched in blocks, each a pass over the texts whose
    hits are written to the shared folder before the next block's index is built, so one is held at a time.
    """
    def hits(handle: Broadcast) -> DataFrame:
        return documents.select(F.struct(*keep).alias("kept"), F.explode(_search(handle)(F.col(text))).alias("hit"))

    blocks = _blocks(benchmark, item_id, item_text)
    if len(blocks) == 1:
        return hits(_broadcast(blocks[0], GRAM, EDIT_RATE)).select("kept.*", "hit.*")
    parts = []
    for block in blocks:
        handle = _broadcast(block, GRAM, EDIT_RATE)
        parts.append(materialize(hits(handle), "leaks"))
        handle.destroy()
    return reduce(DataFrame.unionAll, parts).select("kept.*", "hit.*")


def clean_documents(documents: DataFrame, text: str, benchmark: DataFrame, item_id: str,
                    item_text: str) -> DataFrame:
    """The documents without a hit, with all their columns. Null texts are clean.

    A benchmark of over BLOCK_CHARS characters is searched in blocks: the documents that one leaves are written to the
    shared folder, and the next one's index is built then.
    """
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    handle = None
    for block in _blocks(benchmark, item_id, item_text):
        if handle is not None:
            rows = materialize(rows, "clean")
            handle.destroy()
        handle = _broadcast(block, GRAM, EDIT_RATE)
        hits = _search(handle)(F.col("row").getField(text))
        rows = rows.select("row", F.size(hits).alias("hits")).where(F.col("hits") == 0).select("row")
    return rows.select("row.*")
