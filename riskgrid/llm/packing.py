"""Best-fit packing of tokenised documents into sequences of a fixed length, as a tree of residual bins."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from riskgrid.llm.common import spans
from riskgrid.llm.token_counts import _splits_at_words
from riskgrid.operators.sizes import lookup_join
from riskgrid.sources.workdir import materialize

CAPACITY = 2048
END_ID = 0
# Bytes of text that are encoded side by side.
SLICE_BYTES = 8_000_000
# Pieces that a worker remembers in each of two generations.
MEMO_ENTRIES = 400_000
# Items of a task that are packed together; a larger partition is several leaves of the tree.
LEAF_ITEMS = 500_000
# Children of a node of the tree.
FAN = 16
# A bin with at most this part of its capacity left is emitted.
NEARLY_FULL = 1 / 256
# A bin's number is its partition and run in the high bits, its place in the run in the low ones.
RUN_BITS, PLACE_BITS = 12, 22


# -- tokens ---------------------------------------------------------------------------------------

# Kinds of bytes: Latin letters, punctuation, apostrophe, digits, space, other white space; 0 is anything else.
LETTER, MARK, APOSTROPHE, DIGIT, SPACE, BLANK = range(1, 7)


def _kinds() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[0x21:0x7F] = MARK
    table[ord("'")] = APOSTROPHE
    table[ord("0"):ord("9") + 1] = DIGIT
    table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1] = LETTER
    table[0x09:0x0E] = BLANK
    table[0x20] = SPACE
    return table


def _always_apart() -> np.ndarray:
    """For kinds a, b: whether the word pattern of byte-level BPE never has a word going on from a to b.

    White space only begins a word or is one by itself; letters, digits and marks make separate words, but for the
    contractions, which begin with an apostrophe.
    """
    table = np.zeros((8, 8), dtype=bool)
    table[[LETTER, MARK, APOSTROPHE, DIGIT], SPACE] = table[[LETTER, MARK, APOSTROPHE, DIGIT], BLANK] = True
    table[LETTER, [MARK, APOSTROPHE, DIGIT]] = table[DIGIT, [LETTER, MARK, APOSTROPHE]] = True
    table[MARK, [LETTER, DIGIT]] = table[APOSTROPHE, DIGIT] = True
    return table.ravel()


KINDS, APART = _kinds(), _always_apart()


def word_starts(data: np.ndarray, starts: np.ndarray, special: Sequence[bytes]) -> np.ndarray:
    """Places where texts (beginning at ``starts``) can be cut so that their pieces' tokens are the texts' tokens."""
    kinds = KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    trail = data[lead + 1]
    lead = lead[(trail >= 0x80) & (trail != 0x97) & (trail != 0xB7)]
    kinds[lead] = kinds[lead + 1] = LETTER
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = APART[(kinds[:-1] << 3) | kinds[1:]]
    # One white space other than a space between two other characters is a word; of several only the last is.
    blank = np.flatnonzero(kinds == BLANK)
    blank = blank[(blank > 0) & (blank < len(data) - 1)]
    solid = np.array([0, 1, 1, 1, 1, 0, 0, 0], dtype=bool)
    after = blank[solid[kinds[blank - 1]] & solid[kinds[blank + 1]]] + 1
    cut[after] = True
    # A text that begins with white space has none before it.
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts] = True
    cut[after[first[after - 1]]] = False
    if special:
        whole = data.tobytes()
        for word in special:
            at = whole.find(word)
            while at >= 0:
                cut[at + 1:at + len(word)] = False
                at = whole.find(word, at + 1)
    cut[starts] = True
    return np.flatnonzero(cut)


def _text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a string array; null texts are empty."""
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[raw[0]:raw[-1]]
    return raw - raw[0], data


def _byte_letters() -> dict[str, int]:
    """How byte-level BPE writes a byte: visible Latin-1 characters as they are, the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Tokens and their ids, if the merges stand in the order of their ids, so that ids rank the merges."""
    model = spec["model"]
    vocabulary, pairs = model["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    made = [vocabulary["".join(x)] for x in pairs]
    if made != sorted(made) or len(set(made)) != len(made) or any(model.get(x) for x in ("dropout", "ignore_merges")):
        return None
    letters = _byte_letters()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in added}


_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_BETWEEN = "\n"


class Encoder:
    """Token ids of a string array. Every distinct piece between word starts is encoded once while it is remembered.

    Pieces are remembered in two generations: those that were not seen since the last change are forgotten. Words of
    Latin letters go through the merges of the same file all together; all other pieces through the library.
    """

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as source:
            spec = json.load(source)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", []) if t["content"]]
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = _splits_at_words(tokenizer_file)
        ranks = _ranks(spec) if self.by_word else None
        self.words = None if ranks is None else tiktoken.Encoding(
            "words", pat_str=r" ?\p{L}+|\n", mergeable_ranks=ranks, special_tokens={})
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        ids = np.asarray(self.words.encode_ordinary(_BETWEEN.join(words) + _BETWEEN), dtype="<u4")
        ends = (np.flatnonzero(ids == self.words.encode_ordinary(_BETWEEN)[0]) * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends)]

    def _remembered(self, pieces: list[str]) -> list[bytes]:
        new, old = self.new, self.old
        missing = [x for x in pieces if x not in new]
        if len(new) + len(missing) > MEMO_ENTRIES:
            self.old, self.new = old, new = new, {}
            missing = pieces
        found = {x: old[x] for x in missing if x in old}
        unknown = [x for x in missing if x not in found] if found else missing
        words = [x for x in unknown if _WORD.fullmatch(x)] if self.words else []
        if words:
            found.update(zip(words, self._encoded_words(words)))
            unknown = [x for x in unknown if x not in found]
        if unknown:
            found.update(zip(unknown, self._encoded(unknown)))
        if len(found) > MEMO_ENTRIES:
            return [found[x] for x in pieces]
        new.update(found)
        return [new[x] for x in pieces]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of every text."""
        offsets, data = _text_buffers(texts)
        starts = offsets[:-1][np.diff(offsets) > 0]
        if len(starts) == 0:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        cuts = word_starts(data, starts, self.special) if self.by_word else starts
        pieces = pa.StringArray.from_buffers(
            len(cuts), pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = self._remembered(distinct) if self.by_word else self._encoded(distinct)
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        which = coded.indices.to_numpy()
        own = sizes[which]
        ends = np.cumsum(own, dtype=np.int64)
        shift = (np.cumsum(sizes, dtype=np.int64) - sizes)[which] - (ends - own)
        ids = flat[np.repeat(shift, own) + np.arange(ends[-1])]
        before = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
        return ids, np.diff(before)


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def _slices(batch: pa.RecordBatch, text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes of text; a longer text makes up a slice of its own."""
    column = batch.column(text)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(raw, raw[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def encode_pieces(documents: DataFrame, text: str, keep: Sequence[str], tokenizer_file: str,
                  capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token ids of whole texts, each with the end id, cut into pieces of at most ``capacity`` ids.

    Only longer documents are cut: all pieces but the first have exactly ``capacity`` ids. Returns the ``keep``
    columns, ``piece`` from 0, ``start`` (ids of the document before it), ``length`` and ``ids`` (little-endian
    unsigned 32-bit numbers). Null and empty texts are the end id alone; repeated rows each have their pieces;
    an empty table gives none. Other columns take no part.
    """
    rows = documents.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    kept = rows.schema["kept"].dataType
    out = T.StructType([T.StructField("kept", kept), T.StructField("piece", T.IntegerType()),
                        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                        T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer_file)
        for whole in batches:
            for batch in _slices(whole, 1, SLICE_BYTES):
                ids, counts = encoder(batch.column(1))
                total = counts + 1
                stream = np.full(int(total.sum()), end_id, dtype="<u4")
                stream[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                pieces = -(-total // capacity)
                first = total - (pieces - 1) * capacity
                number = spans(pieces)
                owner = np.repeat(np.arange(len(total)), pieces)
                length = np.where(number == 0, first[owner], capacity)
                start = np.where(number == 0, 0, first[owner] + (number - 1) * capacity)
                edges = np.concatenate([[0], np.cumsum(length)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.Array.from_buffers(pa.binary(), len(length), [
                         None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(stream)])],
                    names=["kept", "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, out).select("kept.*", "piece", "start", "length", "ids")


# -- packing --------------------------------------------------------------------------------------

def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit by falling size: the bin and the offset of every item, and the fill of every bin.

    Bins lie on one stack for each number of free places; a bit mask of the stacks in use finds the tightest one.
    """
    bins = np.empty(len(sizes), dtype=np.int64)
    offsets = np.empty(len(sizes), dtype=np.int64)
    free_of: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        above = used >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                used ^= 1 << free
        else:
            free, b = capacity, len(free_of)
            free_of.append(capacity)
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        free_of[b] = left
        if left:
            if not stacks[left]:
                used |= 1 << left
            stacks[left].append(b)
    return bins, offsets, capacity - np.asarray(free_of, dtype=np.int64)


def _carried(fills: np.ndarray, capacity: int, nearly: int, fan: int) -> np.ndarray:
    """Which bins go up the tree: those that are not nearly full, at most ``fan`` of every fill over one half.

    After a best fit at most one bin is at most half full, so a merge of ``fan`` nodes has at most ``fan`` bins that
    can go into others, and no use for more receivers of one fill: what stays behind would not be used.
    """
    alive = np.flatnonzero(capacity - fills > nearly)
    rank = pd.Series(fills[alive]).groupby(fills[alive]).cumcount().to_numpy()
    return alive[(rank < fan) | (fills[alive] * 2 <= capacity)]


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, fan: int = FAN,
         leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """Put items into as few sequences of at most ``capacity`` as best fit finds: adds ``sequence_id``, ``offset``.

    Every task packs its own items by best fit (leaves of a tree) and emits the nearly full bins. Underfull bins are
    items of the next round: the bins of ``fan`` nodes are packed together, until one node is left. A task
    holds a leaf's items, or what ``fan`` nodes carry up: at most one bin up to half full and ``fan`` bins of every
    other fill from each. Offsets leave no gaps.

    All columns are kept, so give it narrow rows; names beginning with ``_pack`` are taken. Items longer than the
    capacity are refused. Null lengths and lengths under 1 are refused. Repeated rows are items of their own.
    """
    for name in ("sequence_id", "offset"):
        if name in items.columns:
            raise ValueError(f"the items have a column {name!r} already")
    nearly = int(capacity * NEARLY_FULL)
    schema = T.StructType([*items.schema.fields, T.StructField("_pack_bin", T.LongType()),
                           T.StructField("_pack_offset", T.LongType()), T.StructField("_pack_fill", T.LongType()),
                           T.StructField("_pack_up", T.BooleanType())])
    where = items.columns.index(length)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting, rows, runs = [], 0, 0

        def packed():
            table = pa.Table.from_batches(waiting).combine_chunks()
            lengths = table.column(where)
            if lengths.null_count:
                raise ValueError(f"null in {length!r}")
            sizes = lengths.to_numpy().astype(np.int64)
            if len(sizes) and (sizes.max() > capacity or sizes.min() < 1):
                raise ValueError(f"{length!r} must be from 1 to {capacity}")
            bins, offsets, fills = best_fit(sizes, capacity)
            up = np.zeros(len(fills), dtype=bool)
            up[_carried(fills, capacity, nearly, fan)] = True
            if runs >= 1 << RUN_BITS:
                raise ValueError("a partition has too many rows")
            number = (((part << RUN_BITS) | runs) << PLACE_BITS) + bins
            for name, column in (("_pack_bin", number), ("_pack_offset", offsets), ("_pack_fill", fills[bins]),
                                 ("_pack_up", up[bins])):
                table = table.append_column(name, pa.array(column))
            return table.to_batches(max_chunksize=50_000)

        for batch in batches:
            for at in range(0, batch.num_rows, leaf_items):
                piece = batch.slice(at, leaf_items)
                if rows and rows + piece.num_rows > leaf_items:
                    yield from packed()
                    waiting, rows, runs = [], 0, runs + 1
                waiting.append(piece)
                rows += piece.num_rows
        if rows:
            yield from packed()

    local = materialize(items.mapInArrow(leaves, schema), "leaves")
    # Underfull bins: one row each, told by the item at offset 0. A bin's members are the leaf bins laid into it.
    state = local.where("_pack_up AND _pack_offset = 0").select(
        F.col("_pack_bin").alias("bin"), F.col("_pack_fill").alias("fill"),
        F.shiftright("_pack_bin", RUN_BITS + PLACE_BITS).alias("node"),
        F.array(F.struct(F.col("_pack_bin").alias("bin"), F.lit(0).cast("bigint").alias("shift"))).alias("members"))
    kind = T.StructType([*state.schema.fields, T.StructField("up", T.BooleanType())])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", ignore_index=True)
        bins, offsets, fills = best_fit(group["fill"].to_numpy(), capacity)
        up = set(_carried(fills, capacity, nearly, fan).tolist())
        out = []
        for b, rows in pd.Series(range(len(bins))).groupby(bins).indices.items():
            rows = rows[np.argsort(offsets[rows])]
            members = [{"bin": m["bin"], "shift": m["shift"] + int(offsets[r])}
                       for r in rows for m in group["members"][r]]
            out.append((group["bin"][rows[0]], int(fills[b]), group["node"][0], members, b in up))
        return pd.DataFrame(out, columns=[f.name for f in kind])

    moved = []
    nodes = (state.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        state = state.withColumn("node", F.floor(F.col("node") / fan))
        merged = materialize(state.groupBy("node").applyInPandas(merge, kind), "merged")
        moved.append(merged.where(~F.col("up")).drop("up"))
        state = merged.where("up").drop("up")
        nodes = -(-nodes // fan)
        if nodes <= 1:
            break
    moved.append(state)
    mapping = moved[0]
    for part in moved[1:]:
        mapping = mapping.unionByName(part)
    mapping = mapping.where(F.size("members") > 1).select(
        F.col("bin").alias("_pack_root"), F.explode("members").alias("m")).select(
        F.col("m.bin").alias("_pack_bin"), "_pack_root", F.col("m.shift").alias("_pack_shift"))
    # One row for each bin that was merged with others: at most some for each task.
    joined = lookup_join(local, mapping, ["_pack_bin"])
    return joined.select(*items.columns, F.coalesce("_pack_root", "_pack_bin").alias("sequence_id"),
                         (F.col("_pack_offset") + F.coalesce("_pack_shift", F.lit(0))).alias("offset"))


def pack_documents(documents: DataFrame, text: str, keep: Sequence[str], tokenizer_file: str,
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of tokenised documents with their ids, ``sequence_id`` and ``offset``.

    The ids are written once; the packing sees their lengths only, and ids are joined to places by a row number.
    """
    pieces = encode_pieces(documents, text, keep, tokenizer_file, capacity, end_id)
    stored = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    placed = pack(stored.select("_row", "length"), "length", capacity).drop("length")
    return stored.join(placed, "_row").drop("_row")


def sequences(placed: DataFrame) -> DataFrame:
    """The ids of every sequence end to end: ``sequence_id, n_pieces, n_tokens, ids``. A group is at most as long
    as the capacity."""
    listed = placed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return listed.select("sequence_id", F.size("p").alias("n_pieces"), "n_tokens",
                         F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))
