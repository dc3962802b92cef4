"""Content-defined chunks and repeated stretches."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pytest

from riskgrid.llm import chunks as C
from tests.llm.samples import no_documents, odd_documents


def plain_cuts(data: bytes) -> list[int]:
    """The definition, byte by byte."""
    gears, ends, last = C._gears().tolist(), [], 0
    for at in range(1, len(data) + 1):
        value = sum(gears[data[at - 1 - j]] << j for j in range(min(at, C.WINDOW))) & 0xFFFF
        natural = value >> (16 - C.CUT_BITS) == 0
        if (natural and at - last >= C.MIN_BYTES) or at - last == C.MAX_BYTES or (at == len(data) and at > last):
            ends.append(at)
            last = at
    return ends


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(words))


def texts(seed=1):
    rng = random.Random(seed)
    return [prose(rng, 200), "é" * 3000, "a", "", prose(rng, 3), "x" * 5000, prose(rng, 90) + "ß日本" * 40]


def test_chunks_follow_the_definition():
    every = texts()
    for i, ends, digests in C._chunk_group(every):
        data = every[i].encode()
        assert ends == plain_cuts(data)
        assert digests == [blake2b(data[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends)]
        assert all(b - a <= C.MAX_BYTES for a, b in zip([0, *ends], ends))


def test_cuts_fall_into_step_after_an_insertion():
    text = prose(random.Random(2), 800)
    (_, _, one), (_, _, two) = C._chunk_group([text, text[:500] + "inserted " + text[500:]])
    assert len(set(one) - set(two)) <= 4 < len(one) // 10


def plain_spans(rows, min_span=C.MIN_SPAN):
    """Stretches from a dictionary of digests."""
    held, count, first = [], defaultdict(int), {}
    for doc, text in rows:
        seen = set()
        ends = plain_cuts(text.encode())
        for place, (a, b) in enumerate(zip([0, *ends], ends)):
            piece = text.encode()[a:b]
            held.append((doc, text, place, a, b, piece, piece in seen))
            seen.add(piece)
            count[piece] += 1
            first[piece] = min(doc, first.get(piece, doc))
    runs, run = [], None
    for doc, text, place, a, b, piece, again in held:
        key = (doc, text, doc != first[piece] or again)
        if count[piece] < 2:
            run = None
        elif run and run[0] == key and run[1] == place - 1:
            run[1], run[3], run[4], run[5] = place, b, run[4] + 1, min(run[5], first[piece])
        else:
            run = [key, place, a, b, 1, first[piece]]
            runs.append(run)
    return {(r[0][0], r[2], r[3], r[4], r[5], r[0][2]) for r in runs if r[3] - r[2] >= min_span}


def test_spans_equal_plain_python(spark):
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (55, 70, 120)]
    rows = [(i, prose(rng, rng.randint(0, 80)) + " " + rng.choice(passages) + " " + prose(rng, 40)) for i in range(30)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(200, passages[0] + " " + prose(rng, 20) + " " + passages[0])]
    rows += [(300 + i, prose(rng, 100)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {tuple(r) for r in C.repeated_spans(df, "doc_id", "text").drop("text_key").collect()}
    assert got == plain_spans(rows)
    # Every copy of a passage of over 50 words is caught, documents of their own are left alone.
    assert {r[0] for r in got} == {i for i, _ in rows if i < 300}


def test_text_without_repeats(spark):
    rng = random.Random(9)
    passage, own = prose(rng, 80), [prose(rng, 60) for _ in range(3)]
    rows = [(1, own[0] + " " + passage), (2, own[1] + " " + passage + " " + own[2]), (3, own[0] + " " + passage), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"]: r["kept_text"] for r in C.without_repeats(df, "doc_id", "text", ["doc_id"]).collect()}
    assert kept[1] == rows[0][1] and kept[3] == "" and kept[4] is None
    assert len(kept[2]) < len(rows[1][1]) - 300 and kept[2].startswith(own[1]) and kept[2].endswith(own[2])


def test_copies_without_own_ids_are_removed(spark):
    """A passage in two rows without id, and in two rows with one id: the first of each pair owns it."""
    rng = random.Random(21)
    for doc_id in (None, 7):
        passage = prose(rng, 90)
        rows = [(doc_id, f"{prose(rng, 50)} {passage} {prose(rng, 50)}") for _ in range(3)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = C.repeated_spans(df, "doc_id", "text", at_minima=True).collect()
        assert len({r["text_key"] for r in got if r["removed"]}) == 2
        assert len({r["text_key"] for r in got if not r["removed"]}) == 1
        kept = [r["kept_text"] for r in C.without_repeats(df, "doc_id", "text", at_minima=True).collect()]
        assert sum(passage in x for x in kept) == 1


def plain_minima_cuts(data: bytes) -> list[int]:
    """The definition of cuts at minima, byte by byte."""
    hashes = C.gear_hashes(np.frombuffer(data, dtype=np.uint8)).tolist()
    wanted = {max(range(at, at + C.REACH), key=lambda i: (-hashes[i], i)) + 1
              for at in range(len(data) - C.REACH + 1)}
    ends, last = [], 0
    for at in range(1, len(data) + 1):
        if (at in wanted and at - last >= C.MIN_BYTES) or at == len(data):
            ends.append(at)
            last = at
    return ends


def test_cuts_at_minima_follow_the_definition():
    # The long text is cut in several steps.
    every = [*texts(), prose(random.Random(4), 13_000)]
    assert len(every[-1]) > 1 << 16
    for i, ends, digests in C._chunk_group(every, True):
        data = every[i].encode()
        assert ends == plain_minima_cuts(data)
        assert digests == [blake2b(data[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends)]
        assert all(b - a <= 2 * C.REACH + C.MIN_BYTES for a, b in zip([0, *ends], ends))


def longest_shared(one: str, two: str, at_minima: bool) -> int:
    """Bytes of the longest stretch of chunks of one text that the other has too."""
    (_, ends, own), (_, _, other) = C._chunk_group([one, two], at_minima)
    longest = run = 0
    for a, b, digest in zip([0, *ends], ends, own):
        run = run + b - a if digest in set(other) else 0
        longest = max(longest, run)
    return longest


def missed(at_minima: bool, distinct: int, passages: int = 300) -> int:
    """Passages of 51 words, of so many distinct ones, that two texts share and no span shows."""
    rng = random.Random(distinct)
    out = 0
    for _ in range(passages):
        words = prose(rng, distinct).split()
        passage = " ".join((words * 51)[:51])
        one, two = (f"{prose(rng, rng.randint(5, 60))} {passage} {prose(rng, 40)}" for _ in range(2))
        out += longest_shared(one, two, at_minima) < C.MIN_SPAN
    return out


@pytest.mark.parametrize("distinct", [3, 8, 51])
def test_passages_of_51_words(distinct):
    assert missed(True, distinct) == 0
    assert distinct == 51 or missed(False, distinct) > 0


def test_spans_of_repetitive_passages(spark):
    rng = random.Random(12)
    passages = [" ".join((prose(rng, n).split() * 51)[:51]) for n in (1, 2, 3, 5, 8, 51)]
    rows = [(10 * i + j, f"{prose(rng, 30 + j)} {p} {prose(rng, 40)}") for i, p in enumerate(passages) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = C.repeated_spans(df, "doc_id", "text", at_minima=True).collect()
    # Every later copy has a removed stretch, and it lies in the passage.
    assert {r["doc_id"] for r in got if r["doc_id"] != r["first_doc_id"]} == {i for i, _ in rows if i % 10}
    by_id = dict(rows)
    for r in got:
        piece = by_id[r["doc_id"]].encode()[r["start"]: r["end"]].decode()
        assert piece in passages[r["doc_id"] // 10]


def test_odd_documents(spark):
    df = odd_documents(spark)
    got = C.repeated_spans(df, "doc_id", "text", min_span=20).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 6}
    assert [r["removed"] for r in got if r["doc_id"] == 1] == [False]
    assert [r["removed"] for r in got if r["doc_id"] == 2] == [True]
    # The long text repeats within itself: one period stays.
    assert sum(r["end"] - r["start"] for r in got if r["doc_id"] == 6 and not r["removed"]) < 5000
    kept = C.without_repeats(df, "doc_id", "text", ["doc_id", "text"])
    assert kept.columns == ["doc_id", "text", "kept_text"] and kept.count() == df.count()
    assert C.repeated_spans(no_documents(spark), "doc_id", "text").count() == 0
    assert C.without_repeats(no_documents(spark), "doc_id", "text").count() == 0


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17])
def test_gear_hash_of_short_data(size):
    data = np.arange(1, size + 1, dtype=np.uint8)
    gears = C._gears()
    want = [sum(int(gears[data[i - j]]) << j for j in range(min(i + 1, 16))) & 0xFFFF for i in range(size)]
    assert C.gear_hashes(data).tolist() == want
