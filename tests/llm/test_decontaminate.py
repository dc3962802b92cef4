"""Benchmark hits against plain dynamic programming."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.llm import decontaminate as D
from tests.llm.samples import LONG, no_documents, odd_documents

ITEMS = "item_id bigint, text string"


def fewest_edits(item: str, text: str) -> int:
    """Fewest edits from the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def fold(text: str) -> str:
    return "".join(map(chr, D.folded(D.code_points(text))[0]))


def mutate(text: str, edits: int, rng: random.Random) -> str:
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[at] = rng.choice("abcdefgh ")
        elif kind < 0.7:
            del chars[at]
        else:
            chars.insert(at, rng.choice("xyz"))
    return "".join(chars)


def test_hits_equal_alignment(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeio") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(14, 40))) for i in range(6)]
    docs = []
    for n in range(36):
        item = items[n % 6][1]
        budget = int(len(item) * D.EDIT_RATE)
        planted = mutate(item, rng.choice([0, 1, budget // 2, budget, budget + 3]), rng)
        before, after = prose(rng.choice([0, 1, 30])), prose(rng.choice([0, 1, 30]))
        docs.append((n, f"{before} {planted.upper() if n % 5 == 0 else planted.replace(' ', '  ', 3)} {after}"))
    docs += [(100 + i, prose(60)) for i in range(6)] + [(200, items[0][1] + " " + items[1][1] + items[0][1])]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2), "text", ["doc_id"],
                         spark.createDataFrame(items, ITEMS), "item_id", "text").collect()
    fewest = {(r["doc_id"], r["item_id"]): 10 ** 9 for r in got}
    for r in got:
        fewest[r["doc_id"], r["item_id"]] = min(fewest[r["doc_id"], r["item_id"]], r["edits"])
    want = {}
    for n, text in docs:
        for i, item in items:
            edits = fewest_edits(fold(item), fold(text))
            if edits <= int(len(fold(item)) * D.EDIT_RATE):
                want[n, i] = edits
    assert fewest == want
    texts = dict(docs)
    for r in got:
        part = fold(texts[r["doc_id"]][r["start"]: r["end"]])
        assert fewest_edits(dict(items)[r["item_id"]], part) == r["edits"]
    assert len([r for r in got if (r["doc_id"], r["item_id"]) == (200, 0)]) == 2


def test_all_passages_of_the_table_are_found(spark):
    """Every document that holds an item's text is a hit, no other document shares a long part of one."""
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {tuple(r) for r in D.contaminated(docs, "text", ["doc_id"], items, "item_id", "text")
           .select("doc_id", "item_id").collect()}
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
    assert want and got == want
    clean = D.clean_documents(docs, "text", items, "item_id", "text")
    assert clean.columns == docs.columns
    assert {r[0] for r in clean.select("doc_id").collect()} == (
        {r[0] for r in docs.select("doc_id").collect()} - {d for d, _ in want})


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    hits = lambda: sorted(tuple(r) for r in D.contaminated(
        docs, "text", ["doc_id"], items, "item_id", "text").collect())
    clean = lambda: sorted(r[0] for r in D.clean_documents(
        docs, "text", items, "item_id", "text").select("doc_id").collect())
    whole, left = hits(), clean()
    monkeypatch.setattr(D, "BLOCK_CHARS", 2000)
    assert hits() == whole and clean() == left


def test_one_block_is_searched_at_a_time(spark, monkeypatch):
    """Every pass has one Python node, and its index is gone before the next block's is built."""
    word = lambda rng, n: "".join(rng.choices("abcdefghij", k=n))
    rng = random.Random(31)
    items = [(i, word(rng, 13 + 20 * (i % 4))) for i in range(12)]
    docs = [(i, f"{word(rng, 20)} {items[i % 12][1]} {items[(i + 5) % 12][1]}") for i in range(24)]
    docs += [(100 + i, word(rng, 60)) for i in range(6)] + [(200, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("own"))
    benchmark = spark.createDataFrame(items, ITEMS)
    plans, live, most = [], set(), []
    write, send = D.materialize, D._broadcast

    def written(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, name)

    def sent(block, q, rate):
        handle = send(block, q, rate)
        live.add(id(handle))
        most.append(len(live))
        gone = handle.destroy

        def destroy():
            live.discard(id(handle))
            gone()
        handle.destroy = destroy
        return handle

    monkeypatch.setattr(D, "materialize", written)
    monkeypatch.setattr(D, "_broadcast", sent)
    monkeypatch.setattr(D, "BLOCK_CHARS", sum(len(x) for _, x in items) // 3)
    with pytest.raises(ValueError, match="use contaminated"):
        D.leaks(benchmark, "item_id", "text", F.col("text"))
    got = D.contaminated(df, "text", ["doc_id", "item_id"], benchmark, "item_id", "text").toDF(
        "doc_id", "own", "item_id", "start", "end", "edits")
    assert {(r[0], r[2]) for r in got.collect()} == {
        (i, k) for i in range(24) for k in (i % 12, (i + 5) % 12)}
    assert len(plans) == 3 and most == [1] * 3 and not live
    left = D.clean_documents(df, "text", benchmark, "item_id", "text")
    assert sorted(r[0] for r in left.collect()) == [*range(100, 106), 200] and left.columns == df.columns
    assert len(plans) == 5 and most == [1] * 6
    assert all(p.count("ArrowEvalPython") == 1 for p in plans)


def test_slices_of_shared_grams_give_the_same(monkeypatch):
    """Items and texts that repeat one phrase share very many q-grams; they are counted slice by slice."""
    phrase = "the same phrase again and "
    items = [(i, phrase * 6 + f"ending {i * 7919} of the item") for i in range(20)] + [(99, "x" * 60)]
    text = "some words before " + phrase * 40 + "ending 23757 of the item " + "y z " * 50 + "x" * 90 + phrase * 3
    index = D.Index.build(items, D.GRAM, D.EDIT_RATE)
    points = D.folded(D.code_points(text))[0]
    whole = D._candidates(index, index.filter_table(), points, 16)
    hits = D._group_hits(index, index.filter_table(), [text, "", text])
    assert len(whole[0]) and {3, 99} <= {h["item_id"] for h in hits[0]} and hits[0] == hits[2]
    for at_once in (1, 50, 1000):
        monkeypatch.setattr(D, "SHARED_AT_ONCE", at_once)
        part = D._candidates(index, index.filter_table(), points, 16)
        assert all(np.array_equal(a, b) for a, b in zip(whole, part))
        assert D._group_hits(index, index.filter_table(), [text, "", text]) == hits


@pytest.mark.parametrize("q", [1, 2, 5, 8, 12, 13])
def test_gram_hashes_tell_grams_apart(q):
    points = D.code_points("abracadabra abracadabra, cadabra")
    hashes = D.gram_hashes(points, q)
    grams = [bytes(points[i: i + q]) for i in range(len(points) - q + 1)]
    assert len(hashes) == len(grams)
    assert len(set(zip(hashes.tolist(), grams))) == len(set(grams)) == len(set(hashes.tolist()))


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (None, LONG[:200]), (2, ""), (3, "short"), (4, LONG[:200]),
                                   (5, "une phrase sans numéro et sans langue")], ITEMS)
    df = odd_documents(spark)
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, "text", ["doc_id"], items, "item_id", "text").collect()}
    assert got == {(6, None), (6, 4), (None, 5)}
    clean = D.clean_documents(df, "text", items, "item_id", "text")
    assert clean.columns == df.columns and clean.count() == df.count() - 2
    none = items.limit(0)
    assert D.clean_documents(df, "text", none, "item_id", "text").count() == df.count()
    assert D.contaminated(no_documents(spark), "text", ["doc_id"], items, "item_id", "text").count() == 0
    with pytest.raises(ValueError):
        D.leaks(items, "item_id", "text", F.col("text"), q=8, rate=0.125)


def test_null_texts_beside_items_of_the_same_id(spark):
    items = spark.createDataFrame([(1, None), (1, LONG[:200]), (None, None), (None, LONG[:200]), (None, None)], ITEMS)
    df = odd_documents(spark)
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, "text", ["doc_id"], items, "item_id", "text").collect()}
    assert got == {(6, None), (6, 1)}
    assert D.clean_documents(df, "text", items, "item_id", "text").count() == df.count() - 1


def test_repeats_beside_a_long_item():
    rng = random.Random(21)
    short, long = ("".join(rng.choices("abcdefghij klmnop", k=n)).replace(" ", "x") for n in (100, 5000))
    index = D.Index.build([(1, short), (2, long)], D.GRAM, D.EDIT_RATE)
    worse = short[:50] + "zz" + short[52:]
    text = f"begin {worse} and {short} and {worse} then {short} end"
    got = D._group_hits(index, index.filter_table(), ["other", text])
    wanted = [text.index(worse), text.index(short), text.rindex(worse), text.rindex(short)]
    assert got[0] == [] and {h["item_id"] for h in got[1]} == {1}
    assert sorted(h["start"] for h in got[1]) == wanted
    assert [h["edits"] for h in sorted(got[1], key=lambda h: h["start"])] == [2, 0, 2, 0]


def test_folding():
    points, kept = D.folded(D.code_points("A \t\nB\x00É"))
    assert "".join(map(chr, points)) == "a b\x00é" and kept.tolist() == [0, 1, 4, 5, 6]
    assert np.array_equal(D.folded(D.code_points(""))[0], [])


def test_short_items_of_every_length(spark):
    """Items of 1 to 40 characters with every placement of one edit of each kind that their budget allows."""
    rng = random.Random(3)
    items = [(n, "".join(rng.choice("abcdefghij") for _ in range(n))) for n in range(1, 41)]
    docs = []
    for n, item in items:
        variants = [item]
        if int(n * D.EDIT_RATE):
            variants += [item[:i] + "#" + item[i + 1:] for i in range(n)] + [item[:i] + item[i + 1:] for i in range(n)]
            variants += [item[:i] + "#" + item[i:] for i in range(1, n)]
        docs += [(n, f"{'z' * rng.randint(0, 9)} {v} {'y' * rng.randint(0, 9)}") for v in variants]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id bigint, n bigint, text string")
    got = D.contaminated(df, "text", ["doc_id", "n"], spark.createDataFrame(items, ITEMS), "item_id", "text").collect()
    found = {r["doc_id"] for r in got if r["item_id"] == r["n"]}
    assert found == {i for i, (n, _) in enumerate(docs) if n >= D.GRAM}
    for r in got:
        assert fewest_edits(dict(items)[r["item_id"]], docs[r["doc_id"]][1]) <= int(r["item_id"] * D.EDIT_RATE)
    assert [D.gram_length(n, 8, 0.08) for n in (8, 12, 13, 14, 15, 16, 25, 400)] == [8, 8, 6, 7, 7, 8, 8, 8]
