"""Ranked search against plain scoring; tables, bounds and blocks."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from riskgrid.llm import ranked
from tests.llm.samples import no_documents, odd_documents


def plain(docs, items, top):
    """Every document scored for every item."""
    counts = [(i, Counter(ranked.terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    held = Counter(t for _, c, _ in counts for t in c)
    n, total = len(counts), sum(k for _, _, k in counts)
    out = []
    for item, text in items:
        scored = []
        for doc, c, size in counts:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(ranked.terms_of(text)) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in ranked.search(d, "doc_id", "text", b, "item_id", "text", **options).collect()), key=str)


@pytest.mark.parametrize("splits", [1, 24])
@pytest.mark.parametrize("seed", range(3))
def test_plain_scores(spark, monkeypatch, seed, splits):
    monkeypatch.setattr(ranked, "SPLITS", splits)
    rng = random.Random(seed)
    words = ["a", "bb", "C", "ñandú", "dd1", "e", "f", "g", "h", "2", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(rng.choice([None, *range(120)]), " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 9, 60]))))
            for _ in range(300)]
    items = [(i % 4, " ,".join(rng.choices(words, k=4))) for i in range(6)] + [(None, "zz a"), (9, None), (10, "??")]
    assert found(spark, docs, items, top=7, block_postings=90) == plain(docs, items, 7)
    # Blocks of a few queries give the same.
    assert found(spark, docs, items, top=7, query_bytes=20) == plain(docs, items, 7)


def test_many_copies(spark):
    """A third of the rows share id and text, another third the text only."""
    docs = [(7, "x y z")] * 200 + [(i, "x y z") for i in range(500, 300, -1)] + [(i, f"x w{i}") for i in range(1000, 1200)]
    assert found(spark, docs, [(1, "x y"), (2, "w1005 z")], top=5, block_postings=64) == plain(docs, [(1, "x y"), (2, "w1005 z")], 5)


def test_terms():
    assert ranked.terms_of("Ab-c9_É×3\x7f x") == ["ab", "c9", "É×3", " x"]
    import pyarrow as pa
    texts = ["Ab ab", "", "c", None, "É-É ab", "x" * 10]
    vocabulary = pa.array(["ab", "c", "É"])
    counts, doc, term, tf = ranked._counted(pa.array([t or "" for t in texts]).slice(0), vocabulary)
    assert counts.tolist() == [2, 0, 1, 0, 3, 1]
    assert list(zip(doc.tolist(), term.tolist(), tf.tolist())) == [(0, 0, 2), (2, 1, 1), (4, 0, 1), (4, 2, 2)]


def test_range_maxima(spark):
    docs = [(i, "t " * (1 + i * 7 % 13) + "u " * (i % 3) + "v" * (i % 2)) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    row = ranked._index(df, "doc_id", "text", ["t", "u", "v"], 10 ** 6).collect()[0].asDict()
    lists = ranked.Lists(row, np.array([5, 9, 2]), 50, 700)
    rng = random.Random(1)
    for _ in range(300):
        k = rng.randrange(3)
        a = rng.randrange(lists.start[k], lists.end[k])
        b = rng.randrange(a + 1, lists.end[k] + 1)
        place = lists.best(np.array([a]), np.array([b]))[0]
        assert a <= place < b and lists.impact[place] == lists.impact[a:b].max()


def test_search_skips_documents(spark, monkeypatch):
    """Few documents are scored when some stand out."""
    docs = [(i, "common " + ("rare gem" if i % 500 == 3 else f"w{i % 40}")) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    row = ranked._index(df, "doc_id", "text", ["common", "gem", "rare"], 10 ** 6).collect()[0].asDict()
    lists = ranked.Lists(row, np.array([1, 5000, 5000]), 4000, 8016)
    best, scored = ranked.Best(1, 5), []
    add = best.add
    monkeypatch.setattr(best, "add", lambda q, s, i, n: (scored.append(len(q)), add(q, s, i, n)))
    ranked._search(lists, [np.array([0, 1, 2])], np.array([0]), best)
    assert best.id.tolist() == [3, 503, 1003, 1503, 2003] and sum(scored) < 400


def test_large_counts_and_long_texts(spark):
    docs = [(1, "ab " * 70_000), (2, "ab cd"), (3, "cd " * 300)]
    assert found(spark, docs, [(1, "ab cd")]) == plain(docs, [(1, "ab cd")], 50)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_documents(spark, make):
    df = make(spark)
    items = [(1, "alpha text"), (1, "alpha text"), (2, None), (None, "license epsilon"), (3, "")]
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(spark, df, items) == plain(docs, items, 50)
    assert found(spark, docs or df, items[2:3]) == []
