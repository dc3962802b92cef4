"""License scans. The query itself is compared with SQL in test_sql."""

from __future__ import annotations

import random

import pytest

from riskgrid.llm import licenses as L
from tests.llm.samples import no_documents, odd_documents, python_nodes

SCHEMA = "doc_id bigint, text string"


def scan(spark, texts, **options):
    out = L.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "doc_id", "text", **options)
    return {r["doc_id"]: r for r in out.collect()}


def test_places_and_labels(spark):
    got = scan(spark, ["Released under the MIT License. Also the mit-license!", "The Apache\nLicense and GENERAL public license",
                       "mit licenses; submit license", "MİT license mité license", "licensed under cc by nc 4 0", "nothing"])
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 3, 7, "mit")
    assert (got[1]["n_words"], got[1]["base_labels"], got[1]["labels"]) == (7, "apache,gpl", "apache,gpl")
    assert (got[1]["first_word"], got[1]["last_word"], got[1]["score"]) == (1, 4, 1.0)
    assert [got[i]["n_base"] for i in (2, 3, 4, 5)] == [0, 0, 0, 0]
    assert (got[4]["base_labels"], got[4]["labels"], got[4]["score"]) == ("", "cc-by-nc", 1.0)
    assert (got[5]["labels"], got[5]["score"], got[5]["first_word"]) == ("", 0.0, None)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_join_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = [chr(97 + i) * 2 for i in range(14)]
    templates = [(f"t{i}", " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(8)]
    texts = ["\n".join(" ".join(rng.choices(words + ["zz"], k=rng.randint(0, 10))) for _ in range(3)) for _ in range(120)]
    got = scan(spark, texts, templates=templates, threshold=threshold)
    for i, text in enumerate(texts):
        pairs = [(label, block, len(set(t.split()) & set(line.split())) / len(set(t.split())))
                 for block, line in enumerate(text.split("\n")) for label, t in templates]
        hits = [p for p in pairs if p[2] >= threshold - 1e-9]
        assert got[i]["labels"] == ",".join(sorted({p[0] for p in hits}))
        assert got[i]["score"] == pytest.approx(max([p[2] for p in hits], default=0))
        assert got[i]["n_blocks"] == len({p[1] for p in hits})


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\n"
           "purpose with or without fee is hereby granted, provided that",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n#\n# it under the terms of the\n"
           "# GNU General\n# Public License as published",
}


def test_wrapped_notices(spark):
    places = [f"{before}{notice}\nand more text" for notice in WRAPPED.values()
              for before in ("", "the first line\n\n", "word " * 50, "word\n" * 50)]
    got = scan(spark, places, wrapped=True)
    assert [got[i]["labels"] for i in range(len(places))] == [x for x in WRAPPED for _ in range(4)]
    assert {(r["score"], r["n_blocks"]) for r in got.values()} == {(1.0, 1)}
    # Two notices, one of them on one line; words of a notice that stand too far from each other.
    far = WRAPPED["bsd"].replace("with", "with" + " word" * 15)
    got = scan(spark, [WRAPPED["isc"] + "\n" + "word " * 9 + "\n" + WRAPPED["isc"].replace("\n", " "), far], wrapped=True)
    assert (got[0]["labels"], got[0]["n_blocks"]) == ("isc", 2)
    assert (got[1]["labels"], got[1]["score"], got[1]["n_blocks"]) == ("", 0.0, 0)


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_wrapped_equals_all_stretches(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = [chr(97 + i) * 2 for i in range(14)]
    templates = [(f"t{i}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(8)]
    texts = [rng.choice(["\n", "\n\n"]).join(" ".join(rng.choices(words + ["zz"], k=rng.randint(0, 5))) for _ in range(5))
             for _ in range(100)]
    got = scan(spark, texts, templates=templates, threshold=threshold, wrapped=True)
    for i, text in enumerate(texts):
        every = text.split()
        found = {}
        for label, t in templates:
            own, size = set(t.split()), len(t.split())
            blocks = [line.split() for line in text.split("\n")] + [every[at: at + size] for at in range(len(every))]
            found[label] = max(len(own & set(b)) / len(own) for b in blocks)
        hits = {label: c for label, c in found.items() if c >= threshold - 1e-9}
        assert got[i]["labels"] == ",".join(sorted(hits))
        assert got[i]["score"] == pytest.approx(max(hits.values(), default=0))
        assert (got[i]["n_blocks"] > 0) == bool(hits)


def test_odd_documents(spark):
    df = odd_documents(spark)
    out = L.scan(df, "doc_id", "text")
    rows = out.collect()
    assert len(rows) == df.count() and python_nodes(out) == []
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["n_words"] == by_id[3]["n_words"] == by_id[5]["n_words"] == 0
    assert [r["labels"] for r in rows if r["doc_id"] == 9].count("mit") == 1
    assert L.scan(no_documents(spark), "doc_id", "text").count() == 0
