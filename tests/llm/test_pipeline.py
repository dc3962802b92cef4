"""Every stage of the pipeline against plain Python on its own input."""

from __future__ import annotations

import corpus_pipeline as P
from riskgrid.sources.workdir import materialize
from tests.llm.samples import no_documents, odd_documents
from tests.llm.test_simhash import plain, plain_roots, signed

FOLDER = "/root/testdata/sf0.001"


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    sizes = []
    for number, (name, stage) in enumerate(P.STAGES):
        before = docs.toPandas()
        docs = materialize(stage(spark, docs, FOLDER), name)
        after = docs.toPandas()
        sizes.append(len(after))
        if name == "language_id":
            assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text) if any(c.isalpha() for c in t)}
        elif name == "simhash_dedup":
            prints = {i: signed(plain(t)) for i, t in zip(before.doc_id, before.text)}
            root = plain_roots(prints.values(), 4)
            least: dict = {}
            for i, f in prints.items():
                least[root[f]] = min(i, least.get(root[f], i))
            assert sorted(after.doc_id) == sorted(least.values())
        elif name == "decontaminate":
            assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text) if not any(x in t for x in items)}
        elif name == "mix":
            assert set(after.doc_id) <= set(before.doc_id) and len(after) > len(before) / 3
        if number < len(P.STAGES) - 1:
            assert docs.columns == names
            kept = before.set_index("doc_id").loc[after.doc_id]
            assert (kept.text.values == after.text.values).all()
        else:
            assert sorted(after.doc_id) == sorted(before.doc_id) and {"shard", "slot"} <= set(after.columns)
    assert [r[0] for r in P.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "mix", "shards"]
    assert P.run(spark, FOLDER).count() == sizes[-1]


def test_stages_on_odd_documents(spark):
    for make in (odd_documents, no_documents):
        for name, stage in P.STAGES:
            docs = make(spark)
            out = stage(spark, docs, FOLDER)
            assert name == "shards" or out.columns == docs.columns
            assert out.count() <= docs.count()
    kept = ids(P.identify_language(spark, odd_documents(spark), FOLDER))
    # Nulls, blank texts and texts without letters go; a null language is filled in.
    assert kept == [(False, 1), (False, 1), (False, 2), (False, 6), (False, 7), (False, 9), (False, 9), (True, 0)]
    filled = P.identify_language(spark, odd_documents(spark), FOLDER).where("doc_id IS NULL").first()
    assert filled["lang"] is not None


def test_texts_of_many_known_languages_stay(spark):
    words = {"el": "αβγδεζηθ", "ru": "абвгдежз", "hy": "աբգդեզէը", "he": "אבגדהוזח", "ar": "ابتثجحخد", "hi": "कखगघचछजझ",
             "th": "กขคงจฉชซ", "ka": "აბგდევზთ"}
    rows = [(10 * i + j, " ".join([w] * 20), n) for i, (n, w) in enumerate(words.items()) for j in range(8)]
    rows += [(1001, " ".join(" ".join([w] * 5) for w in words.values()), "ru"), (1002, "가나다라마바사아 " * 20 + "абвгдежз", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in P.identify_language(spark, df, FOLDER).collect()}
    assert kept == {r[0] for r in rows} - {1002}
