"""Held-out accuracy, spans and paths."""

from __future__ import annotations

from itertools import product
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.llm import language as L
from riskgrid.llm.queries import op6_language_spans
from tests.llm.samples import no_documents, odd_documents


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = op6_language_spans(spark, folder).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assert all(h == (crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == docs.lang[held.index]).mean() > 0.97
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("states", [1, 2, 3])
def test_viterbi_finds_the_best_path(states):
    random = np.random.default_rng(states)
    counts = np.array([3, 0, 6, 1, 4])
    scores = random.normal(0, 3, (counts.sum(), states)).astype(np.float32)
    path = L.viterbi(scores, counts, 1.5)
    at = 0
    for n in counts:
        def worth(p, s=scores[at: at + n]):
            return sum(float(s[i, x]) for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert worth(path[at: at + n].tolist()) == pytest.approx(max(worth(p) for p in product(range(states), repeat=int(n))))
        at += n
    assert len(L.viterbi(np.empty((0, 2), np.float32), np.array([0, 0]), 1.0)) == 0


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    russian = [(10_000 + i, "Привет мир это русский текст о погоде и людях " * 3, "ru") for i in range(60)]
    return L.fit(docs.union(spark.createDataFrame(russian, docs.schema)), "doc_id", "text", "lang")


def found(spark, model, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r[0] for r in df.select(L.identify(spark, model, F.col("t")), "i").orderBy("i").collect()]


def test_spans_of_mixed_text(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    parts = {lang: next(t for t in docs[docs.lang == lang].text if 600 < len(t) < 3000 and "|" not in t and "!!" not in t)
             .replace("\n", " ")[:600] for lang in ("en", "fr", "de")}
    text = parts["en"] + " " + parts["fr"] + " " + "Привет мир это текст о погоде" + " " + parts["de"] * 2
    got = found(spark, model, [text])[0]
    assert [s["lang"] for s in got["spans"]] == ["en", "fr", "ru", "de"]
    assert got["lang"] == "de" and 0.4 < got["score"] < 0.55
    for s, start in zip(got["spans"], (0, 601, 1202, 1232)):
        assert abs(s["start"] - start) < 60
    assert text[got["spans"][2]["start"]: got["spans"][2]["end"]] == "Привет мир это текст о погоде"


def test_script_narrows_the_languages(spark, model):
    # No Latin language uses these letters, and no learned language the Greek ones.
    cyrillic, greek, mixed = found(spark, model, ["йцукен щшзх", "αβγ δεζ", "αβγδεζ the and of with the"])
    assert cyrillic["lang"] == "ru" and cyrillic["score"] == 1
    assert greek["lang"] in model.languages and greek["score"] == 0
    assert mixed["lang"] == "en" and 0.5 < mixed["score"] < 1


def test_result_does_not_depend_on_batches(spark, model, monkeypatch):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().text.tolist()
    whole = L._label(model, texts, L.SWITCH_PENALTY)
    monkeypatch.setattr(L, "SCORE_CHARS", 500)
    assert L._label(model, texts, L.SWITCH_PENALTY) == whole
    assert [x for t in texts for x in L._label(model, [t], L.SWITCH_PENALTY)] == whole


def test_only_rows_that_are_not_held_out_teach(spark):
    rows = [(i, "αβγ" if crc32(str(i).encode()) % 5 == 0 else "abc", "x") for i in range(200)]
    rows += [(None, "δεζ", "y"), (1000, "ηθι", None), (1001, None, "z")]
    model = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    assert model.languages == ["x"]
    assert model.uses[:, 0].tolist() == [n == 1 for n in range(len(L.SCRIPTS) + 1)]


def test_bounded_sample(spark):
    rows = [(i, "ab " * (i % 3 + 1), "x") for i in range(3000)] + [(1, "ab", "x")] * 5
    fit = lambda n: L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(n),
                          "doc_id", "text", "lang", docs_per_language=50)
    assert np.array_equal(fit(1).scores, fit(7).scores)


def test_odd_documents(spark, model):
    for teacher in (model, L.fit(odd_documents(spark), "doc_id", "text", "lang"), L.fit(no_documents(spark), "doc_id", "text", "lang")):
        df = odd_documents(spark)
        got = df.select("doc_id", "text", L.identify(spark, teacher, F.col("text")).alias("f")).collect()
        assert len(got) == df.count()
        for r in got:
            letters = any(c.isalpha() for c in r["text"] or "")
            if not letters or not teacher.languages:
                assert (r["f"]["lang"], r["f"]["score"], r["f"]["spans"]) == ("und", 0.0, [])
            else:
                assert r["f"]["lang"] in teacher.languages and 0 <= r["f"]["score"] <= 1


def test_every_language_is_learned(spark):
    # 300 languages of one word each; states beyond 255 and those that few documents have count too.
    names = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
    words = [f"{n[0] * 3}{n[1] * 3}{n}" for n in names]
    rows = [(10 * i + j, " ".join([w] * 30), n) for i, (n, w) in enumerate(zip(names, words)) for j in range(5 if i % 2 else 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.fit(df, "doc_id", "text", "lang")
    assert model.languages == sorted(names)
    got = L._label(model, [" ".join([w] * 30) for w in words], L.SWITCH_PENALTY)
    assert [g["lang"] for g in got] == names and {g["score"] for g in got} == {1.0}
    with pytest.raises(ValueError, match="more than 299 languages"):
        L.fit(df, "doc_id", "text", "lang", max_languages=299)
