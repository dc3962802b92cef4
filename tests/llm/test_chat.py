"""Preference formatting. The query itself is compared with SQL in test_sql."""

from __future__ import annotations

import pytest

from riskgrid.llm import chat

SCHEMA = "pair_id bigint, turn bigint, role string, text string"


def result(spark, chosen, rejected, **options):
    got = chat.preferences(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA), **options)
    rows = got.collect()
    assert len({r["pair_id"] for r in rows}) == len(rows)
    return {r["pair_id"]: r for r in rows}


def line(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_prompt_completions_and_masks(spark):
    start = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello.")]
    got = result(spark, start + [(1, 3, "user", "More"), (1, 4, "assistant", "Good é answer")],
                 start + [(1, 3, "user", "More"), (1, 4, "assistant", "Bad"), (1, 5, "user", "x"), (1, 6, "assistant", "Worse")])
    row = got[1]
    assert row["prompt_turns"] == 4 and len(got) == 1
    assert row["prompt"] == "".join(line(r, t) for _, _, r, t in start) + line("user", "More")
    assert row["chosen"] == line("assistant", "Good é answer")
    trained = [row["rejected"][s["start"]: s["end"]] for s in row["rejected_spans"]]
    assert trained == ["Bad<|end|>\n", "Worse<|end|>\n"]
    assert [row["chosen"][s["start"]: s["end"]] for s in row["chosen_spans"]] == ["Good é answer<|end|>\n"]


@pytest.mark.parametrize("shared", [65, 5000])
def test_long_conversations_are_one_row(spark, monkeypatch, shared):
    monkeypatch.setattr(chat, "RANGE_TURNS", 8)
    turns = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(shared + 70)]
    got = result(spark, turns, turns[:shared] + [(1, shared, "user", "other")])
    row = got[1]
    assert len(got) == 1 and row["prompt_turns"] == shared
    assert row["prompt"] == "".join(line(r, t) for _, _, r, t in turns[:shared])
    assert row["chosen"] == "".join(line(r, t) for _, _, r, t in turns[shared:])
    assert row["rejected"] == line("user", "other")
    trained = [row["chosen"][s["start"]: s["end"]] for s in row["chosen_spans"]]
    assert trained == [f"text {i}<|end|>\n" for i in range(shared, shared + 70) if i % 2]


def test_pairs_beyond_a_string_are_refused(spark):
    turns = [(5, 0, "user", "x" * 500), (6, 0, "user", "short")]
    with pytest.raises(Exception, match="pair 5 is too long"):
        result(spark, turns, turns, max_bytes=400)


def test_odd_turns(spark):
    chosen = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None),      # repeated row, nulls come first
              (2, 0, "user", "same"), (3, 0, "user", "alone"), (None, 0, "user", "nobody"),
              (5, 7, "user", "b"), (5, 7, "assistant", "c"),                        # a tie goes by role
              (6, 0, "user", "x" * 200_000), (7, -3, "user", "early"), (7, 900, "user", "late")]
    rejected = [(1, 0, "user", "b"), (2, 0, "user", "same"), (4, 0, "assistant", ""), (6, 0, "user", "x" * 200_000)]
    got = result(spark, chosen, rejected)
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    assert got[1]["prompt"] == "" and got[1]["chosen"] == line("unknown", "") + line("user", "a")
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert got[3]["chosen"] == line("user", "alone") and got[3]["rejected"] == ""
    assert [tuple(s) for s in got[4]["rejected_spans"]] == [(14, 22)]
    assert got[5]["chosen"] == line("assistant", "c") + line("user", "b")
    assert got[6]["prompt"] == line("user", "x" * 200_000)
    assert got[7]["chosen"] == line("user", "early") + line("user", "late")
    assert result(spark, [], []) == {}
    assert chat.preferences(*[spark.createDataFrame([], SCHEMA + ", side string, place int, part int, digest int")] * 2).count() == 0
