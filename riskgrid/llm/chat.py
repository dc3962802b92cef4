"""Preference formatting: one prompt and two masked completions per pair of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.sources.workdir import materialize

# The rendering of a turn. Fixed values.
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
NO_ROLE = "unknown"
# Bytes of a pair's turns beyond which its texts would pass what a string can hold.
MAX_BYTES = 2 ** 31 - 2 ** 20
# Turns of one side are put in order in ranges of so many turn numbers.
RANGE_TURNS = 256


def _turns(turns: DataFrame, pair: str, turn: str, role: str, text: str, side: str) -> DataFrame:
    number = F.col(turn).cast("bigint")
    return turns.select(
        F.col(pair).alias("pair_id"), F.lit(side).alias("side"), number.alias("turn"),
        F.coalesce(F.floor(number / RANGE_TURNS), F.lit(-(2 ** 63))).alias("range"),
        F.coalesce(F.col(role).cast("string"), F.lit(NO_ROLE)).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("pair_id").isNotNull()) \
        .withColumns({"digest": F.md5(F.col("text").cast("binary")),
                      "n_bytes": F.octet_length("text") + F.octet_length("role") + len(OPEN + SHUT + END)})


def _ranked(turns: DataFrame) -> DataFrame:
    """The rank of every turn in its range, from 1; repeated rows once."""
    order = Window.partitionBy("pair_id", "side", "range").orderBy(
        F.col("turn").asc_nulls_first(), "role", "digest")
    row = F.struct("turn", "role", "digest")
    return (turns.withColumns({"rank": F.dense_rank().over(order), "last": F.lag(row).over(order)})
            .where(~F.col("last").eqNullSafe(row)).drop("last"))


def _rendered(role: Column, text: Column) -> tuple[Column, Column]:
    head = F.concat(F.lit(OPEN), role, F.lit(SHUT))
    return F.concat(head, text, F.lit(END)), F.length(head)


def _spans(turns: Column) -> Column:
    """Character ranges of the trained turns' text and end mark, from turns laid end to end."""
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(turn["line"])
        own = F.array(F.struct((state["at"] + turn["head"]).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["trained"], F.concat(state["spans"], own))
                        .otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn",
                role: str = "role", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rendered prompt and completions of every pair of conversations, given turn by turn.

    The turns that both conversations begin with (same role and text) are rendered once as ``prompt``; the
    rest of each is a completion. ``chosen_spans`` and ``rejected_spans`` are the character ranges of a
    completion that are trained on: text and end mark of the assistant's turns. Returns one row for every pair:
    ``pair_id``, ``prompt_turns``, ``prompt``, ``chosen``, ``rejected`` and the spans. A row is as large as its
    conversations; a pair that no string can hold (``max_bytes``) ends the job with an error that names it. A side
    that has ended, or is empty, is an empty text.

    Turns are numbered range by range, and ranges by their sizes, so that a very long conversation is many
    ranges until it is rendered. The texts are shuffled twice; all else is done on their digests.

    Turns are ordered by turn (nulls first), role and digest of the text; a repeated row counts once. A null text
    is empty, a null role is ``unknown``. Turns without a pair are left out. If one conversation lacks, the other
    is its completion and the prompt is empty. Equal conversations are all prompt. Other columns take no part.
    """
    turns = _turns(chosen, pair, turn, role, text, "chosen").unionByName(
        _turns(rejected, pair, turn, role, text, "rejected"))
    narrow = materialize(_ranked(turns.drop("text")), "turns")
    keys = ["pair_id", "side", "range"]
    earlier = Window.partitionBy("pair_id", "side").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = narrow.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = narrow.join(ranges.drop("n_bytes"), keys).withColumn("place", F.col("rank") - 1 + F.col("before"))
    own = F.struct("role", "digest")
    both = placed.groupBy("pair_id", "place").agg(
        F.max(F.when(F.col("side") == "chosen", own)).alias("chosen"),
        F.max(F.when(F.col("side") == "rejected", own)).alias("rejected"))
    common = both.groupBy("pair_id").agg(F.coalesce(
        F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("place"))),
        F.max("place") + 1).cast("int").alias("prompt_turns"))
    sizes = ranges.groupBy("pair_id").agg(F.sum("n_bytes").alias("all_bytes"))
    too_long = F.raise_error(F.concat(F.lit("pair "), F.col("pair_id").cast("string"), F.lit(" is too long for one row")))
    prompts = common.join(sizes, "pair_id").select(
        "pair_id", F.when(F.col("all_bytes") > max_bytes, too_long.cast("int")).otherwise(F.col("prompt_turns"))
        .alias("prompt_turns"))
    marks = materialize(ranges.drop("n_bytes").join(prompts, "pair_id"), "ranges")
    place = F.col("rank") - 1 + F.col("before")
    prompt = F.col("place") < F.col("prompt_turns")
    line, head = _rendered(F.col("role"), F.col("text"))
    rows = (_ranked(turns).join(marks, keys).withColumn("place", place)
            .where(~prompt | (F.col("side") == "chosen"))
            .select("pair_id", "prompt_turns", F.when(prompt, "prompt").otherwise(F.col("side")).alias("side"),
                    F.struct("place", line.alias("line"), head.alias("head"),
                             (F.col("role") == TRAINED_ROLE).alias("trained")).alias("line")))
    lists = rows.groupBy("pair_id").agg(
        F.first("prompt_turns").alias("prompt_turns"),
        *[F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("line")))).alias(side)
          for side in ("prompt", "chosen", "rejected")])

    def whole(side: str) -> Column:
        return F.array_join(F.transform(side, lambda t: t["line"]), "").alias(side)

    return lists.select("pair_id", "prompt_turns", whole("prompt"), whole("chosen"), whole("rejected"),
                        _spans(F.col("chosen")).alias("chosen_spans"), _spans(F.col("rejected")).alias("rejected_spans"))
