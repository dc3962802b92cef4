"""Mixing documents to target weights by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.operators.sizes import lookup_join
from riskgrid.sources.workdir import materialize

ROUNDS = 60
TOLERANCE = 1e-12
# An error of the margins, as a part of the total, that is reported if it is left after the last round.
REPORTED = 1e-6
# Equal rows are numbered in so many lots.
LOTS = 64
# Topics by what a text is made of: the first pattern found in at least the given number of places per
# 1,000 characters (and at least once) names the topic. Fixed values.
TOPICS = (("credentials", r"(?:token|password|secret|key) ?=", 0.0),
          ("table", r" \| ", 5.0),
          ("shout", r"!!", 5.0),
          ("symbols", r"[#$%&]{3}", 2.0))
OTHER_TOPIC = "prose"
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def token_weight(text: Column) -> Column:
    """Words plus one end of document, so that empty and null texts weigh 1."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")).cast("bigint") + 1


def topic_of(text: Column, topics: Sequence[tuple[str, str, float]] = TOPICS, other: str = OTHER_TOPIC) -> Column:
    """The first topic whose pattern is frequent enough in the text; null and empty texts are ``other``."""
    chain = None
    for name, pattern, per_thousand in topics:
        places = F.regexp_count(text, F.lit(pattern))
        found = (places > 0) & (places * 1000 >= F.length(text) * per_thousand)
        chain = F.when(found, name) if chain is None else chain.when(found, name)
    return chain.otherwise(other)


def smoothed_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: its values' token shares raised to ``power`` and scaled to 1."""
    totals = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    total = totals.agg(F.sum(F.pow("tokens", F.lit(power)))).first()[0] or 1.0
    return totals.select(margin, (F.pow("tokens", F.lit(power)) / F.lit(total)).alias("share"))


def rake(cells: DataFrame, margins: Sequence[str], targets: Mapping[str, DataFrame], rounds: int = ROUNDS,
         tolerance: float = TOLERANCE, strict: bool = False) -> DataFrame:
    """Scale the cells' ``tokens`` until each margin has its target shares; adds ``weight``.

    ``targets`` holds for every margin a table (margin, share). Targets are taken relative to the total of
    those that have a cell; a value without a target keeps weight 0. A round scales every margin in turn.
    Stops when every margin was within ``tolerance`` of its targets (as a part of the total) at its turn, or
    after ``rounds``. If a margin is then still off by over 1e-6, as targets that the cells can't meet leave it, a
    warning tells by how much, or, with ``strict``, an error. Each round is written to the shared folder. The cells are sums over all documents and number at most the combinations
    of margin values; nulls are values like others.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if total is None:
        return cells.withColumn("weight", F.lit(None).cast("double"))
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin in margins:
        goal = targets[margin].select(F.col(margin).alias("value"), F.col("share").alias(f"goal_{margin}"))
        now = now.join(goal, now[margin].eqNullSafe(goal["value"]), "left").drop("value").fillna(0.0, [f"goal_{margin}"])
    now = materialize(now, "cells")
    scale = {}
    for margin in margins:
        present = now.select(margin, f"goal_{margin}").distinct().agg(F.sum(f"goal_{margin}")).first()[0]
        scale[margin] = total / present if present else 0.0
    error = 0.0
    for _ in range(rounds):
        now = now.withColumn("error", F.lit(0.0))
        for margin in margins:
            own = F.sum("weight").over(Window.partitionBy(margin))
            wanted = F.col(f"goal_{margin}") * scale[margin]
            now = now.withColumns({
                "weight": F.when(own > 0, F.col("weight") * wanted / own).otherwise(0.0),
                # Values without weight can't be scaled; they don't keep the others from being done.
                "error": F.greatest("error", F.when(own > 0, F.abs(own - wanted) / total).otherwise(0.0))})
        now = materialize(now, "cells")
        error = now.agg(F.max("error")).first()[0]
        if error <= tolerance:
            break
    if error > REPORTED:
        message = f"after {rounds} rounds a margin is off its target by {error:.3g} of the total"
        if strict:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return now.drop("error", *[f"goal_{m}" for m in margins])


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of the key as text; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(16 ** 12))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``__n``: the number of a row among those with its ``__key``, from 0.

    Only keys that repeat are shuffled with their rows, dealt over lots, so that no task gets all rows of one.
    """
    repeated = materialize(rows.groupBy("__key").count().where("count > 1").select("__key", F.lit(True).alias("__again")),
                           "repeated")
    marked = lookup_join(rows, repeated, ["__key"])
    alone = marked.where("__again IS NULL").withColumn("__n", F.lit(0).cast("bigint")).drop("__again")
    several = marked.where("__again").drop("__again").withColumn("__lot", F.pmod(F.xxhash64("__place"), F.lit(LOTS)))
    sizes = several.groupBy("__key", "__lot").count()
    earlier = Window.partitionBy("__key").orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__key", "__lot", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__key", "__lot").orderBy("__place"))
    numbered = several.withColumn("__n", inside).join(before, ["__key", "__lot"]).withColumn(
        "__n", F.col("__n") - 1 + F.col("__before")).drop("__lot", "__before")
    return alone.unionByName(numbered)


def mix(documents: DataFrame, doc_id: str, margins: Mapping[str, Column], tokens: Column,
        targets: Mapping[str, DataFrame] | None = None, powers: Mapping[str, float] | None = None,
        keep: Sequence[str] = (), rounds: int = ROUNDS, content: Column | None = None) -> DataFrame:
    """Calibrated sampling probability and decision for every document.

    Returns ``keep`` columns, the margins, ``tokens``, ``factor`` (raked over original token weight of the
    document's cell), ``probability`` (the factor over the largest one, so that sampled tokens have the
    target margins in expectation) and ``sampled``, which follows a hash of the id, the ``content`` and the row's
    number among rows that have both in common: a run again gives the same sample. Targets are given, or smoothed from
    the data by ``powers``.

    Null margins are values of their own. Rows that share an id, null ids too, and repeated rows are each drawn by
    themselves; which of several equal rows is kept makes no difference. Documents whose values have no target have
    probability 0. An empty table gives an empty result.
    """
    names = list(margins)
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                   F.md5(F.coalesce(content, F.lit("")).cast("binary")) if content is not None else F.lit(""))
    rows = documents.select(F.struct(*keep).alias("kept") if keep else F.struct(F.lit(0).alias("_")).alias("kept"),
                            key.alias("__key"), F.monotonically_increasing_id().alias("__place"),
                            *[c.alias(n) for n, c in margins.items()], tokens.alias("tokens"))
    narrow = materialize(rows, "weights")
    cells = materialize(narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cell-sums")
    goals = targets or {n: smoothed_targets(cells, n, (powers or {}).get(n, 1.0)) for n in names}
    factors = rake(cells, names, goals, rounds).select(*names, (F.col("weight") / F.col("tokens")).alias("factor"))
    most = factors.agg(F.max("factor")).first()[0] or 1.0
    # Nulls join as a flag and an empty value, so that the join has plain keys.
    keys = [c for n in names for c in (f"__null_{n}", f"__value_{n}")]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({f"__null_{n}": F.col(n).isNull() for n in names}
                              | {f"__value_{n}": F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names})

    joined = lookup_join(keyed(_numbered(narrow)), keyed(factors).select(*keys, "factor"), keys)
    probability = F.round(F.col("factor") / most, 6)
    draw = unit_hash(F.concat("__key", F.lit(":"), F.col("__n").cast("string")))
    out = joined.select("kept.*", *names, "tokens", F.round("factor", 6).alias("factor"),
                        probability.alias("probability"), (draw < probability).alias("sampled"))
    return out if keep else out.drop("_")


def document_margins(text: str = "text", source: str = "source", lang: str = "lang") -> dict[str, Column]:
    """The three margins of the documents table."""
    return {"source": F.col(source), "lang": F.col(lang), "topic": topic_of(F.col(text))}
