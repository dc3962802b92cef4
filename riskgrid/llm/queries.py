"""The registered queries of this folder, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm import (chat, chunks, decontaminate, hamming, language, licenses, mixing, packing, ranked, repair,
                          sharding, simhash, token_counts)
from riskgrid.llm.common import table
from riskgrid.sources.workdir import materialize, shared_path

Query = Callable[[SparkSession, str], DataFrame]

NEIGHBOURS = 10
MAX_TOKENS = 1024
# Target shares follow token shares raised to these powers.
POWERS = {"source": 0.9, "lang": 0.9, "topic": 0.95}


def op1_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where(F.col("id") % 100 == 0), NEIGHBOURS)


SQL_OP1 = f"""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
         list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (e.embedding[i] > 0) AS INTEGER)))
           AS distance
  FROM q, embeddings e WHERE e.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d
)
SELECT query_id, neighbor_id, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= {NEIGHBOURS}
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    counts = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"),
        shared_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), "text", ["doc_id"],
                                      table(spark, sf_dir, "benchmark"), "item_id", "text")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", simhash.fingerprint_hex(F.col("bits")).alias("fingerprint"), "component_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixing.mix(documents, "doc_id", mixing.document_margins(), mixing.token_weight(F.col("text")),
                      powers=POWERS, keep=["doc_id"], content=F.col("text"))


def _topic_sql() -> str:
    cases = []
    for name, pattern, per_thousand in mixing.TOPICS:
        places = f"len(regexp_extract_all(text, '{pattern}'))"
        cases.append(f"WHEN {places} > 0 AND {places} * 1000 >= length(text) * {per_thousand} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{mixing.OTHER_TOPIC}' END"


def _rake_sql(rounds: int) -> str:
    """The same proportional fitting, written out round by round."""
    goals = ", ".join(
        f"g_{m} AS (SELECT {m}, pow(sum(tokens), {p}) / (SELECT sum(pow(t, {p})) FROM (SELECT sum(tokens) AS t "
        f"FROM cells GROUP BY {m})) AS share FROM cells GROUP BY {m})" for m, p in POWERS.items())
    steps, last = [], "r0"
    for i in range(rounds):
        for m in POWERS:
            now = f"r{i + 1}_{m}"
            steps.append(f"{now} AS MATERIALIZED (SELECT r.* REPLACE (r.weight * g.share * (SELECT sum(tokens) FROM cells) / "
                         f"sum(r.weight) OVER (PARTITION BY r.{m}) AS weight) FROM {last} r JOIN g_{m} g "
                         f"ON r.{m} IS NOT DISTINCT FROM g.{m})")
            last = now
    return (f"{goals}, r0 AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM cells), " + ", ".join(steps)
            + f", f AS (SELECT source, lang, topic, weight / tokens AS factor FROM {last})")


SQL_OP5 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS key, source, lang,
         {_topic_sql()} AS topic, row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1 AS n,
         1 + coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents
), cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL),
{_rake_sql(mixing.ROUNDS)},
p AS (
  SELECT d.doc_id, d.key, d.n, d.source, d.lang, d.topic, d.tokens, round(f.factor, 6) AS factor,
         round(f.factor / (SELECT max(factor) FROM f), 6) AS probability
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic
)
SELECT * EXCLUDE (key, n), CAST('0x' || substr(md5(key || ':' || n), 1, 12) AS BIGINT) / 281474976710656.0
          < probability AS sampled
FROM p
"""


def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents, "doc_id", "text", "lang")
    found = documents.select("doc_id", language.identify(spark, model, F.col("text")).alias("found"))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"),
                        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
                        F.size("found.spans").alias("n_spans"))


def preference_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two conversations become a pair: the even one is chosen; the rejected one begins with its first
    ``pair_id % 4`` turns and goes on with the later turns of the odd one."""
    turns = table(spark, sf_dir, "conversations").withColumn("pair_id", F.floor(F.col("conv_id") / 2))
    even, shared = F.col("conv_id") % 2 == 0, F.col("turn") < F.col("pair_id") % 4
    return turns.where(even), turns.where(even == shared)


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.preferences(*preference_pairs(spark, sf_dir))

    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"].cast("string"),
                                                                    s["end"].cast("string"))), ",").alias(name)

    return pairs.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected",
                        joined("chosen_spans"), joined("rejected_spans"))


SQL_OP7 = """
WITH t AS (SELECT *, conv_id // 2 AS pair_id FROM conversations),
sides AS (
  SELECT 'chosen' AS side, pair_id, turn, role, text FROM t WHERE conv_id % 2 = 0
  UNION SELECT 'rejected', pair_id, turn, role, text FROM t WHERE (conv_id % 2 = 0) = (turn < pair_id % 4)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, role, md5(text)) - 1 AS place FROM sides
), b AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.place, r.place) AS place,
         c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM (SELECT * FROM o WHERE side = 'chosen') c
  FULL JOIN (SELECT * FROM o WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.place = r.place
), l AS (
  SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN place END), max(place) + 1) AS prompt_turns FROM b GROUP BY 1
), x AS (
  SELECT pair_id, prompt_turns, CASE WHEN place < prompt_turns THEN 'prompt' ELSE side END AS side,
         CASE WHEN place < prompt_turns THEN place ELSE place - prompt_turns END AS pos,
         '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body, role
  FROM o JOIN l USING (pair_id) WHERE NOT (place < prompt_turns AND side = 'rejected')
), y AS (
  SELECT *, head || body AS line FROM x
), z AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY pair_id, side ORDER BY pos) AS stop FROM y
)
SELECT pair_id, CAST(any_value(prompt_turns) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'prompt'), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'chosen'), '') AS chosen,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'rejected'), '') AS rejected,
       coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY pos)
                FILTER (WHERE side = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY pos)
                FILTER (WHERE side = 'rejected' AND role = 'assistant'), '') AS rejected_spans
FROM z GROUP BY pair_id
"""


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf_dir, "documents"), "doc_id", "text", at_minima=True).drop("text_key")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text", wrapped=True)


def _templates_sql() -> str:
    rows = ", ".join(f"({i}, '{label}', {sorted(set(words.split()))})"
                     for i, (label, words) in enumerate(licenses.TEMPLATES))
    return f"(VALUES {rows}) AS t(template, label, words)"


def _places_sql() -> str:
    parts = []
    for phrase, label in licenses.PHRASES:
        tests = " AND ".join(f"w[i + {n}] = '{word}'" for n, word in enumerate(phrase.split()))
        parts.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: coalesce({tests}, false)), "
                     f"lambda i: {{'place': i - 1, 'label': '{label}'}})")
    return "list_concat(" + "".join(f"list_concat({p}, " for p in parts[:-1]) + parts[-1] + ")" * (len(parts) - 1) + ", [])"


SQL_OP9 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS lower FROM documents
), b AS (
  SELECT row, doc_id, len(w) AS n_words, CASE WHEN contains(lower, 'license') THEN {_places_sql()} ELSE [] END AS places
  FROM (SELECT *, regexp_extract_all(lower, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d)
), lines AS (
  SELECT row, unnest(range(len(s))) AS block, unnest(s) AS line FROM (SELECT row, string_split(lower, chr(10)) AS s FROM d)
), m AS (
  SELECT row, block, label, len(list_intersect(
           list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')), words)) / len(words) AS c
  FROM lines, {_templates_sql()}
  WHERE length(line) > 0
), g AS (
  SELECT row, list(DISTINCT label) AS more, max(c) AS containment, count(DISTINCT block) AS n_blocks
  FROM m WHERE c >= {licenses.THRESHOLD} - 1e-9 GROUP BY row
)
SELECT doc_id, n_words, len(places) AS n_base,
       list_min(list_transform(places, lambda p: p.place)) AS first_word,
       list_max(list_transform(places, lambda p: p.place)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda p: p.label), coalesce(more, [])))), ',')
         AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score,
       coalesce(n_blocks, 0) AS n_blocks
FROM b LEFT JOIN g USING (row)
"""


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard",
                       F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                       "tokens")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"),
                          "item_id", "text")
    return found.withColumnRenamed("query_id", "item_id")


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS_SQL} AS words FROM documents),
s AS (SELECT count(*) AS all_docs, sum(len(words)) AS all_words FROM d WHERE len(words) > 0),
p AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY row, term
), g AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM p, s GROUP BY term
), q AS (
  SELECT DISTINCT item, item_id, unnest(words) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS_SQL} AS words FROM benchmark)
), x AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
         sum(weight * (({ranked.SCALE} * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * all_docs) // all_words)))) AS score
  FROM q JOIN p USING (term) JOIN g USING (term), s GROUP BY item, row
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= {ranked.TOP}
"""


def op12_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pieces = packing.encode_pieces(table(spark, sf_dir, "documents"), "text", ["doc_id"],
                                   public_tokenizers.path("byte_bpe_50k.json"))
    # Only the checksums of the ids are reported, so the ids are not written.
    narrow = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "piece-lengths")
    return packing.pack(narrow)


def op13_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.damage(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return repair.repair(turns).withColumnRenamed("conversation", "conv_id")


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_hamming_top_k, op2_token_counts, op3_benchmark_leaks, op4_simhash_groups, op5_mix_sources,
        op6_language_spans, op7_preferences, op8_repeated_spans, op9_license_scan, op10_balanced_shards, op11_ranked_search,
        op12_packed_sequences, op13_repaired_conversations)}


def all_sql() -> dict[str, str]:
    return {"op1_hamming_top_k": SQL_OP1, "op5_mix_sources": SQL_OP5, "op7_preferences": SQL_OP7,
            "op9_license_scan": SQL_OP9, "op11_ranked_search": SQL_OP11}
