"""The operators over their whole tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    chat,
    conversation_repair,
    decontamination,
    language_id,
    mixing,
    personal_data,
    quality_classifier,
    quality_rules,
    query,
    sharding,
    simhash,
    substring_dedup,
    token_alignment,
    token_files,
)
from pageloom.llm.common import table


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.corpus_token_counts(table(spark, sf, "documents"))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.quality_by_votes(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.dedup_units(table(spark, sf, "documents"), "piece").select("doc_id", F.size("removed").alias("n_removed"), "removed", "kept_text")


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_source_mixing")
def op5_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op6_benchmark_decontamination",
    rf"""
    WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
    pattern AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS p
        FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
    doc AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
    place AS (
        SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS p
        FROM doc, (SELECT DISTINCT m FROM pattern) AS lengths, unnest(range(1, len(w) - m + 2)) AS t(k)),
    hit AS (SELECT doc_id, k, m, item_id FROM place JOIN pattern USING (m, p)),
    covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM (SELECT DISTINCT doc_id, k, m FROM hit)) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op6_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf, "documents"))


@query(
    "op9_chat_formatting",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, role, text,
               '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS piece
        FROM conversations),
    conv AS (
        SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn, role, text) AS l,
               string_agg(piece, '' ORDER BY turn, role, text) AS text
        FROM turns GROUP BY conv_id),
    prefix AS (SELECT DISTINCT k AS n, CAST(l[1:k] AS VARCHAR) AS l FROM conv, unnest(range(1, n)) AS t(k)),
    first AS (SELECT min(conv_id) AS conv_id, n, CAST(l AS VARCHAR) AS l, any_value(text) AS text FROM conv GROUP BY n, CAST(l AS VARCHAR))
    SELECT conv_id, n AS n_turns, 0 AS part, text FROM first ANTI JOIN prefix ON first.n = prefix.n AND first.l = prefix.l
    """,
)
def op9_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat.format_chats(table(spark, sf, "conversations"))


@query("op10_sampled_splitters")
def op10_sampled_splitters(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        *(personal_data.n_of("base", kind).alias(f"n_{kind}") for kind in personal_data.KINDS),
        F.sha2(personal_data.joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        personal_data.joined_spans(F.col("spans")).alias("spans"),
    )


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.align_corpus(table(spark, sf, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


# States 0 to 3: nothing, after system, after user, after assistant. ``moves`` holds what may happen between the ends of two rows.
_EDITS = r"""
    ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
    step(l, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
    sym AS (SELECT i AS sym, lower(i) AS l, CASE WHEN i <> lower(i) THEN 1 ELSE 0 END AS cut FROM (SELECT unnest(string_split('x,s,u,a,o,S,U,A,O', ',')) AS i)),
    edit AS (
        SELECT sym, p, p AS q, 3 AS c, 'D' AS a FROM sym, (SELECT DISTINCT p FROM ins)
        UNION ALL SELECT sym, p, q, cut, 'K' FROM sym JOIN step USING (l)
        UNION ALL SELECT sym, p, q, 2 + cut, 'R' FROM sym JOIN step ON step.l IN ('u', 'a') WHERE sym <> 'x'),
    moves AS (SELECT sym, ins.p, edit.q, ins.c + edit.c AS c, ins.a || edit.a AS a FROM ins JOIN edit ON ins.q = edit.p)"""


@query(
    "op13_conversation_repair",
    rf"""
    WITH RECURSIVE crc AS MATERIALIZED (
        SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS r(i))),
    ids AS MATERIALIZED (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS key FROM (SELECT DISTINCT conv_id FROM conversations)),
    hashed AS (
        SELECT ids.key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
        FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
    kinds AS (
        SELECT key, turn, role, text,
            xor(list_reduce([4294967295] || list_transform(range(1, length(place) + 1), lambda k: CAST(ascii(substr(place, k, 1)) AS BIGINT)),
                lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) % 20 AS kind
        FROM hashed, crc),
    damaged AS (
        SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM kinds, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copies(copy) WHERE kind <> 0),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
    judged AS MATERIALIZED (
        SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
            CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault
        FROM placed),
    symbols AS MATERIALIZED (
        SELECT key, k, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS sym FROM judged),
    {_EDITS.strip()},
    best AS (
        SELECT key, CAST(0 AS BIGINT) AS k, 0 AS q, {{'c': 0, 'a': ''}} AS b FROM (SELECT DISTINCT key FROM symbols)
        UNION ALL
        SELECT best.key, best.k + 1, moves.q, min({{'c': b.c + moves.c, 'a': b.a || moves.a}})
        FROM best JOIN symbols ON symbols.key = best.key AND symbols.k = best.k + 1 JOIN moves ON moves.sym = symbols.sym AND moves.p = best.q
        GROUP BY best.key, best.k + 1, moves.q),
    ends AS (SELECT key, max(k) AS n FROM symbols GROUP BY key),
    found AS MATERIALIZED (
        SELECT best.key, min({{'c': b.c + ins.c, 'a': b.a || ins.a}}) AS b
        FROM best JOIN ends ON ends.key = best.key AND ends.n = best.k JOIN ins ON ins.p = best.q WHERE ins.q IN (0, 3) GROUP BY best.key),
    ops AS (SELECT key, i, substr(b.a, CAST(i AS BIGINT), 1) AS op FROM found, unnest(range(1, length(b.a) + 1)) AS t(i)),
    rows AS (SELECT *, sum(CASE WHEN op = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY i) AS k FROM ops),
    kept AS (
        SELECT rows.key, i, op, j.role, CASE WHEN op = 'I' THEN '' ELSE j.text END AS text,
            row_number() OVER (PARTITION BY rows.key ORDER BY i) AS spot,
            first_value(CASE WHEN op = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY rows.key ORDER BY i) AS shift
        FROM rows LEFT JOIN judged j ON j.key = rows.key AND j.k = rows.k WHERE op <> 'D'),
    lines AS (
        SELECT key, string_agg(CASE WHEN op = 'K' THEN role WHEN (spot - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS text FROM kept GROUP BY key),
    pairs AS (SELECT key, lag(initial) OVER (PARTITION BY key ORDER BY k) || initial AS pair FROM judged),
    illegal AS (SELECT key, count(*) AS n FROM pairs WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY key),
    counts AS (
        SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
        FROM judged GROUP BY key)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        CAST(coalesce(illegal.n, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(lines.text, '')) AS repaired_sha256
    FROM ids LEFT JOIN counts USING (key) LEFT JOIN illegal USING (key) LEFT JOIN found USING (key) LEFT JOIN lines USING (key)
    """,
)
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations)
