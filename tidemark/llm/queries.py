"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audio, chat, codes, embeddings, jaccard, mixing, packing, quality, repair, sharding, suffix, urls, winnow

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_report(table(spark, sf_dir, "documents"), words=suffix.WORDS)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model)


def _spans(mask: str) -> Column:
    return F.array_join(F.transform(F.col(mask), lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias(mask)


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_preferences(chat.pair_neighbours(table(spark, sf_dir, "conversations")))
    return pairs.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", _spans("chosen_mask"), _spans("rejected_mask"))


def op5_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.telephony_features(audio.store_texts(table(spark, sf_dir, "documents")))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.reshard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = embeddings.similar_vectors(table(spark, sf_dir, "embeddings"))
    return linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard.similar_documents(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "n_links", "copy_of", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_structure(repair.damage(table(spark, sf_dir, "conversations")))


def op12_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_edits(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_repeated_substrings": op2_repeated_substrings,
    "op3_quality": op3_quality,
    "op4_preferences": op4_preferences,
    "op5_telephony": op5_telephony,
    "op6_pack": op6_pack,
    "op7_reshard": op7_reshard,
    "op8_embedding_links": op8_embedding_links,
    "op9_url_filter": op9_url_filter,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_repair": op11_repair,
    "op12_winnow": op12_winnow,
    "op13_vector_codes": op13_vector_codes,
}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Assignment and means of each round written out."""
    assign = "SELECT p.vec_id, p.part, min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}}) AS best FROM p JOIN b{0} b ON p.part = b.part GROUP BY p.vec_id, p.part"
    sql = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, t.part, list_slice(v, CAST(t.part * len(v) // {parts} + 1 AS BIGINT), CAST((t.part + 1) * len(v) // {parts} AS BIGINT)) AS v FROM k, (SELECT unnest(range({parts})) AS part) t),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))"""
    for r in range(rounds):
        sql += f""",
a{r} AS MATERIALIZED ({assign.format(r)}),
u{r} AS (SELECT p.part, a.best.e AS entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS place FROM p JOIN a{r} a ON p.vec_id = a.vec_id AND p.part = a.part),
s{r} AS (SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM u{r} GROUP BY ALL),
m{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM s{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)"""
    return sql + f""",
a AS MATERIALIZED ({assign.format(rounds)}),
c AS (SELECT a.vec_id, k.label, string_agg(printf('%02x', a.best.e), '' ORDER BY a.part) AS code, CAST(sum(a.best.d) AS BIGINT) AS error FROM a JOIN k ON a.vec_id = k.vec_id GROUP BY a.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda x: CAST(x AS VARCHAR)), 'string_agg', ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c"""


def _repair_sql() -> str:
    """Turns read from the last to the first, with the best cost, audit and text from each of the four states."""
    made, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def edit(cost: str, letter: str, line: str, state: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 't': {line} || {state}.t}}"

    def consumed(s: int) -> str:
        kept = " ".join(f"WHEN '{x}' THEN {edit('more', 'K', 'chr(10) || role || chr(58) || text', f'v{t}')}" for x, t in steps[s].items())
        return f"""list_min([{edit('4', 'D', "''", f'v{s}')}, CASE WHEN NOT gone THEN CASE initial {kept} END END,
          CASE WHEN NOT gone THEN {edit('3 + more', 'R', f"chr(10) || '{name[made[s]]}:' || text", f'v{made[s]}')} END]) AS g{s}"""

    def inserted(s: int) -> str:
        one, two = made[s], made[made[s]]
        lines = [f"chr(10) || '{name[x]}:'" for x in (one, two)]
        return f"list_min([g{s}, {edit('3', 'I', lines[0], f'g{one}')}, {edit('6', 'II', lines[0] + ' || ' + lines[1], f'g{two}')}]) AS v{s}"

    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(key) + 1), lambda i: [CAST(ascii(substr(key, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z)),
o AS (
  SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS initial,
         coalesce(lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS odd
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text))),
f AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, blank OR again AS gone,
         CASE WHEN NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS more FROM o),
n AS (
  SELECT conv_id, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE more > 0) AS truncated, count(*) FILTER (WHERE odd) AS illegal, count(*) AS turns FROM f GROUP BY conv_id),
r AS (
  SELECT conv_id, turns AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS v0, {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS v1,
         {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}} AS v2, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS v3 FROM n
  UNION ALL
  SELECT conv_id, i - 1, {", ".join(inserted(s) for s in range(4))}
  FROM (SELECT r.conv_id, r.i, {", ".join(consumed(s) for s in range(4))} FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i)),
b AS (SELECT conv_id, v0 FROM r WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(substr(v0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""


ORACLES: dict[str, str] = {
    "op1_mix_sources": """
WITH RECURSIVE s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight FROM g),
r AS (
  SELECT 0 AS round, CAST(-1 AS DOUBLE) AS level, (SELECT count(*) FROM w) * 0 AS capped, -1 AS held
  UNION ALL
  SELECT r.round + 1,
         (SELECT (1.5 * (SELECT sum(source_size) FROM w) - coalesce(sum(cap) FILTER (WHERE r.level >= 0 AND weight * r.level > cap), 0)) / nullif(sum(weight) FILTER (WHERE r.level < 0 OR weight * r.level <= cap), 0) FROM w),
         (SELECT count(*) FROM w WHERE r.level >= 0 AND weight * r.level > cap), CAST(r.capped AS INTEGER)
  FROM r WHERE r.round = 0 OR (r.round <= (SELECT count(*) FROM w) AND r.level IS NOT NULL AND (r.round = 1 OR r.capped > r.held))),
l AS (SELECT coalesce(max_by(level, round), 0) AS level FROM r WHERE level IS NOT NULL),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM w, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT s.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY s.source, h) AS own
      FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN size = 0 THEN 0 WHEN upto - own <= rest AND (rest >= upto OR rest - (upto - own) >= own / 2.0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""",
    "op4_preferences": """
WITH t AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, 'unknown') AS role,
         '<|' || replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS shown
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role, shown) AS pos FROM t),
s AS (SELECT *, count(*) OVER x = 2 AND min(shown) OVER x = max(shown) OVER x AS same FROM p WINDOW x AS (PARTITION BY pair_id, pos)),
u AS (SELECT *, bool_and(same) OVER (PARTITION BY pair_id, chosen ORDER BY pos ROWS UNBOUNDED PRECEDING) AS shared FROM s),
v AS (SELECT *, CAST(sum(CASE WHEN shared THEN 0 ELSE length(shown) END) OVER (PARTITION BY pair_id, chosen ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM u),
m AS (SELECT *, CASE WHEN role = 'assistant' AND NOT shared THEN CAST(stop - length(shown) + length(role) + 5 AS VARCHAR) || '-' || CAST(stop AS VARCHAR) END AS span FROM v)
SELECT pair_id, count(*) FILTER (WHERE chosen AND shared) AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE chosen AND shared), '') AS prompt,
       CASE WHEN bool_or(chosen) THEN coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE chosen AND NOT shared), '') END AS chosen,
       CASE WHEN bool_or(NOT chosen) THEN coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE NOT chosen AND NOT shared), '') END AS rejected,
       CASE WHEN bool_or(chosen) THEN coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE chosen AND span IS NOT NULL), '') END AS chosen_mask,
       CASE WHEN bool_or(NOT chosen) THEN coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE NOT chosen AND span IS NOT NULL), '') END AS rejected_mask
FROM m GROUP BY pair_id""",
    "op9_url_filter": """
WITH h AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches('.' || host || path, '(?s)^[^/]*\\.(ads-track|adult-[^/]*|casino-[^/]*|cheap-pills|free-bets|spam-farm)\\.') THEN 'block'
            ELSE 'allow' END AS verdict
FROM r""",
    "op11_repair": _repair_sql(),
    "op13_vector_codes": _codes_sql(),
}
