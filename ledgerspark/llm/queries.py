"""One registered query for each operator of this subpackage, and DuckDB SQL for those SQL can express.

Each query applies its operator to a whole table and derives the columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, filter_audit, line_dedup, mixing, near_dup, pii, quality_classifier, quality_rules, substring_dedup, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: set size, smallest document of its component, whether it stays."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op2_near_duplicates"] = op2_near_duplicates
ORACLES["op2_near_duplicates"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
      WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of each query by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES["op3_top_k"] = op3_top_k
ORACLES["op3_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
e AS MATERIALIZED (SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.r AS cr, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM e q JOIN e c USING (i) WHERE q.vec_id % 50 = 0 AND c.r <> q.r GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the hash of what is left of each document."""
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES["op4_line_dedup"] = op4_line_dedup
ORACLES["op4_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, k.line, k.i, d.key IS NOT NULL AND k.doc_id <> d.keeper AS gone FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before and removed, and the hash of the words that are left of each document."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES["op5_substring_dedup"] = op5_substring_dedup
ORACLES["op5_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM w WHERE k > 1),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
j AS (SELECT a.doc_id, a.word, a.p, c.p IS NOT NULL AS gone FROM a LEFT JOIN c USING (doc_id, p)),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated score of every document; fitted on labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        quality_classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES["op7_quality_classifier"] = op7_quality_classifier


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document to ids and back: their number, and hashes of the ids and of the decoded bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True, text=False)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES["op9_bpe"] = op9_bpe


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken to meet the production weights."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES["op1_mix_sources"] = op1_mix_sources


def _filled(name: str, keys: str, label: str, rows: str) -> str:
    """CTEs that share a parent's budget among rows (keys, label, weight, capacity, budget)."""
    by = f"PARTITION BY {keys} ORDER BY CAST(capacity AS DOUBLE) / weight, {label}"
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(capacity) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER ({by}) AS k FROM ({rows})),
{name}_b AS (SELECT *, capacity * ws <= lft * weight AS f FROM {name}_a),
{name}_c AS (SELECT *, first_value(CASE WHEN NOT f THEN lft END IGNORE NULLS) OVER w AS l1, first_value(CASE WHEN NOT f THEN ws END IGNORE NULLS) OVER w AS w1
  FROM {name}_b WINDOW w AS (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT *, CAST(CASE WHEN f THEN capacity ELSE (l1 * weight) // w1 END AS BIGINT) AS allotted FROM {name}_c)"""


ORACLES["op1_mix_sources"] = f"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM documents),
d AS (
  SELECT *, CASE WHEN regexp_full_match(source, 'src[0-9]{{1,9}}') THEN ['web', 'books', 'code'][CAST(substring(source, 4) AS INT) % 3 + 1] ELSE 'other' END AS domain FROM t),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS available, CAST(4 * sum(n) AS BIGINT) AS capacity FROM d GROUP BY ALL),
dw AS (SELECT domain, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS weight, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaf GROUP BY domain),
lw AS (SELECT domain, lang, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaf GROUP BY domain, lang),
b AS (SELECT least((SELECT CAST(sum(available) AS BIGINT) * 60 // 100 FROM leaf), (SELECT sum(capacity) FROM dw)) AS budget),
{_filled("df", "1", "domain", "SELECT dw.*, b.budget FROM dw, b")},
{_filled("lf", "domain", "lang", "SELECT lw.*, df.allotted AS budget FROM lw JOIN df USING (domain)")},
{_filled("sf", "domain, lang", "source", "SELECT leaf.*, CASE source WHEN 'src0' THEN 8 ELSE 1 END AS weight, lf.allotted AS budget FROM leaf JOIN lf USING (domain, lang)")},
p AS (SELECT domain, lang, source, CASE WHEN available > 0 THEN allotted // available ELSE 0 END AS e, CASE WHEN available > 0 THEN allotted % available ELSE 0 END AS rest FROM sf),
o AS (
  SELECT d.*, e, rest, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || e || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, n
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b4
  FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(n AS BIGINT) AS n_tokens, CAST(e AS BIGINT) AS whole_epochs, CAST(greatest(0, least(n, rest - b4)) AS BIGINT) AS prefix_tokens FROM o
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the learned decision list."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.apply_rules(docs, rules).select(*columns)


QUERIES["op6_quality_rules"] = op6_quality_rules


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_quality_rules that SQL can express: everything but the learned verdict."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality_rules.apply_rules(docs, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES["quality_statistics"] = quality_statistics
ORACLES["quality_statistics"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
s AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8),
w AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 7], ' ')) AS same FROM s),
c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) FROM w WHERE same > 1) GROUP BY r),
t AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN c USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM t
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pii.pseudonymize(docs).select("doc_id", "n_private", "text")


QUERIES["op8_pii"] = op8_pii


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's perspective."""
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("spans", F.to_json("spans"))


QUERIES["op10_chat"] = op10_chat
ORACLES["op10_chat"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
u AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER (ORDER BY turn, who, text) END AS alone FROM t),
p AS (SELECT DISTINCT conv_id, alone, who AS perspective FROM u WHERE who <> 'system'),
r AS (
  SELECT u.*, perspective, '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = perspective THEN 'assistant' ELSE 'user name=' || who END || chr(10) AS head,
         text || '<|im_end|>' AS body FROM u JOIN p ON u.conv_id IS NOT DISTINCT FROM p.conv_id AND u.alone IS NOT DISTINCT FROM p.alone),
s AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, alone, perspective ORDER BY turn NULLS FIRST, who, text
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM r)
SELECT conv_id, perspective, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS before, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, who, text) AS rendered,
       '[' || coalesce(string_agg('{"from":' || a || ',"to":' || (a + length(body)) || '}', ',' ORDER BY turn NULLS FIRST, who, text) FILTER (who = perspective), '') || ']' AS spans,
       CAST(coalesce(sum(length(body)) FILTER (who = perspective), 0) AS BIGINT) AS n_target_chars
FROM s GROUP BY conv_id, alone, perspective
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language, at each step of all orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op11_filter_audit"] = op11_filter_audit
ORACLES["op11_filter_audit"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step, bits FROM o),
t AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM s),
r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & (before | bit) = bit), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & (before | bit) = bit), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & (before | bit) = bit), 0) AS toxic_lost
  FROM c, t GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector, and what its centroid and the clustering come to."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _lloyd(rounds: int, clusters: int, seed: int) -> str:
    """CTEs c0 to c{rounds} of centroids (c, i, x) and a0 to a{rounds} of assignments (r, c, d) of vectors e (r, i, x)."""
    parts = [f"""c0 AS MATERIALIZED (
  SELECT h.k - 1 AS c, e.i, e.x FROM (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) AS k FROM v) h JOIN e USING (r) WHERE h.k <= {clusters})"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT e.r, m.c, sum((e.x - m.x) * (e.x - m.x)) AS d FROM e JOIN c{k} m USING (i) GROUP BY ALL) GROUP BY r)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(z.x, o.x) AS x FROM c{k} o LEFT JOIN (
    SELECT a.c, e.i, (sum(e.x) - ((sum(e.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{k} a JOIN e USING (r) GROUP BY ALL) z USING (c, i))""")
    return ",\n".join(parts)


QUERIES["op12_centroids"] = op12_centroids
ORACLES["op12_centroids"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
e AS MATERIALIZED (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
{_lloyd(centroids.ROUNDS, centroids.CLUSTERS, centroids.SEED)},
s AS (SELECT c, sha256(string_agg(CAST(x AS BIGINT), ',' ORDER BY i)) AS centroid_sha256 FROM c{centroids.ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{centroids.ROUNDS} JOIN v USING (r) JOIN s USING (c)
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    return warc.archived_pages(table(spark, sf_dir, "pages"))


QUERIES["op13_warc"] = op13_warc
ORACLES["op13_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(sha1(html), CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM p
"""
