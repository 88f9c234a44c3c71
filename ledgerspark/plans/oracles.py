"""DuckDB SQL for the registered queries, written apart from the plans: the same tables derived anew, then one query each."""

from __future__ import annotations

_ST = "['invited','email_submitted','email_verified','funded','wager_submitted','wager_verified','closed','rejected','abandoned']"

VIEWS = f"""
participant AS (SELECT c_custkey AS id, c_name AS contact, CASE WHEN c_custkey % 10 <> 0 THEN 'p' || (c_custkey % 1400) || '@example.com' END AS email,
  TIMESTAMP '1991-01-01' + to_days(CAST(c_custkey % 1000 * 0 AS INT)) + to_hours(CAST(c_custkey % 1000 AS INT)) AS created_at FROM customer),
enrollment AS (SELECT o_orderkey AS id, o_custkey AS participant_id, o_orderpriority AS casino, {_ST}[CAST(o_orderkey % 9 + 1 AS INT)] AS state, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders),
grants AS (SELECT o_orderkey AS enrollment_id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 DAY AS sent_at,
  CASE WHEN o_orderkey % 2 = 0 THEN 'wire' END AS method FROM orders WHERE o_orderkey % 9 BETWEEN 3 AND 6 AND o_orderkey % 7 <> 0),
submission AS (SELECT o_orderkey AS id, o_orderkey AS enrollment_id, CASE WHEN o_custkey % 3 = 0 THEN 'signup_email' ELSE 'wager_recording' END AS kind,
  CASE WHEN o_custkey % 3 = 0 THEN 'email' WHEN o_custkey % 5 < 3 THEN 'dropbox' ELSE 'manual_upload' END AS channel,
  CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 40 AS INT)) AS received_at, sha256('m' || o_orderkey) AS content_hash FROM orders),
bits AS (SELECT vec_id, CAST(sum(CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) << CAST(63 - i AS INT) ELSE 0 END) AS BIGINT) AS base
  FROM embeddings, (SELECT unnest(range(1, 64)) AS i) GROUP BY vec_id),
media_hash AS (SELECT a.vec_id, CASE WHEN a.vec_id % 20 = 1 THEN xor(b.base, 5) ELSE b.base END AS dhash
  FROM bits a JOIN bits b ON b.vec_id = CASE WHEN a.vec_id % 20 = 1 THEN a.vec_id - 1 ELSE a.vec_id END),
media_asset AS (SELECT s.id, s.content_hash, CAST(floor(o_totalprice) AS BIGINT) AS bytes, h.dhash, s.received_at AS created_at,
    CASE WHEN s.id % 11 = 0 THEN s.received_at + INTERVAL 100 DAY END AS deleted_at
  FROM submission s JOIN orders ON o_orderkey = s.id LEFT JOIN media_hash h ON h.vec_id = s.id
  UNION ALL SELECT -1 - p_partkey, sha256('x' || p_partkey), CAST(p_size AS BIGINT), NULL, TIMESTAMP '1995-01-01', NULL FROM part),
email_evidence AS (SELECT s.id AS submission_id, CASE WHEN s.id % 4 = 0 THEN 'A' ELSE 'B' END AS tier, ['pass','fail','no_signature','error'][CAST(s.id % 4 + 1 AS INT)] AS dkim_result,
    'sel' || (s.id % 3) AS selector, 'd' || (s.id % 6) || '.example' AS d_domain,
    CASE s.id % 5 WHEN 0 THEN NULL WHEN 1 THEN upper(p.email) WHEN 2 THEN 'someone@else.example' ELSE p.email END AS to_addr
  FROM submission s JOIN enrollment e ON e.id = s.enrollment_id JOIN participant p ON p.id = e.participant_id WHERE kind = 'signup_email'),
allowlist AS (SELECT DISTINCT o_orderpriority AS casino, 'd' || (o_orderkey % 6) || '.example' AS domain FROM orders WHERE o_orderkey % 6 < 3),
extraction_run AS (SELECT o_orderkey * 10 + k AS id, o_orderkey AS submission_id, 'succeeded' AS status, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(40 + k AS INT)) AS started_at,
    100 + o_orderkey % 50 AS input_tokens, 10 * k AS output_tokens FROM orders, (VALUES (0), (1)) t(k) WHERE k <= o_orderkey % 2),
line0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos FROM lineitem),
line1 AS (SELECT *, 1000 - sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY pos) + CASE WHEN l_partkey % 20 = 0 THEN 7 ELSE 0 END AS bal FROM line0),
reads AS (SELECT l_orderkey AS run_id, pos // 2 + k AS frame, (pos // 2 + k) * 1.5 AS frame_ts, pos AS row_pos,
    CASE WHEN l_suppkey % 17 = 0 AND k = 1 THEN NULL WHEN l_linenumber % 7 = 6 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END AS ts,
    CASE l_returnflag WHEN 'A' THEN 'Bet' WHEN 'R' THEN 'wagered' WHEN 'N' THEN 'deposit' END AS kind,
    CASE WHEN l_suppkey % 17 = 0 AND k = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS amount, CAST(bal AS DOUBLE) AS balance,
    CASE WHEN l_linenumber % 5 <> 0 THEN CAST(0.45 AS DOUBLE) + abs(l_discount) + CAST(0.01 AS DOUBLE) * k END AS conf
  FROM line1, (VALUES (0), (1)) t(k)),
keyed AS (SELECT *, sha256(coalesce(ts, '') || '|' || coalesce(kind, '') || '|' || coalesce(CAST(CAST(amount AS BIGINT) AS VARCHAR), '') || '|' || coalesce(CAST(CAST(balance AS BIGINT) AS VARCHAR), '')) AS row_key
  FROM reads WHERE ts IS NOT NULL OR amount IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY run_id, row_key ORDER BY frame, row_pos) AS k, max(conf) OVER (PARTITION BY run_id, row_key) AS most FROM keyed),
ledger AS (SELECT run_id, row_key, ts, kind, amount, balance, frame_ts, CASE WHEN coalesce(most, 0) > coalesce(conf, 0) THEN most ELSE conf END AS conf,
    row_number() OVER (PARTITION BY run_id ORDER BY frame_ts, frame, row_pos) - 1 AS ordinal FROM firsts WHERE k = 1),
steps AS (SELECT *, lag(balance) OVER (PARTITION BY run_id ORDER BY ordinal) AS before FROM ledger),
g1 AS (SELECT run_id, ordinal FROM steps WHERE abs(abs(balance - before) - abs(amount)) > 0.01),
times AS (SELECT run_id, ordinal, try_strptime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM ledger),
jumps AS (SELECT run_id, epoch_ms(t) - lag(epoch_ms(t)) OVER (PARTITION BY run_id ORDER BY ordinal) AS d FROM times WHERE t IS NOT NULL),
g3 AS (SELECT run_id FROM (SELECT run_id, count(*) AS n, count(*) FILTER (d > 0) AS u, count(*) FILTER (d < 0) AS w FROM jumps GROUP BY run_id)
  WHERE n >= 3 AND u + w > 0 AND least(u, w) > 0.2 * (u + w)),
recon AS (SELECT s.id AS run_id, s.enrollment_id, coalesce(n_rows, 0) AS n_rows, coalesce(total, 0.0) AS wagered_total, CAST(g.amount AS DOUBLE) AS granted_amount,
    coalesce(total, 0.0) - CAST(g.amount AS DOUBLE) AS delta, coalesce(bad, 0) AS n_mismatches, bad IS NULL AS arithmetic_ok, coalesce(coalesce(total, 0.0) < CAST(g.amount AS DOUBLE), false) AS shortfall
  FROM submission s LEFT JOIN (SELECT run_id, count(*) AS n_rows, sum(CASE WHEN regexp_matches(lower(kind), 'bet|wager|stake') THEN abs(coalesce(amount, 0)) ELSE 0 END) AS total FROM ledger GROUP BY run_id) l ON l.run_id = s.id
  LEFT JOIN (SELECT run_id, count(*) AS bad FROM g1 GROUP BY run_id) b ON b.run_id = s.id LEFT JOIN grants g ON g.enrollment_id = s.enrollment_id WHERE kind = 'wager_recording'),
shared_line AS (SELECT l_orderkey AS run_id, o_custkey AS participant_id, strftime(l_shipdate, '%Y-%m') || '|' || l_returnflag || '|' || CAST(l_quantity AS INT) AS row_key
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
shared AS (SELECT a.run_id, count(*) AS n, count(DISTINCT b.participant_id) AS p FROM (SELECT DISTINCT * FROM shared_line) a JOIN shared_line b USING (row_key)
  WHERE a.run_id <> b.run_id AND a.participant_id <> b.participant_id GROUP BY a.run_id),
formats AS (SELECT id AS submission_id, channel, ['Lavf58.2','WhatsApp 2','HandBrake (libx264)','CoreMedia','x264 LIBX264'][CAST(id % 5 + 1 AS INT)] AS encoder FROM submission WHERE id % 13 <> 0),
traces AS (SELECT submission_id, channel, CASE WHEN contains(lower(encoder), 'whatsapp') THEN 'whatsapp' WHEN contains(lower(encoder), 'lavf') THEN 'lavf'
    WHEN contains(lower(encoder), 'libx264') THEN 'libx264' WHEN contains(lower(encoder), 'handbrake') THEN 'handbrake' END AS trace FROM formats),
gaps AS (SELECT user_id, epoch_ms(date_trunc('second', ts)) / 1000 - lag(epoch_ms(date_trunc('second', ts)) / 1000) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts)) AS gap FROM events),
mids AS (SELECT user_id, count(*) AS n, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gs FROM gaps GROUP BY user_id),
outliers AS (SELECT user_id, n, gs, gs[len(gs) // 2 + 1] AS mid FROM mids),
keyframe AS (SELECT user_id AS submission_id, CASE WHEN n >= 3 AND mid > 0 THEN len(list_filter(gs, lambda x: x > 3 * mid OR x < mid / 3)) ELSE 0 END AS n_outliers FROM outliers),
near AS (SELECT a.dhash AS hash_a, b.dhash AS hash_b, bit_count(xor(a.dhash, b.dhash)) AS distance
  FROM (SELECT DISTINCT dhash FROM media_asset WHERE dhash IS NOT NULL) a JOIN (SELECT DISTINCT dhash FROM media_asset WHERE dhash IS NOT NULL) b ON a.dhash < b.dhash WHERE bit_count(xor(a.dhash, b.dhash)) <= 5),
dups AS (SELECT a.id, min((bit_count(xor(a.dhash, b.dhash)), b.created_at, b.id)) AS best FROM media_asset a JOIN media_asset b ON a.id <> b.id AND b.created_at < a.created_at AND bit_count(xor(a.dhash, b.dhash)) <= 5
  WHERE a.id IN (SELECT id FROM submission WHERE channel = 'dropbox') AND b.id IN (SELECT id FROM submission WHERE channel = 'dropbox') GROUP BY a.id),
flags AS (SELECT o_orderkey * 10 + k AS id, o_orderkey AS submission_id, ['LOW_CONFIDENCE','SUBMISSION_GAP','MANUAL_INTAKE'][CAST((o_orderkey + k) % 3 + 1 AS INT)] AS code,
    ['warning','warning','info'][CAST((o_orderkey + k) % 3 + 1 AS INT)] AS severity FROM orders, (VALUES (0), (1), (2), (3)) t(k) WHERE o_orderkey % 4 > 0 AND k <= o_orderkey % 4),
decision AS (SELECT event_id AS id, user_id AS enrollment_id, CASE WHEN event_id % 3 = 0 THEN 'system' ELSE 'staff' END AS actor, {_ST}[CAST(event_id % 9 + 1 AS INT)] AS from_state,
    {_ST}[CAST((event_id + event_id % 4) % 9 + 1 AS INT)] AS to_state, CASE WHEN event_id % 5 = 0 THEN 'note, "' || event_type || '"' END AS note, CAST(ts AS TIMESTAMP) AS "at", event_type AS snapshot FROM events),
entries AS (SELECT doc_id, lower(CASE WHEN doc_id % 23 = 0 THEN '/elsewhere/' ELSE '/Intake/' END || CASE WHEN doc_id % 19 = 0 THEN '' ELSE CAST(doc_id % 40000 AS VARCHAR) END || '/rec' || doc_id || '.mp4') AS path_lower,
    doc_id % 29 <> 0 AS is_file, sha256(text) AS content_hash FROM documents),
inbound AS (SELECT event_id AS id, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'P' || user_id || '@Example.com' ELSE 'p' || (event_id % 3000) || '@example.com' END AS from_addr,
    CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN sha256('m' || event_id) ELSE sha256('e' || event_id) END AS content_hash,
    ['pass','none','TempError','permerror','neutral'][CAST(event_id % 5 + 1 AS INT)] AS dkim, event_id % 4 <> 0 AS covered, 'd' || (event_id % 6) || '.example' AS d_domain, event_id % 6 = 0 AS has_image FROM events),
checks AS (
  SELECT e.id AS enrollment_id, 'DUPLICATE_ENROLLMENT_EMAIL' AS code, NOT EXISTS (SELECT 1 FROM participant q WHERE q.email = p.email AND q.id <> p.id) AS passed FROM enrollment e JOIN participant p ON p.id = e.participant_id WHERE p.email IS NOT NULL
  UNION ALL SELECT e.id, 'ALREADY_FUNDED', NOT EXISTS (SELECT 1 FROM enrollment f WHERE f.participant_id = e.participant_id AND f.casino = e.casino AND f.id <> e.id AND f.state IN ('funded','wager_submitted','wager_verified','closed')) FROM enrollment e
  UNION ALL SELECT e.id, 'RECIPIENT_MISMATCH', coalesce(p.email IS NULL OR v.to_addr IS NULL OR lower(v.to_addr) = lower(p.email), false) FROM enrollment e JOIN participant p ON p.id = e.participant_id JOIN email_evidence v ON v.submission_id = e.id
  UNION ALL SELECT e.id, 'SUBMISSION_TIMING', epoch_ms(s.received_at) - epoch_ms(e.created_at) >= 60000 FROM enrollment e JOIN submission s ON s.enrollment_id = e.id WHERE s.kind = 'signup_email'),
all_flags AS (
  SELECT run_id, 'ARITHMETIC_MISMATCH' AS code, 'high' AS severity, ordinal AS item FROM g1
  UNION ALL SELECT run_id, 'TIMESTAMP_ANOMALY', 'high', ordinal FROM times WHERE t > TIMESTAMP '1998-01-01 00:05:00'
  UNION ALL SELECT run_id, 'TIMESTAMP_ANOMALY', 'warning', NULL FROM g3
  UNION ALL SELECT DISTINCT run_id, 'LOW_CONFIDENCE', 'warning', NULL FROM ledger WHERE conf < 0.5
  UNION ALL SELECT run_id, 'WAGER_SHORTFALL', 'high', NULL FROM recon WHERE shortfall
  UNION ALL SELECT s.id, 'SUBMISSION_GAP', 'warning', NULL FROM submission s JOIN grants g USING (enrollment_id) WHERE abs(epoch_ms(s.received_at) - epoch_ms(g.sent_at)) > 14 * 86400000
  UNION ALL SELECT id, 'MANUAL_INTAKE', 'info', NULL FROM submission WHERE channel = 'manual_upload'
  UNION ALL SELECT s.id, 'OUT_OF_SEQUENCE', 'warning', NULL FROM submission s JOIN enrollment e ON e.id = s.enrollment_id WHERE kind = 'wager_recording' AND state <> 'funded'
  UNION ALL SELECT submission_id, 'ENCODER_MISMATCH', 'warning', NULL FROM traces WHERE channel = 'dropbox' AND trace IS NOT NULL
  UNION ALL SELECT submission_id, 'FRAME_DISCONTINUITY', 'warning', NULL FROM keyframe JOIN submission s ON s.id = submission_id AND s.channel = 'dropbox' WHERE n_outliers > 0
  UNION ALL SELECT id, 'DUPLICATE_MEDIA', 'high', NULL FROM dups
  UNION ALL SELECT run_id, 'SHARED_ROWS', 'high', NULL FROM shared),
search AS (SELECT s.id, s.kind, s.channel, s.received_at, s.content_hash, e.id AS enrollment_id, e.participant_id, e.casino, e.state FROM submission s JOIN enrollment e ON e.id = s.enrollment_id),
iso AS (SELECT 1)
"""


def oracle(sql: str, recursive: bool = False) -> str:
    """The query after the derived tables. A query may begin with further CTEs, before SELECT and after a comma."""
    return f"WITH {'RECURSIVE ' * recursive}{VIEWS.strip()}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
