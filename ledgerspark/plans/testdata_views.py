"""The domain's tables, derived from the test tables. The DuckDB queries derive them on their own, in oracles.py."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STATES = "array('invited','email_submitted','email_verified','funded','wager_submitted','wager_verified','closed','rejected','abandoned')"

#: Each reads test tables or views before it.
VIEWS = {
    "participant": """
        SELECT c_custkey AS id, c_name AS contact, CASE WHEN c_custkey % 10 <> 0 THEN concat('p', c_custkey % 1400, '@example.com') END AS email,
               TIMESTAMP '1991-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey % 1000 AS int)) AS created_at FROM customer""",
    "enrollment": f"""
        SELECT o_orderkey AS id, o_custkey AS participant_id, o_orderpriority AS casino, {STATES}[cast(o_orderkey % 9 AS int)] AS state,
               cast(o_orderdate AS timestamp) AS created_at FROM orders""",
    "grants": """
        SELECT o_orderkey AS enrollment_id, cast(o_totalprice AS decimal(12,2)) AS amount, cast(o_orderdate AS timestamp) + INTERVAL 3 DAYS AS sent_at,
               CASE WHEN o_orderkey % 2 = 0 THEN 'wire' END AS method FROM orders WHERE o_orderkey % 9 BETWEEN 3 AND 6 AND o_orderkey % 7 <> 0""",
    "submission": """
        SELECT o_orderkey AS id, o_orderkey AS enrollment_id, CASE WHEN o_custkey % 3 = 0 THEN 'signup_email' ELSE 'wager_recording' END AS kind,
               CASE WHEN o_custkey % 3 = 0 THEN 'email' WHEN o_custkey % 5 < 3 THEN 'dropbox' ELSE 'manual_upload' END AS channel,
               cast(o_orderdate AS timestamp) + make_dt_interval(cast(o_orderkey % 40 AS int)) AS received_at, o_orderkey AS media_asset_id,
               sha2(concat('m', o_orderkey), 256) AS content_hash FROM orders""",
    "media_hash": """
        SELECT vec_id, CASE WHEN vec_id % 20 = 1 THEN base ^ 5 ELSE base END AS dhash FROM (
          SELECT a.vec_id, aggregate(sequence(0, 62), 0L, (x, i) -> shiftleft(x, 1) | if(b.embedding[i] > b.embedding[i + 1], 1L, 0L)) AS base
          FROM embeddings a JOIN embeddings b ON b.vec_id = CASE WHEN a.vec_id % 20 = 1 THEN a.vec_id - 1 ELSE a.vec_id END)""",
    "media_asset": """
        SELECT s.id, s.content_hash AS blob_key, s.content_hash, cast(floor(o_totalprice) AS bigint) AS bytes, h.dhash, s.received_at AS created_at,
               CASE WHEN s.id % 11 = 0 THEN s.received_at + INTERVAL 100 DAYS END AS deleted_at
        FROM submission s JOIN orders ON o_orderkey = s.id LEFT JOIN media_hash h ON h.vec_id = s.id
        UNION ALL SELECT -1 - p_partkey, sha2(concat('x', p_partkey), 256), sha2(concat('x', p_partkey), 256), cast(p_size AS bigint), NULL,
               TIMESTAMP '1995-01-01 00:00:00', NULL FROM part""",
    "email_evidence": """
        SELECT p.id AS submission_id, CASE WHEN id % 4 = 0 THEN 'A' ELSE 'B' END AS tier, element_at(array('pass','fail','no_signature','error'), cast(id % 4 + 1 AS int)) AS dkim_result,
               concat('sel', id % 3) AS selector, concat('d', id % 6, '.example') AS d_domain,
               CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN upper(p.email) WHEN id % 5 = 2 THEN 'someone@else.example' ELSE p.email END AS to_addr
        FROM (SELECT s.id, p.email FROM submission s JOIN enrollment e ON e.id = s.enrollment_id JOIN participant p ON p.id = e.participant_id WHERE kind = 'signup_email') p""",
    "dkim_allowed_signer": """
        SELECT DISTINCT o_orderpriority AS casino, concat('d', o_orderkey % 6, '.example') AS domain FROM orders WHERE o_orderkey % 6 < 3""",
    "extraction_run": """
        SELECT o_orderkey * 10 + k AS id, o_orderkey AS submission_id, 'succeeded' AS status, cast(o_orderdate AS timestamp) + make_dt_interval(40 + k) AS started_at,
               100 + o_orderkey % 50 AS input_tokens, 10 * k AS output_tokens
        FROM orders LATERAL VIEW explode(sequence(0, cast(o_orderkey % 2 AS int))) t AS k""",
    "ledger_line": """
        SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos,
               l_quantity AS amount, l_shipdate, l_returnflag, l_partkey, l_suppkey, l_linenumber, l_discount FROM lineitem""",
    "frame_reads": """
        WITH b AS (SELECT *, 1000 - sum(amount) OVER (PARTITION BY run_id ORDER BY pos) + if(l_partkey % 20 = 0, 7, 0) AS balance_after FROM ledger_line),
        f AS (SELECT *, cast(pos AS int) DIV 2 + k AS frame_index FROM b LATERAL VIEW explode(sequence(0, 1)) t AS k)
        SELECT run_id, frame_index, frame_index * 1.5D AS frame_ts, cast(pos AS int) AS row_pos,
               CASE WHEN l_suppkey % 17 = 0 AND k = 1 THEN NULL WHEN l_linenumber % 7 = 6 THEN 'soon' ELSE date_format(l_shipdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") END AS timestamp,
               CASE l_returnflag WHEN 'A' THEN 'Bet' WHEN 'R' THEN 'wagered' WHEN 'N' THEN 'deposit' END AS type,
               CASE WHEN l_suppkey % 17 = 0 AND k = 1 THEN NULL ELSE cast(amount AS double) END AS amount, cast(balance_after AS double) AS balance_after,
               CASE WHEN l_linenumber % 5 <> 0 THEN 0.45D + abs(l_discount) + 0.01D * k END AS confidence
        FROM f""",
    "shared_line": """
        SELECT l_orderkey AS run_id, o_custkey AS participant_id, concat(date_format(l_shipdate, 'yyyy-MM'), '|', l_returnflag, '|', cast(l_quantity AS int)) AS row_key
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "container_format": """
        SELECT s.id AS submission_id, s.channel, concat(element_at(array('Lavf58.2','WhatsApp 2','HandBrake (libx264)','CoreMedia','x264 LIBX264'), cast(s.id % 5 + 1 AS int)), '') AS encoder
        FROM submission s WHERE s.id % 13 <> 0""",
    "keyframes": """
        SELECT user_id AS submission_id, sort_array(collect_list(cast(unix_seconds(cast(ts AS timestamp)) AS double))) AS times FROM events GROUP BY user_id""",
    "frame_hashes": """
        SELECT label AS run_id, cast(vec_id AS int) AS frame_index, dhash FROM media_hash JOIN (SELECT vec_id AS v, label FROM embeddings) ON v = vec_id""",
    "decision": """
        SELECT event_id AS id, user_id AS enrollment_id, CASE WHEN event_id % 3 = 0 THEN 'system' ELSE 'staff' END AS actor, s[cast(event_id % 9 AS int)] AS from_state,
               s[cast((event_id + event_id % 4) % 9 AS int)] AS to_state, CASE WHEN event_id % 5 = 0 THEN concat('note, "', event_type, '"') END AS note,
               cast(ts AS timestamp) AS at, event_type AS snapshot FROM (SELECT *, """ + STATES + """ AS s FROM events)""",
    "integrity_flag": """
        SELECT o_orderkey * 10 + k AS id, o_orderkey AS submission_id, element_at(array('LOW_CONFIDENCE','SUBMISSION_GAP','MANUAL_INTAKE'), cast((o_orderkey + k) % 3 + 1 AS int)) AS code,
               element_at(array('warning','warning','info'), cast((o_orderkey + k) % 3 + 1 AS int)) AS severity
        FROM orders LATERAL VIEW explode(sequence(0, cast(o_orderkey % 4 AS int))) t AS k WHERE o_orderkey % 4 > 0""",
    "folder_entries": """
        SELECT doc_id, lower(concat(CASE WHEN doc_id % 23 = 0 THEN '/elsewhere/' ELSE '/Intake/' END, CASE WHEN doc_id % 19 = 0 THEN '' ELSE cast(doc_id % 40000 AS string) END, '/rec', doc_id, '.mp4')) AS path_lower,
               doc_id % 29 <> 0 AS is_file, sha2(text, 256) AS content_hash FROM documents""",
    "mail_message": """
        SELECT doc_id AS id, cast(concat('From: "P, ', lang, '" <P', doc_id, '@Example.com>\\r\\nMIME-Version: 1.0\\r\\nContent-Type: ',
                 CASE WHEN doc_id % 4 = 3 THEN concat('text/plain\\r\\n\\r\\n', original) ELSE concat(
                   'multipart/mixed;\\r\\n boundary="of: ', doc_id, '"\\r\\n\\r\\nno part\\r\\n', mark, '\\r\\n\\r\\nsee below\\n--\\nP\\r\\n',
                   CASE WHEN doc_id % 5 = 0 THEN concat(mark, '\\r\\nContent-Type: multipart/related; boundary=in\\r\\n\\r\\n--in\\r\\nContent-Type: Image/PNG\\r\\n\\r\\n') ELSE '' END,
                   mark, '\\r\\nContent-Type: message/rfc822; name=original.eml\\r\\nContent-Transfer-Encoding: ',
                   CASE doc_id % 4 WHEN 0 THEN '8bit' WHEN 1 THEN 'base64' ELSE 'Quoted-Printable' END, '\\r\\n\\r\\n',
                   CASE doc_id % 4 WHEN 0 THEN original WHEN 1 THEN regexp_replace(base64(cast(original AS binary)), '(.{{76}})', '$1\\r\\n') ELSE regexp_replace(regexp_replace(hex(cast(original AS binary)), '(..)', '=$1'), '((?:...){{1,20}})', '$1=\\r\\n') END,
                   '\\r\\n', mark, '--\\r\\nno part either') END) AS binary) AS content
        FROM (SELECT doc_id, lang, concat('--of: ', doc_id) AS mark,
                concat('From: Casino <No-Reply@casino', doc_id % 7, '.example>\\r\\nTo: p', doc_id, '@x.example\\r\\nSubject: about\\r\\n its text\\r\\n\\r\\n', coalesce(text, '')) AS original FROM documents)""",
    "signed_message": """
        SELECT doc_id AS id, cast(concat(CASE WHEN doc_id % 8 > 0 THEN concat('DKIM-Signature: v=1; a=', CASE WHEN doc_id % 8 = 1 THEN 'ed25519-sha256' ELSE 'rsa-sha256' END, '; d=Casino.example;\\r\\n\\ts=s', doc_id % 8,
                 CASE WHEN doc_id % 8 = 2 THEN '' ELSE '; h=From : To' END, CASE WHEN doc_id % 8 = 7 THEN concat('; l=', octet_length(body) + 2) ELSE '' END,
                 '; bh=', base64(unhex(sha2(concat(body, CASE WHEN doc_id % 8 = 5 THEN '!' ELSE '' END, '\\r\\n'), 256))), '; b=', base64(repeat('x', 128)), '\\r\\n') ELSE '' END,
                 'From: no-reply@casino.example\\r\\nTo: p@x.example\\r\\n\\r\\n', body, '\\r\\n\\r\\n') AS binary) AS original
        FROM (SELECT doc_id, concat(trim(regexp_replace(coalesce(text, ''), '\\\\s+', ' ')), '.') AS body FROM documents)""",
    "inbound_email": """
        SELECT event_id AS id, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 2 = 0 THEN concat('P', user_id, '@Example.com') ELSE concat('p', event_id % 3000, '@example.com') END AS from_addr,
               CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN sha2(concat('m', event_id), 256) ELSE sha2(concat('e', event_id), 256) END AS content_hash,
               element_at(array('pass','none','TempError','permerror','neutral'), cast(event_id % 5 + 1 AS int)) AS dkim,
               CASE WHEN event_id % 4 = 0 THEN 'from:to' ELSE 'From : To:Subject: date:' END AS signed_headers, concat('d', event_id % 6, '.example') AS d_domain,
               event_id % 6 = 0 AS has_image FROM events""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Domain:
    """The domain's tables of one data folder, as plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.known:
            return self.known[name]
        if name in VIEWS:


            needs = {n: getattr(self, n) for n in (*TABLES, *VIEWS) if n != name and re.search(rf"\b(?:FROM|JOIN) {n}\b", VIEWS[name])}
            self.known[name] = self.spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in needs else m[0], VIEWS[name]), **needs)
        elif name in TABLES:
            self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            raise AttributeError(name)
        return self.known[name]
