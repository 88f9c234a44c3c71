"""Every registered query of the library and its DuckDB counterpart.

Queries return scalar columns (nested results as JSON text or as counts and digests of their parts), so that both
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime
from ..functions.frames import difference_hash
from ..functions.values import hamming, iso_millis, lenient_timestamp, plain_number, stored_hash
from ..operators import evidence, ledger, lifecycle, media, people, records, signatures
from ..operators.lineage import Written, cut, shared_folder
from ..sources.mail import parse_messages
from ..sources.tables import Tables
from . import extraction, search
from .oracles import oracle
from .process import Extraction
from .testdata_views import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}
#: The time at which time-dependent checks are made here.
NOW = datetime(1998, 1, 1)
#: A public key of the right form that nobody can sign with: modulus 2**1023 + 1, exponent 65537.
DEMO_KEY = base64.b64encode(bytes.fromhex("308189028181008" + "0" * 254 + "10203010001")).decode()


def query(covers: str, sql: str | None, recursive: bool = False):
    """Registers a function of the domain's tables, under its name."""

    def register(plan: Callable[[Domain], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(Domain(spark, sf_dir))
        COVERS[plan.__name__] = covers
        if sql:
            ORACLES[plan.__name__] = oracle(sql, recursive)
        return plan

    return register


def stitched(d: Domain) -> DataFrame:
    return ledger.stitch(d.frame_reads)


def recordings(d: Domain) -> DataFrame:
    return d.submission.where("kind = 'wager_recording'").select(F.col("id").alias("run_id"), "enrollment_id")


@query("A1 A2 A4 E5 G4 J1 J11 W1 R28", "SELECT * FROM recon")
def extraction_reconciliation(d):
    return ledger.reconcile(recordings(d), stitched(d), d.grants)


@query("A4 F12 T4 Q1-Q3 row key", "SELECT run_id, row_key, ts AS timestamp, kind AS type, amount, balance AS balance_after, frame_ts AS source_frame_ts, conf AS confidence, ordinal FROM ledger")
def stitched_rows(d):
    return stitched(d)


@query("G1 W1", "SELECT run_id, 'ARITHMETIC_MISMATCH' AS code, 'high' AS severity, ordinal AS item FROM g1")
def arithmetic_flags(d):
    return ledger.arithmetic_flags(stitched(d))


@query("G2 G3 W2 A11 Q9", "SELECT * FROM all_flags WHERE code = 'TIMESTAMP_ANOMALY'")
def timestamp_flags(d):
    rows = stitched(d)
    return ledger.future_flags(rows, NOW).unionByName(ledger.order_flags(rows))


@query("G5 A2", "SELECT run_id, count(*) FILTER (conf < 0.5) AS n_low, count(*) AS n_rows FROM ledger GROUP BY run_id HAVING count(*) FILTER (conf < 0.5) > 0")
def low_confidence_runs(d):
    return stitched(d).groupBy("run_id").agg(F.count_if(F.col("confidence") < ledger.LOW_CONFIDENCE).alias("n_low"), F.count(F.lit(1)).alias("n_rows")).where("n_low > 0")


@query("G1-G12 union of all checks, set operation of flag arrays", "SELECT code, severity, count(*) AS n, count(DISTINCT run_id) AS n_runs, CAST(sum(coalesce(item, 0)) AS BIGINT) AS items FROM all_flags GROUP BY ALL")
def flags_by_code(d):
    flags = extraction.all_flags(d, stitched(d), NOW)
    return flags.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("n_runs"), F.sum(F.coalesce("item", F.lit(0))).alias("items"))


@query("G6", "SELECT run_id, code, severity, item FROM all_flags WHERE code = 'SUBMISSION_GAP'")
def submission_gap_flags(d):
    return evidence.gap_flags(d.submission, d.grants)


@query("G11 G12", "SELECT run_id, code, severity, item FROM all_flags WHERE code IN ('MANUAL_INTAKE', 'OUT_OF_SEQUENCE')")
def intake_flags(d):
    return evidence.intake_flags(d.submission).unionByName(evidence.sequence_flags(d.submission, d.enrollment))


@query("G7 F10", "SELECT submission_id, channel, trace FROM traces")
def encoder_traces(d):
    return d.container_format.select("submission_id", "channel", media.encoder_trace(F.col("encoder")).alias("trace"))


@query("G8 A5 A6 W3 S14", "SELECT submission_id, n_outliers, CAST(mid AS DOUBLE) AS middle FROM keyframe JOIN outliers ON user_id = submission_id")
def keyframe_gaps(d):
    times = F.col("times")
    return d.keyframes.select("submission_id", media.keyframe_outliers(times).cast("long").alias("n_outliers"), media.upper_median(media.intervals(times)).alias("middle"))


@query("J5 Hamming join", "SELECT hash_a, hash_b, CAST(distance AS INT) AS distance FROM near")
def near_duplicate_hashes(d):
    return media.near_pairs(d.media_asset)


@query("G9 J5 R24 Q6", "SELECT id, best[1] AS distance, best[3] AS match_id FROM dups")
def duplicate_media(d):
    used = d.submission.where("channel = 'dropbox'").select(F.col("media_asset_id").alias("id"))
    assets = d.media_asset.join(used, "id").select("id", "dhash", F.col("created_at").alias("stored_at"), F.col("created_at").alias("checked_at"))
    return media.duplicate_media(assets)


@query("G10 J6 A3 R25 T2 Q7", "SELECT run_id, CAST(n AS BIGINT) AS n_matches, CAST(least(n, 50) AS BIGINT) AS n_capped, CAST(least(p, 50) AS BIGINT) AS n_participants FROM shared")
def shared_rows(d):
    return evidence.shared_rows(d.shared_line)


_FRAMES = """
, frames AS (SELECT label AS run_id, CAST(m.vec_id AS INT) AS frame_index, dhash, row_number() OVER (PARTITION BY label ORDER BY m.vec_id) AS k FROM media_hash m JOIN embeddings e ON e.vec_id = m.vec_id),
walk AS (
  SELECT run_id, frame_index, dhash, k, dhash AS held, true AS kept FROM frames WHERE k = 1
  UNION ALL SELECT f.run_id, f.frame_index, f.dhash, f.k, CASE WHEN bit_count(xor(w.held, f.dhash)) <= {bits} THEN w.held ELSE f.dhash END, bit_count(xor(w.held, f.dhash)) > {bits}
  FROM walk w JOIN frames f ON f.run_id = w.run_id AND f.k = w.k + 1)
SELECT run_id, frame_index, dhash FROM walk WHERE kept"""


@query("W4 fold", _FRAMES.format(bits=4), recursive=True)
def deduped_frames(d):
    return media.dedupe_frames(d.frame_hashes)


@query("W4 fold, a threshold that most frames are within", _FRAMES.format(bits=24), recursive=True)
def deduped_frames_wide(d):
    return media.dedupe_frames(d.frame_hashes, 24)


@query("§2.10 bit functions", "SELECT vec_id, dhash, bit_count(xor(dhash, 255)) AS distance, lower(printf('%x', dhash)) AS hexed FROM media_hash")
def hash_bits(d):
    return d.media_hash.select("vec_id", "dhash", hamming(F.col("dhash"), F.lit(255).cast("long")).alias("distance"), F.lower(F.hex("dhash")).alias("hexed"))


@query("C1-C4 J7 J8 R17-R19 W7 F4 F5", "SELECT * FROM checks")
def prefunding_checks(d):
    return evidence.prefunding_checks(d.enrollment, d.enrollment, d.participant, d.submission, d.email_evidence)


@query("R5", "SELECT e.id, e.casino, e.created_at, string_agg(c.code || '=' || c.passed, ';' ORDER BY c.code) AS checks FROM enrollment e JOIN checks c ON c.enrollment_id = e.id WHERE state = 'email_verified' GROUP BY ALL")
def funding_queue(d):
    shown = F.array_join(F.transform("checks", lambda c: F.concat(c["code"], F.lit("="), c["passed"].cast("string"))), ";")
    return search.funding_queue(d).select("id", "casino", "created_at", shown.alias("checks"))


_SEARCH = ["id", "kind", "channel", "received_at", "content_hash", "enrollment_id", "participant_id", "casino", "state"]


@query("R1 F1-F3 J3 J4 T1", "SELECT * FROM search WHERE casino = '1-URGENT' AND state = 'invited' AND received_at BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' AND id IN (SELECT submission_id FROM flags WHERE code = 'LOW_CONFIDENCE')")
def submission_search(d):
    return search.search_submissions(d, casino="1-URGENT", state="invited", flag="LOW_CONFIDENCE", since=datetime(1994, 1, 1), until=datetime(1996, 12, 31)).select(*_SEARCH)


@query("R1 without filters, empty values", "SELECT * FROM search WHERE participant_id = 7")
def submission_search_by_participant(d):
    return search.search_submissions(d, participant_id=7, flag="").select(*_SEARCH)


@query("R1 J1 J2 nested relations, S11", "SELECT s.id, m.bytes, m.deleted_at IS NOT NULL AS purged, v.tier, coalesce((SELECT string_agg(code, ';' ORDER BY id) FROM flags f WHERE f.submission_id = s.id), '') AS flags FROM search s JOIN media_asset m ON m.id = s.id LEFT JOIN email_evidence v ON v.submission_id = s.id WHERE s.state = 'funded'")
def submission_search_relations(d):
    rows = search.search_with_relations(d, state="funded")
    flags = F.array_join(F.transform("flags", lambda f: f["code"]), ";")
    return rows.select("id", "media.bytes", F.col("media.deleted_at").isNotNull().alias("purged"), "email_evidence.tier", flags.alias("flags"))


@query("R2", "SELECT s.id, r.id AS run_id, r.status, coalesce(l.n, 0) AS n_rows FROM submission s JOIN extraction_run r ON r.submission_id = s.id LEFT JOIN (SELECT run_id, count(*) AS n FROM ledger GROUP BY run_id) l ON l.run_id = s.id")
def submission_detail(d):
    rows = search.submission_detail(d, None, stitched(d)).select("id", F.inline("runs").alias("run_id", "status", "rows"))
    return rows.select("id", "run_id", "status", F.size("rows").cast("long").alias("n_rows"))


@query("R3", "SELECT s.id, CASE WHEN m.deleted_at IS NULL THEN 200 ELSE 410 END AS status, CASE WHEN m.deleted_at IS NULL THEN m.content_hash END AS blob_key, m.deleted_at IS NULL AS audited FROM submission s JOIN media_asset m ON m.id = s.id")
def media_lookup(d):
    found, audit = search.media_lookup(d, None, "staff", NOW)
    targets = audit.select(F.col("target").cast("long").alias("id"), F.lit(True).alias("audited"))
    return found.join(targets, "id", "left").withColumn("audited", F.coalesce("audited", F.lit(False)))


@query("R4 J2", "SELECT e.id, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY received_at, id) FROM submission s WHERE s.enrollment_id = e.id) AS submissions, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY \"at\", id) FROM decision x WHERE x.enrollment_id = e.id), '') AS decisions FROM enrollment e")
def enrollment_detail(d):
    ids = lambda c: F.array_join(F.transform(c, lambda r: r["id"].cast("string")), ",").alias(c)
    return search.enrollment_detail(d).select("id", ids("submissions"), ids("decisions"))


@query("R6", "SELECT e.id, coalesce((SELECT string_agg(CAST(r.id AS VARCHAR), ',' ORDER BY r.started_at DESC, r.id DESC) FROM submission s JOIN extraction_run r ON r.submission_id = s.id WHERE s.enrollment_id = e.id AND s.kind = 'wager_recording'), '') AS runs FROM enrollment e WHERE state = 'wager_submitted'")
def wager_queue(d):
    runs = F.flatten(F.transform("submissions", lambda s: F.transform(s["runs"], lambda r: r["id"].cast("string"))))
    return search.wager_queue(d).select("id", F.array_join(runs, ",").alias("runs"))


@query("R7", 'SELECT id, actor, from_state, to_state, "at" FROM decision')
def decision_log(d):
    return search.decision_log(d).select("id", "actor", "from_state", "to_state", "at")


@query("R8", "SELECT casino, domain FROM allowlist")
def signer_allowlist(d):
    return d.dkim_allowed_signer.orderBy("casino", "domain")


@query("R9", "SELECT id, contact, email, created_at FROM participant WHERE email = 'p37@example.com'")
def participant_list(d):
    return search.participant_list(d, email="p37@example.com")


@query("R10", "SELECT p.id, count(DISTINCT e.id) AS n_enrollments, count(DISTINCT s.id) AS n_submissions, count(f.id) AS n_flags FROM participant p LEFT JOIN enrollment e ON e.participant_id = p.id LEFT JOIN submission s ON s.enrollment_id = e.id LEFT JOIN flags f ON f.submission_id = s.id GROUP BY p.id")
def participant_history(d):
    subs = F.flatten(F.transform("enrollments", lambda e: e["submissions"]))
    return search.participant_history(d).select(
        "id", F.size("enrollments").cast("long").alias("n_enrollments"), F.size(subs).cast("long").alias("n_submissions"), F.size(F.flatten(F.transform(subs, lambda s: s["flags"]))).cast("long").alias("n_flags")
    )


@query("R11", "SELECT r.id, r.submission_id, count(l.run_id) AS n_rows, CAST(coalesce(sum(l.ordinal), 0) AS BIGINT) AS ordinals FROM extraction_run r LEFT JOIN ledger l ON l.run_id = r.submission_id GROUP BY ALL")
def extraction_runs(d):
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["ordinal"])
    return search.extraction_runs(d, stitched(d)).select("id", "submission_id", F.size("rows").cast("long").alias("n_rows"), total.alias("ordinals"))


_CSV = """
, f AS (SELECT submission_id, string_agg(code, ';' ORDER BY id) AS fl FROM flags GROUP BY submission_id)
SELECT s.received_at, s.id, concat_ws(',', s.id, s.participant_id, p.contact, s.enrollment_id, s.casino, s.state, s.kind, s.channel,
  strftime(s.received_at, '%Y-%m-%dT%H:%M:%S.%gZ'), s.content_hash, coalesce(v.tier, ''), coalesce(v.dkim_result, ''), coalesce(fl, '')) AS line
FROM search s JOIN participant p ON p.id = s.participant_id LEFT JOIN email_evidence v ON v.submission_id = s.id LEFT JOIN f ON f.submission_id = s.id
WHERE s.received_at >= TIMESTAMP '1995-01-01'"""


@query("R12 S9 A10 Q8 Q13 Q14", _CSV)
def submissions_csv(d):
    return search.submissions_csv(d, since=datetime(1995, 1, 1))


_PAYLOAD = """'{"enrollmentId":"' || enrollment_id || '","actor":"' || actor || '","fromState":"' || from_state || '","toState":"' || to_state || '","note":' ||
  coalesce('"' || replace(note, '"', chr(92) || '"') || '"', 'null') || ',"at":"' || strftime("at", '%Y-%m-%dT%H:%M:%S.%gZ') || '","snapshot":"' || snapshot || '"}'"""
_CHAIN = f"""
, numbered AS (SELECT *, {_PAYLOAD} AS body, row_number() OVER (PARTITION BY enrollment_id ORDER BY "at", id) AS k FROM decision),
chain AS (
  SELECT enrollment_id, id, k, CAST(NULL AS VARCHAR) AS prev_hash, sha256('{{"payload":' || body || ',"prevHash":null}}') AS hash FROM numbered WHERE k = 1
  UNION ALL SELECT n.enrollment_id, n.id, n.k, c.hash, sha256('{{"payload":' || n.body || ',"prevHash":"' || c.hash || '"}}') FROM chain c JOIN numbered n ON n.enrollment_id = c.enrollment_id AND n.k = c.k + 1)
"""


@query("W6 D2 Q11", _CHAIN + "SELECT enrollment_id, id, prev_hash, hash FROM chain", recursive=True)
def decision_chain(d):
    return lifecycle.build_chain(d.decision).select("enrollment_id", "id", "prev_hash", "hash")


@query("W6 verification (extension), of a log in which notes and hashes were changed", """SELECT enrollment_id, id, coalesce(lag(id) OVER (PARTITION BY enrollment_id ORDER BY "at", id) % 50, 0) <> 23 AS linked, id % 50 NOT IN (7, 23) AS intact FROM decision""")
def decision_chain_check(d):
    built = lifecycle.build_chain(d.decision)
    note, hash_ = F.when(F.col("id") % 50 == 7, F.concat(F.coalesce("note", F.lit("")), F.lit("!"))).otherwise(F.col("note")), F.when(F.col("id") % 50 == 23, F.sha2("hash", 256)).otherwise(F.col("hash"))
    return lifecycle.verify_chain(built.withColumns({"note": note, "hash": hash_}))


@query("R13 S9", _CHAIN + """SELECT d."at", d.id, concat_ws(',', d.id, d.enrollment_id, d.actor, d.from_state, d.to_state, strftime(d."at", '%Y-%m-%dT%H:%M:%S.%gZ'),
  coalesce('"' || replace(d.note, '"', '""') || '"', ''), c.hash, coalesce(c.prev_hash, '')) AS line FROM decision d JOIN chain c ON c.id = d.id""", recursive=True)
def decisions_csv(d):
    return search.decisions_csv(lifecycle.build_chain(d.decision))


@query("R14 F11", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'admin' ELSE 'reviewer' END AS role, TIMESTAMP '1990-01-01' AS created_at FROM supplier")
def staff_list(d):
    return search.staff_list(_staff(d))


@query("R33", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey = 17")
def staff_by_token(d):
    return search.staff_by_token(_staff(d), "token-17").select("id", "name")


def _staff(d):
    return d.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "admin").otherwise("reviewer").alias("role"),
        F.to_timestamp(F.lit("1990-01-01")).alias("created_at"), F.sha2(F.concat(F.lit("token-"), F.col("s_suppkey").cast("string")), 256).alias("token_hash"),
    )


@query("R15 D3", "SELECT s.enrollment_id, count(*) AS n_artifacts, count(v.tier) AS n_dkim, CAST(coalesce(sum((SELECT count(*) FROM flags f WHERE f.submission_id = s.id)), 0) AS BIGINT) AS n_flags FROM submission s LEFT JOIN email_evidence v ON v.submission_id = s.id GROUP BY s.enrollment_id")
def evidence_snapshots(d):
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("artifacts", "dkim", "flags")]
    return lifecycle.snapshots(d.submission, d.email_evidence, d.integrity_flag).select("enrollment_id", *sizes)


@query("R16 W8", 'SELECT enrollment_id, arg_max(id, ("at", id)) AS id, arg_max(to_state, ("at", id)) AS to_state FROM decision GROUP BY enrollment_id')
def last_decisions(d):
    return lifecycle.latest(d.decision, "enrollment_id", "at", "id", "id", "to_state")


@query("W5", "SELECT submission_id, arg_max(id, (started_at, id)) AS id, 'succeeded' AS status FROM extraction_run GROUP BY submission_id")
def latest_runs(d):
    return search.latest_runs(d)


@query("W7", "SELECT enrollment_id, arg_min(id, (received_at, id)) AS id, min(received_at) AS received_at FROM submission WHERE kind = 'signup_email' GROUP BY enrollment_id")
def first_signups(d):
    return lifecycle.earliest(d.submission.where("kind = 'signup_email'"), "enrollment_id", "received_at", "id", "id", "received_at")


@query("D1 Q10", f"""SELECT from_state, to_state, count(*) AS n, CASE WHEN to_state IN ('closed','rejected','abandoned') THEN CASE WHEN from_state IN ('closed','rejected','abandoned') THEN 'already_terminal' ELSE 'legal' END
  WHEN (from_state, to_state) IN (('invited','email_submitted'),('email_submitted','email_verified'),('email_verified','funded'),('funded','wager_submitted'),('wager_submitted','wager_verified')) THEN 'legal' ELSE 'illegal' END AS outcome
  FROM decision GROUP BY from_state, to_state""")
def transitions(d):
    outcome = lifecycle.transition_outcome(F.col("from_state"), F.col("to_state")).alias("outcome")
    return d.decision.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n")).select("from_state", "to_state", "n", outcome)


_LEGAL = """(CASE WHEN {to} IN ('closed','rejected','abandoned') THEN {now} NOT IN ('closed','rejected','abandoned')
  ELSE ({now}, {to}) IN (('invited','email_submitted'),('email_submitted','email_verified'),('email_verified','funded'),('funded','wager_submitted'),('wager_submitted','wager_verified')) END)"""


@query("D1 applied in order, §2.12 state per key", f"""
, asked AS (SELECT id, enrollment_id, to_state, row_number() OVER (PARTITION BY enrollment_id ORDER BY "at", id) AS k FROM decision WHERE enrollment_id IN (SELECT id FROM enrollment)),
fold AS (
  SELECT a.*, e.state AS from_state, CASE WHEN {_LEGAL.format(now="e.state", to="to_state")} THEN to_state ELSE e.state END AS state FROM asked a JOIN enrollment e ON e.id = enrollment_id WHERE k = 1
  UNION ALL SELECT a.*, f.state, CASE WHEN {_LEGAL.format(now="f.state", to="a.to_state")} THEN a.to_state ELSE f.state END FROM fold f JOIN asked a ON a.enrollment_id = f.enrollment_id AND a.k = f.k + 1)
SELECT enrollment_id, id, from_state, to_state, CASE WHEN {_LEGAL.format(now="from_state", to="to_state")} THEN 'legal'
  WHEN to_state IN ('closed','rejected','abandoned') THEN 'already_terminal' ELSE 'illegal' END AS outcome FROM fold""", recursive=True)
def applied_transitions(d):
    known = d.decision.join(d.enrollment.select(F.col("id").alias("enrollment_id")), "enrollment_id", "left_semi")
    return lifecycle.apply_transitions(known, d.enrollment)


@query("R26 R27 D4 A8 F6 Q15", """SELECT m.id, CASE WHEN s.id IS NOT NULL AND epoch_ms(TIMESTAMP '1998-01-01') - epoch_ms(m.created_at) >= CAST(86400000 AS BIGINT) *
  CASE WHEN s.kind = 'signup_email' AND e.state IN ('funded','wager_submitted','wager_verified','closed') THEN 180 ELSE 90 END THEN 'deleted' ELSE 'skipped' END AS decision
  FROM media_asset m LEFT JOIN submission s ON s.media_asset_id = m.id LEFT JOIN enrollment e ON e.id = s.enrollment_id WHERE m.deleted_at IS NULL""".replace("s.media_asset_id", "s.id"))
def retention_decisions(d):
    return evidence.retention(d.media_asset, d.submission, d.enrollment, NOW)


@query("D5 A9", "SELECT CAST(sum(bytes) AS BIGINT) AS used_bytes, sum(bytes) / 2000000000 >= 0.9 AS warned FROM media_asset")
def storage_quota(d):
    return evidence.quota(d.media_asset, 2_000_000_000)


@query("D5 S10 warnings of the quota", "SELECT 'system' AS actor, 'dropbox_quota_warning' AS action, sum(bytes) || '/2000000' AS target FROM media_asset HAVING sum(bytes) / 2000000 >= 0.9")
def quota_warnings(d):
    return evidence.quota_audit(evidence.quota(d.media_asset, 2_000_000), 2_000_000)


@query("S10 R11 D3 life of an extraction run", """SELECT m.id AS submission_id, CASE WHEN m.deleted_at IS NULL THEN 'succeeded' ELSE 'failed' END AS status,
  CASE WHEN m.deleted_at IS NOT NULL THEN 'no content ' || m.content_hash END AS error, CASE WHEN m.deleted_at IS NULL THEN t.i END AS input_tokens, CASE WHEN m.deleted_at IS NULL THEN t.o END AS output_tokens,
  CASE WHEN m.deleted_at IS NULL THEN round((t.i * 3.0 + t.o * 15.0) / 1000000, 4) END AS cost_usd, sha256(m.id || '|v1|' || epoch_us(s.received_at)) AS id
  FROM media_asset m JOIN submission s ON s.id = m.id JOIN (SELECT submission_id, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o FROM extraction_run GROUP BY 1) t ON t.submission_id = m.id
  WHERE s.kind = 'wager_recording'""")
def run_outcomes(d):
    runs = records.begin_runs(d.submission.where("kind = 'wager_recording'").withColumn("started_at", F.col("received_at")), "v1", "reader")
    there = d.media_asset.where("deleted_at is null").select("content_hash", F.lit(True).alias("_there"))
    tried = runs.select("id", "submission_id", "content_hash", F.col("started_at").alias("finished_at")).join(token_totals(d), "submission_id").join(there, "content_hash", "left")
    outcomes = tried.withColumn("error", F.when(F.col("_there").isNull(), F.concat(F.lit("no content "), "content_hash")))
    return records.finish_runs(runs, outcomes, 3.0, 15.0).select("id", "submission_id", "status", "error", "input_tokens", "output_tokens", "cost_usd")


@query("A7 token sums", "SELECT submission_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM extraction_run GROUP BY submission_id")
def token_totals(d):
    return d.extraction_run.groupBy("submission_id").agg(F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"))


@query("D6 F8 J12 R23 R29 Q16 Q17", """
, p AS (SELECT *, CASE WHEN starts_with(path_lower, '/intake/') THEN nullif(split_part(substr(path_lower, 9), '/', 1), '') END AS eid FROM entries),
k AS (SELECT p.*, content_hash IN (SELECT sha256('m' || o_orderkey) FROM orders WHERE o_orderkey < 0) AS known, eid IN (SELECT CAST(id AS VARCHAR) FROM enrollment) AS good FROM p),
w AS (SELECT content_hash, min(path_lower) AS first_path FROM k WHERE is_file AND eid IS NOT NULL AND good GROUP BY content_hash)
SELECT doc_id, eid AS enrollment_id, CASE WHEN NOT is_file THEN 'ignored' WHEN eid IS NULL OR coalesce(first_path < path_lower, false) OR NOT good THEN 'skipped' ELSE 'ingested' END AS outcome,
  is_file AND eid IS NOT NULL AND (coalesce(first_path < path_lower, false) OR good) AS purge FROM k LEFT JOIN w USING (content_hash)""")
def ingest_outcomes(d):
    return evidence.classify_entries(d.folder_entries, d.media_asset, d.enrollment, "/intake/").select("doc_id", "enrollment_id", "outcome", "purge")


@query("G11 G12 S8 submissions of an ingest batch", """
, p AS (SELECT *, CASE WHEN starts_with(path_lower, '/intake/') THEN nullif(split_part(substr(path_lower, 9), '/', 1), '') END AS eid FROM entries),
k AS (SELECT p.*, e.state FROM p JOIN enrollment e ON CAST(e.id AS VARCHAR) = eid WHERE is_file),
w AS (SELECT *, min(path_lower) OVER (PARTITION BY content_hash) AS first_path FROM k),
o AS (SELECT *, min(path_lower) OVER (PARTITION BY eid) AS head FROM w WHERE first_path = path_lower)
SELECT doc_id, eid AS enrollment_id, 'manual_upload' AS channel, state = 'funded' AND head = path_lower AS advances,
  CASE WHEN state = 'funded' AND head = path_lower THEN 'MANUAL_INTAKE' ELSE 'MANUAL_INTAKE;OUT_OF_SEQUENCE' END AS flags FROM o""")
def ingest_submissions(d):
    entries = evidence.classify_entries(d.folder_entries, d.media_asset, d.enrollment, "/intake/")
    made = evidence.submissions_of(entries.where("outcome = 'ingested'"), d.enrollment, "manual_upload")
    return made.select("doc_id", "enrollment_id", "channel", "advances", F.array_join("flags", ";").alias("flags"))


@query("F8 path parsing", "SELECT page_id, nullif(split_part(substr(url, length('https://') + 1), '/', 1), '') AS host FROM pages WHERE starts_with(url, 'https://')")
def first_path_segments(d):
    secure = d.pages.where(F.col("url").startswith("https://"))
    return secure.select("page_id", evidence.enrollment_in_path(F.col("url"), "https://").alias("host"))


_ROUTED = """
, pend AS (SELECT lower(p.email) AS sender, count(e.id) AS pending, min(e.id) AS eid, arg_min(e.casino, e.id) AS casino FROM participant p
  LEFT JOIN enrollment e ON e.participant_id = p.id AND e.state IN ('invited','email_submitted') WHERE p.email IS NOT NULL GROUP BY 1),
i AS (SELECT inbound.*, sender, pending, eid, casino, content_hash IN (SELECT content_hash FROM media_asset) AS stored FROM inbound LEFT JOIN pend ON sender = lower(from_addr)),
fold AS (
  SELECT id, sender, content_hash, id = min(id) OVER (PARTITION BY sender) AND id = min(id) OVER (PARTITION BY content_hash) AS won FROM i WHERE pending = 1 AND content_hash IS NOT NULL AND NOT stored
  UNION ALL
  SELECT id, sender, content_hash, id = min(id) OVER (PARTITION BY sender) AND id = min(id) OVER (PARTITION BY content_hash)
  FROM (SELECT *, bool_or(won) OVER (PARTITION BY sender) AS s, bool_or(won) OVER (PARTITION BY content_hash) AS h FROM fold) WHERE NOT s AND NOT h),
won AS (SELECT * FROM fold WHERE won),
r AS (SELECT i.*, CASE WHEN from_addr IS NULL THEN 'no_from_address' WHEN pending IS NULL THEN 'no_participant' WHEN pending = 0 THEN 'no_pending_enrollment' WHEN pending > 1 THEN 'ambiguous_enrollment'
  WHEN i.id > ws.id THEN 'no_pending_enrollment' WHEN i.content_hash IS NULL THEN 'auto_replied' WHEN stored OR i.id > wh.id THEN 'duplicate' ELSE 'verified' END AS status
  FROM i LEFT JOIN won ws ON ws.sender = i.sender LEFT JOIN won wh ON wh.content_hash = i.content_hash)
"""


@query("E1-E4 J9 J10 R20-R22 A12 F7 Q12 Q19", _ROUTED + """SELECT id, status, CASE WHEN status IN ('auto_replied','duplicate','verified') THEN eid END AS enrollment_id,
  CASE WHEN status = 'auto_replied' THEN CASE WHEN has_image THEN 'D' ELSE 'C' END WHEN status = 'verified' THEN
    CASE WHEN dkim = 'pass' AND covered AND (casino, d_domain) IN (SELECT casino, domain FROM allowlist) THEN 'A' ELSE 'B' END END AS tier FROM r""", recursive=True)
def email_routing(d):
    return evidence.route_emails(d.inbound_email, d.participant, d.enrollment, d.media_asset, d.dkim_allowed_signer)


def _routed(d):
    return evidence.route_emails(d.inbound_email, d.participant, d.enrollment, d.media_asset, d.dkim_allowed_signer)


@query("E4 transitions, Q11 Q12", _ROUTED + """, f AS (SELECT *, id = min(id) OVER (PARTITION BY eid) AS first FROM r WHERE status IN ('auto_replied','verified'))
SELECT f.id, eid AS enrollment_id, 1 AS step, 'invited' AS from_state, 'email_submitted' AS to_state FROM f JOIN enrollment e ON e.id = eid WHERE first AND e.state = 'invited'
UNION ALL SELECT id, eid, 2, 'email_submitted', 'email_verified' FROM f WHERE status = 'verified'""", recursive=True)
def email_transitions(d):
    return evidence.email_transitions(_routed(d), d.enrollment)


@query("E4 audit of unmatched messages, S10", _ROUTED + "SELECT id, 'system' AS actor, 'inbound_email_unmatched:' || status AS action, coalesce(from_addr, 'unknown') AS target FROM r WHERE status LIKE 'no_%' OR status LIKE 'ambig%'", recursive=True)
def unmatched_emails(d):
    return evidence.unmatched_audit(_routed(d), d.inbound_email)


def _handled(d):
    """Routed messages with what their rows are made of, handled at NOW."""
    more = d.inbound_email.withColumns({"selector": F.lit(None).cast("string"), "original_from": F.lit(None).cast("string"), "to_addr": F.col("from_addr"), "subject": F.lit(None).cast("string")})
    more = more.withColumns({"public_key": F.lit(None).cast("string"), "l_tag_present": F.lit(False), "sent_at": F.lit(None).cast("timestamp"), "bytes": F.lit(0).cast("long"), "handled_at": F.lit(NOW).cast("timestamp")})
    return _routed(d).join(more, "id")


@query("S10 E1-E3 evidence rows of messages", _ROUTED + """SELECT content_hash AS submission_id, eid AS enrollment_id,
  CASE WHEN dkim = 'pass' AND covered AND (casino, d_domain) IN (SELECT casino, domain FROM allowlist) THEN 'A' ELSE 'B' END AS tier,
  CASE lower(dkim) WHEN 'pass' THEN 'pass' WHEN 'none' THEN 'no_signature' WHEN 'temperror' THEN 'error' WHEN 'permerror' THEN 'error' ELSE 'fail' END AS dkim_result,
  d_domain, covered AS covers_headers, from_addr AS to_addr, 'signup_email' AS kind, 'message/rfc822' AS mime FROM r WHERE status = 'verified'""", recursive=True)
def mail_evidence_rows(d):
    handled = cut(_handled(d))
    own = records.mail_submissions(handled).select(F.col("id").alias("submission_id"), "enrollment_id", "kind")
    media_rows = records.mail_media(handled).select(F.col("id").alias("submission_id"), "mime")
    shown = records.mail_evidence(handled).select("submission_id", "tier", "dkim_result", "d_domain", "covers_headers", "to_addr")
    return shown.join(own, "submission_id").join(media_rows, "submission_id")


@query("E4 D2 chained decisions of messages", _ROUTED + """
, f AS (SELECT *, id = min(id) OVER (PARTITION BY eid) AS first, CASE WHEN content_hash IS NULL THEN CASE WHEN has_image THEN 'D' ELSE 'C' END
    WHEN dkim = 'pass' AND covered AND (casino, d_domain) IN (SELECT casino, domain FROM allowlist) THEN 'A' ELSE 'B' END AS tier,
    CASE lower(dkim) WHEN 'pass' THEN 'pass' WHEN 'none' THEN 'no_signature' WHEN 'temperror' THEN 'error' WHEN 'permerror' THEN 'error' ELSE 'fail' END AS verdict
  FROM r WHERE status IN ('auto_replied','verified')),
moves AS (SELECT eid, 2 AS id, 'invited' AS a, 'email_submitted' AS b, 'message received, tier ' || tier AS note FROM f JOIN enrollment e ON e.id = eid WHERE first AND e.state = 'invited'
  UNION ALL SELECT eid, 3, 'email_submitted', 'email_verified', 'signature ' || verdict || ', tier ' || tier FROM f WHERE status = 'verified'),
texts AS (SELECT *, '{"payload":{"enrollmentId":"' || eid || '","actor":"system","fromState":"' || a || '","toState":"' || b || '","note":"' || note || '","at":"1998-01-01T00:00:00.000Z","snapshot":null},"prevHash":' AS body FROM moves),
first_link AS (SELECT *, sha256(body || 'null}') AS own FROM texts),
linked AS (SELECT y.eid, y.id, y.a, y.b, y.note, x.own AS prev_hash, CASE WHEN x.own IS NULL THEN y.own ELSE sha256(y.body || '"' || x.own || '"}') END AS hash FROM first_link y LEFT JOIN first_link x ON x.eid = y.eid AND x.id < y.id)
SELECT eid AS enrollment_id, CAST(id AS BIGINT) AS id, a AS from_state, b AS to_state, note, prev_hash, hash FROM linked""", recursive=True)
def mail_decisions(d):
    steps = records.numbered(records.mail_decisions(cut(_handled(d)), d.enrollment)).withColumn("snapshot", F.lit(None).cast("string"))
    return lifecycle.build_chain(steps).select("enrollment_id", "id", "from_state", "to_state", "note", "prev_hash", "hash")


def _published(d: Domain) -> Extraction:
    """All recordings of the test tables through the extraction job. A recording is JSON here: its frames, each with the rows read from it."""
    row = F.struct("row_pos", "timestamp", "type", "amount", "balance_after", "confidence")
    recordings_ = d.submission.where("kind = 'wager_recording'")
    reads = d.frame_reads.join(recordings_.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    frames = reads.groupBy("run_id", "frame_index").agg(F.min("frame_ts").alias("frame_ts"), F.collect_list(row).alias("rows"))
    whole = frames.groupBy("run_id").agg(F.collect_list(F.struct("frame_index", "frame_ts", "rows")).alias("frames"))
    contents = recordings_.join(whole, F.col("run_id") == F.col("id"), "left").select("content_hash", F.to_json(F.struct("id", "frames")).cast("binary").alias("content"))
    kind = f"id long, frames array<struct<frame_index: int, frame_ts: double, rows: {whole.schema['frames'].dataType.elementType['rows'].dataType.simpleString()}>>"
    parsed = lambda c: c.select("run_id", F.from_json(F.col("content").cast("string"), kind).alias("x"))

    def framed(c: DataFrame) -> DataFrame:
        each = parsed(c).select("run_id", F.inline("x.frames"))
        return each.select("run_id", "frame_index", "frame_ts", F.to_json(F.struct("rows")).cast("binary").alias("image"), F.xxhash64("run_id", "frame_index").alias("dhash"), F.lit(None).cast("string").alias("error"))

    def probed(c: DataFrame) -> DataFrame:
        own = parsed(c).select("run_id", F.col("x.id").alias("submission_id"))
        return own.join(d.container_format.drop("channel"), "submission_id", "left").join(d.keyframes, "submission_id", "left").select("run_id", "encoder", "times", F.lit(None).cast("string").alias("error"))

    def read(shown: list[tuple[int, float, bytes]]) -> tuple[list[dict], int, int]:
        return [r | {"frame_index": i} for i, _, image in shown for r in json.loads(image)["rows"]], 10 * len(shown), 1

    job = Extraction(Tables(d.spark, f"{shared_folder(d.spark)}/published-{uuid.uuid4().hex}"), read, "v1", frames=framed, probe=probed)
    archive = Written(d.spark)
    try:
        job.run("all", recordings_, d.enrollment, d.grants, archive.keep(contents), NOW)
    finally:
        archive.drop()
    return job


@query("S15 R28 E5 J11 G1 G4 G7, published in one commit", """
, m AS (SELECT run_id, count(*) AS n FROM g1 GROUP BY run_id),
f AS (SELECT l_orderkey AS run_id, count(DISTINCT frame) AS n FROM (SELECT run_id AS l_orderkey, frame FROM reads) GROUP BY 1)
SELECT s.id, 'succeeded' AS status, CAST(coalesce(f.n, 0) * 10 AS BIGINT) AS tokens, r.n_rows, r.wagered_total, r.granted_amount, r.delta, r.arithmetic_ok,
  CAST(coalesce(m.n, 0) AS BIGINT) AS mismatches, coalesce(r.wagered_total < r.granted_amount, false) AS shortfall,
  s.channel = 'dropbox' AND s.id % 13 <> 0 AND s.id % 5 <> 3 AS encoder_flag
FROM submission s JOIN recon r ON r.run_id = s.id LEFT JOIN m ON m.run_id = s.id LEFT JOIN f ON f.run_id = s.id WHERE s.kind = 'wager_recording'""")
def published_extraction(d):
    job = _published(d)
    flags = job.table("integrity_flag").groupBy("run_id").agg(
        F.count_if(F.expr("code = 'ARITHMETIC_MISMATCH' and detail like 'row %: the balance moved by %'")).alias("mismatches"),
        F.count_if(F.expr("code = 'WAGER_SHORTFALL' and detail like 'wagered % granted'")).alias("short"), F.count_if(F.expr("code = 'ENCODER_MISMATCH'")).alias("encoded"),
    )
    runs = job.table("extraction_run").select(F.col("id").alias("run_id"), "submission_id", "status", F.coalesce("input_tokens", F.lit(0)).alias("tokens"))
    rows = runs.join(job.table("reconciliation"), "run_id").join(flags, "run_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        F.col("submission_id").cast("long").alias("id"), "status", "tokens", "n_rows", "wagered_total", "granted_amount", "delta", "arithmetic_ok",
        none("mismatches").alias("mismatches"), (none("short") > 0).alias("shortfall"), (none("encoded") > 0).alias("encoder_flag"),
    )


@query("§2.10 json, T1 stored hashes read back", """
, h AS (SELECT id, lower(CASE WHEN dhash IS NULL THEN NULL ELSE format('{:x}', CAST(dhash AS UBIGINT)) END) AS text FROM media_asset WHERE dhash >= 0 OR dhash IS NULL)
SELECT id, text AS d_hash, CASE WHEN id % 4 = 1 THEN NULL ELSE text END AS read_back FROM h""")
def media_metadata(d):
    # as recordings' metadata may be: with the hash, with other things beside it, broken, and without one
    text = F.lower(F.hex("dhash"))
    meta = F.when(F.pmod("id", F.lit(4)) == 1, F.concat(F.lit('{"dHash": "'), text)).when(F.pmod("id", F.lit(4)) == 2, F.to_json(F.struct(F.array(F.lit(1)).alias("x"), text.alias("dHash")))).otherwise(F.to_json(F.struct(text.alias("dHash"))))
    rows = d.media_asset.where("dhash >= 0 or dhash is null").select("id", "dhash", meta.alias("source_meta"))
    return rows.select("id", text.alias("d_hash"), F.lower(F.hex(stored_hash(F.col("source_meta")))).alias("read_back"))


@query("S12 §2.10 bit, hashes from gray frames", """
, p AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor(128 + 40 * CAST(x AS DOUBLE)))) AS BIGINT))) AS p, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
x AS (SELECT i, px, greatest(0, least((i + 1) * 16, (px + 1) * 9) - greatest(i * 16, px * 9)) AS w FROM (SELECT unnest(range(9)) AS i), (SELECT unnest(range(16)) AS px)),
y AS (SELECT j, py, greatest(0, least((j + 1) * 4, (py + 1) * 8) - greatest(j * 4, py * 8)) AS w FROM (SELECT unnest(range(8)) AS j), (SELECT unnest(range(4)) AS py)),
s AS (SELECT vec_id, i, j, CAST((2 * sum(p * x.w * y.w) + 64) // 128 AS BIGINT) AS g FROM p JOIN x ON x.px = k % 16 AND x.w > 0 JOIN y ON y.py = k // 16 AND y.w > 0 GROUP BY ALL),
b AS (SELECT a.vec_id, CASE WHEN a.g > b.g THEN CAST(1 AS HUGEINT) << CAST(63 - (8 * a.j + a.i) AS INT) ELSE 0 END AS bit FROM s a JOIN s b ON b.vec_id = a.vec_id AND b.j = a.j AND b.i = a.i + 1)
SELECT vec_id, CAST(CASE WHEN sum(bit) >= 9223372036854775808 THEN sum(bit) - 18446744073709551616 ELSE sum(bit) END AS BIGINT) AS dhash FROM b GROUP BY vec_id""")
def frame_pixel_hashes(d):
    pixel = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 40 * x.cast("double")))).cast("int")
    gray = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(pixel(x)), 2, "0")), ""))
    return d.embeddings.select("vec_id", difference_hash(F.lit(16), F.lit(4), gray).alias("dhash"))


@query("S7 E3 attached originals", """
, o AS (SELECT doc_id, lang, 'From: Casino <No-Reply@casino' || (doc_id % 7) || E'.example>\r\nTo: p' || doc_id || E'@x.example\r\nSubject: about\r\n its text\r\n\r\n' || coalesce(text, '') AS original FROM documents)
SELECT doc_id AS id, CAST(CASE WHEN doc_id % 4 = 3 THEN 1 WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END AS INT) AS n_parts, doc_id % 4 <> 3 AND doc_id % 5 = 0 AS has_image,
  'P' || doc_id || '@Example.com' AS from_addr, CASE WHEN doc_id % 4 < 3 THEN 'No-Reply@casino' || (doc_id % 7) || '.example' END AS original_from, CASE WHEN doc_id % 4 < 3 THEN 'about its text' END AS subject,
  CASE WHEN doc_id % 4 < 3 THEN sha256(original) END AS content_hash, CASE WHEN doc_id % 4 < 3 THEN CAST(strlen(original) AS BIGINT) END AS bytes FROM o""")
def message_originals(d):
    rows = parse_messages(d.mail_message)
    return rows.select("id", F.size(mime.parts(mime.latin(F.col("content")))).alias("n_parts"), "mail.has_image", "mail.from_addr", "mail.original_from", "mail.subject", "content_hash", F.octet_length("mail.original").cast("long").alias("bytes"))


@query("E2 canonical bodies", """
, t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r?\\n', E'\r\n', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, regexp_replace(regexp_replace(replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), E' \r\n', E'\r\n'), ' $', ''), '(\\r\\n)+$', '') AS x FROM t)
SELECT doc_id, to_base64(unhex(sha256(regexp_replace(t, '(\\r\\n)+$', '') || E'\r\n'))) AS simple, to_base64(unhex(sha256(CASE WHEN x = '' THEN '' ELSE x || E'\r\n' END))) AS relaxed FROM r""")
def body_hashes(d):
    text = mime.latin(F.coalesce("text", F.lit("")).cast("binary"))
    hashed = lambda relaxed: F.base64(F.unhex(F.sha2(mime.unlatin(signatures.canonical_body(text, F.lit(relaxed))), 256)))
    return d.documents.select("doc_id", hashed(False).alias("simple"), hashed(True).alias("relaxed"))


@query("E2 results of signatures that can't pass", """
SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'permerror' WHEN 2 THEN 'permerror' WHEN 3 THEN 'neutral' WHEN 4 THEN 'temperror' WHEN 5 THEN 'neutral' ELSE 'fail' END AS dkim,
  CASE WHEN doc_id % 8 > 0 THEN 's' || (doc_id % 8) END AS selector, doc_id % 8 = 7 AS l_tag_present FROM documents""")
def signature_results(d):
    keys = d.spark.createDataFrame([("s1", DEMO_KEY), ("s2", DEMO_KEY), ("s4", None), ("s5", DEMO_KEY), ("s6", f"v=DKIM1; k=rsa; p={DEMO_KEY}"), ("s7", DEMO_KEY)], "selector string, key string")
    return signatures.verify(d.signed_message, keys.withColumn("domain", F.lit("casino.example"))).select("id", "dkim", "selector", "l_tag_present")


@query("E2 E3", "SELECT dkim, covered, CASE lower(dkim) WHEN 'pass' THEN 'pass' WHEN 'none' THEN 'no_signature' WHEN 'temperror' THEN 'error' WHEN 'permerror' THEN 'error' ELSE 'fail' END AS verdict, count(*) AS n FROM inbound GROUP BY ALL")
def signature_verdicts(d):
    rows = d.inbound_email.select("dkim", evidence.covers_headers(F.col("signed_headers")).alias("covered"), evidence.signature_verdict(F.col("dkim")).alias("verdict"))
    return rows.groupBy("dkim", "covered", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("R31 S10 last write wins", """
, last AS (SELECT o_custkey, arg_max(CAST(o_totalprice AS DECIMAL(12,2)), (o_orderdate, o_orderkey)) AS amount FROM orders GROUP BY o_custkey)
SELECT coalesce(c_custkey, o_custkey) AS enrollment_id, coalesce(amount, 0) AS amount FROM customer FULL JOIN last ON o_custkey = c_custkey""")
def grant_upserts(d):
    rows = d.orders.select(F.col("o_custkey").alias("enrollment_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    base = d.customer.select(F.col("c_custkey").alias("enrollment_id"), F.lit(0).cast("decimal(12,2)").alias("amount"))
    return lifecycle.upsert(base, rows, ["enrollment_id"], "at")


@query("R32 S10 insert if absent", "SELECT casino, domain FROM allowlist UNION SELECT DISTINCT o_orderpriority, 'd' || (o_orderkey % 8) || '.example' FROM orders")
def allowlist_upserts(d):
    more = d.orders.select(F.col("o_orderpriority").alias("casino"), F.concat(F.lit("d"), (F.col("o_orderkey") % 8).cast("string"), F.lit(".example")).alias("domain"))
    return lifecycle.upsert(d.dkim_allowed_signer, more, ["casino", "domain"])


@query("S10 new participants", """
, asked AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 8 AS k, 'p' || c_custkey AS p FROM customer),
forms AS (SELECT id, k, [p || '@example.com', p || '''s+x@a-b.co.uk', upper(p) || '@EXAMPLE.ORG', '.' || p || '@example.com', p || '..x@example.com', p || '@example', p || '.@example.com', NULL][CAST(k + 1 AS INT)] AS email FROM asked)
SELECT id, email, CASE WHEN k BETWEEN 3 AND 6 THEN 'not an e-mail address' END AS error FROM forms""")
def participant_creation(d):
    made = lambda before, after: F.concat(F.lit(before), F.lit("p"), F.col("c_custkey").cast("string"), F.lit(after))
    shouted = F.concat(F.lit("P"), F.col("c_custkey").cast("string"), F.lit("@EXAMPLE.ORG"))
    forms = F.array(made("", "@example.com"), made("", "'s+x@a-b.co.uk"), shouted, made(".", "@example.com"), made("", "..x@example.com"), made("", "@example"), made("", ".@example.com"), F.lit(None))
    rows = d.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("contact"), F.get(forms, (F.col("c_custkey") % 8).cast("int")).alias("email"), F.lit(NOW).alias("created_at"))
    return people.new_participants(rows).select("id", "email", "error")


@query("S10 R29 new enrollments of known participants", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS participant_id, CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 13 <> 1 THEN o_orderpriority END AS casino, 'invited' AS state,
  CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) THEN 'participant not found' WHEN o_orderkey % 13 < 2 THEN 'no casino' END AS error FROM orders""")
def enrollment_creation(d):
    casino = F.when(F.col("o_orderkey") % 13 == 0, "").when(F.col("o_orderkey") % 13 != 1, F.col("o_orderpriority"))
    rows = d.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("participant_id"), casino.alias("casino"), F.col("o_orderdate").alias("created_at"))
    known = d.customer.where("c_nationkey <> 3").select(F.col("c_custkey").alias("id"))
    return people.new_enrollments(rows, known).drop("created_at")


@query("S10 R29 requests for files", """
, asked AS (SELECT DISTINCT user_id AS eid FROM events)
SELECT CAST(eid AS VARCHAR) AS enrollment_id, CASE WHEN e.id IS NOT NULL THEN '/intake/' || eid END AS destination_path, CASE WHEN e.id IS NOT NULL THEN 'Evidence, ' || e.casino END AS title,
  CASE WHEN e.id IS NULL THEN 'no enrollment ' || eid END AS error FROM asked LEFT JOIN enrollment e ON e.id = eid""")
def file_request_creation(d):
    rows = d.events.select(F.col("user_id").alias("enrollment_id")).distinct().withColumns({"id": F.concat(F.lit("r"), F.col("enrollment_id").cast("string")), "created_at": F.lit(NOW)})
    return people.file_requests(rows, d.enrollment, "/intake/", "Evidence, ").select("enrollment_id", "destination_path", "title", "error")


@query("J2 nested fetch of turns", "SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_turns(d):
    listed = search.nested(d.conversations, "conv_id", ["turn"], ["role"], "turns")
    return listed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["role"]), ">").alias("roles"))


@query("J3 semi-join", "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang")
def flagged_documents(d):
    return d.documents.join(d.labels.where("toxic = 1"), "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("F9 Q18 substring predicate", "SELECT p_partkey, p_partkey % 7 <> 0 AND p_partkey % 5 IN (1, 2, 3) OR coalesce(regexp_matches(lower(p_name), 'bet|wager|stake') AND p_partkey % 7 <> 0, false) AS hit FROM part")
def hinted_names(d):
    kinds = F.array(*map(F.lit, (" be t", " Better luck", "-WAGERED", "a mistake", " steak")))
    named = d.part.withColumn("kind", F.when(F.col("p_partkey") % 7 != 0, F.concat("p_name", F.get(kinds, (F.col("p_partkey") % 5).cast("int")))))
    return named.select("p_partkey", ledger.is_wager(F.col("kind")).alias("hit"))


@query("§2.10 scalar functions", "SELECT run_id, ordinal, CAST(CAST(amount AS BIGINT) AS VARCHAR) AS amount_text, strftime(try_strptime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%S.%gZ') AS \"at\" FROM ledger")
def ledger_texts(d):
    return stitched(d).select("run_id", "ordinal", plain_number(F.col("amount")).alias("amount_text"), iso_millis(lenient_timestamp(F.col("timestamp"))).alias("at"))
