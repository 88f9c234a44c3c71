"""Queues, searches, details and exports: one plan each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import csv_line, iso_millis
from ..operators.evidence import prefunding_checks
from ..operators.lifecycle import latest


def nested(rows: DataFrame, key: str, order: list[str], columns: list[str], name: str, descending: bool = False) -> DataFrame:
    """(key, name): the rows of a key as an array of structs in the order given. order must be total."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.struct(*columns).alias("_row"))), asc=not descending)
    return rows.groupBy(key).agg(F.transform(listed, lambda r: r["_row"]).alias(name))


def with_nested(rows: DataFrame, other: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """rows with the array `name` of other; an empty one where there is none."""
    out = rows.join(other.withColumnRenamed(right, "_key"), F.col(left) == F.col("_key"), "left").drop("_key")
    return out.withColumn(name, F.coalesce(name, F.array().cast(other.schema[name].dataType)))


def in_range(column: Column, since: datetime | None, until: datetime | None) -> Column:
    """Within an inclusive range of which either end may be missing."""
    out = F.lit(True)
    if since is not None:
        out = out & (column >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out & (column <= F.lit(until).cast("timestamp"))
    return out


def search_submissions(
    d,
    enrollment_id: int | None = None,
    participant_id: int | None = None,
    casino: str | None = None,
    state: str | None = None,
    flag: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Submissions with their enrollment, by any of the filters, latest first.

    None leaves a filter out. An empty casino or state is compared as such; an empty flag leaves its filter out.
    """
    enrolled = d.enrollment.withColumnRenamed("id", "enrollment_id").drop("created_at")
    for name, value in (("participant_id", participant_id), ("casino", casino), ("state", state)):
        if value is not None:
            enrolled = enrolled.where(F.col(name) == value)
    rows = d.submission.where(in_range(F.col("received_at"), since, until))
    if enrollment_id is not None:
        rows = rows.where(F.col("enrollment_id") == enrollment_id)
    if flag:
        rows = rows.join(d.integrity_flag.where(F.col("code") == flag).select(F.col("submission_id").alias("id")), "id", "left_semi")
    return rows.join(enrolled, "enrollment_id").orderBy(F.desc("received_at"), "id")


def search_with_relations(d, **filters) -> DataFrame:
    """search_submissions() with the nested relations of the search page: media, e-mail evidence, flags."""
    rows = search_submissions(d, **filters)
    media = d.media_asset.select(F.col("id").alias("media_asset_id"), F.struct("blob_key", "bytes", "deleted_at").alias("media"))
    mail = d.email_evidence.select(F.col("submission_id").alias("id"), F.struct("tier", "dkim_result", "d_domain").alias("email_evidence"))
    flags = nested(d.integrity_flag, "submission_id", ["id"], ["code", "severity"], "flags")
    return with_nested(rows.join(media, "media_asset_id").join(mail, "id", "left"), flags, "id", "submission_id", "flags")


def extraction_runs(d, rows: DataFrame) -> DataFrame:
    """Runs of submissions, latest first per submission, with ledger rows by source frame. rows: of stitch(), run_id = submission."""
    listed = nested(rows, "run_id", ["source_frame_ts", "ordinal"], ["ordinal", "type", "amount", "balance_after"], "rows")
    return with_nested(d.extraction_run, listed, "submission_id", "run_id", "rows")


def submission_detail(d, submission_id: int | None, rows: DataFrame) -> DataFrame:
    """One submission, or all, with its runs, latest first, each with its rows."""
    own = lambda df, c: df if submission_id is None else df.where(F.col(c) == submission_id)
    runs = extraction_runs(d, own(rows, "run_id"))
    listed = nested(runs, "submission_id", ["started_at", "id"], ["id", "status", "rows"], "runs", descending=True)
    return with_nested(own(d.submission, "id"), listed, "id", "submission_id", "runs")


def media_lookup(d, submission_ids: list[int] | None, actor: str, at: datetime) -> tuple[DataFrame, DataFrame]:
    """(id, status, blob_key) of these (or all) submissions' media, 410 where purged, and the audit rows of the lookups that gave any."""
    media = d.media_asset.select(F.col("id").alias("media_asset_id"), "blob_key", "deleted_at")
    asked = d.submission if submission_ids is None else d.submission.where(F.col("id").isin(*submission_ids))
    found = asked.join(media, "media_asset_id")
    status = F.when(F.col("deleted_at").isNotNull(), 410).otherwise(200)
    found = found.select("id", status.alias("status"), F.when(F.col("deleted_at").isNull(), F.col("blob_key")).alias("blob_key"))
    audit = found.where("status = 200").select(F.lit(actor).alias("actor"), F.lit("media_view").alias("action"), F.col("id").cast("string").alias("target"), F.lit(at).cast("timestamp").alias("at"))
    return found, audit


def enrollment_detail(d, enrollment_ids: list[int] | None = None) -> DataFrame:
    """Enrollments with submissions and decisions, both in the order of time."""
    rows = d.enrollment if enrollment_ids is None else d.enrollment.where(F.col("id").isin(*enrollment_ids))
    subs = nested(d.submission, "enrollment_id", ["received_at", "id"], ["id", "kind", "channel"], "submissions")
    made = nested(d.decision, "enrollment_id", ["at", "id"], ["id", "to_state"], "decisions")
    return with_nested(with_nested(rows, subs, "id", "enrollment_id", "submissions"), made, "id", "enrollment_id", "decisions")


def funding_queue(d) -> DataFrame:
    """Enrollments whose e-mail is verified, in the order of creation, with all checks, as one plan."""
    waiting = d.enrollment.where("state = 'email_verified'")
    checks = prefunding_checks(waiting, d.enrollment, d.participant, d.submission, d.email_evidence)
    listed = nested(checks, "enrollment_id", ["code"], ["code", "passed"], "checks")
    return with_nested(waiting, listed, "id", "enrollment_id", "checks").orderBy("created_at", "id")


def wager_queue(d) -> DataFrame:
    """Enrollments with a submitted wager, with their recordings only and those recordings' runs."""
    runs = nested(d.extraction_run, "submission_id", ["started_at", "id"], ["id", "status"], "runs", descending=True)
    subs = with_nested(d.submission.where("kind = 'wager_recording'"), runs, "id", "submission_id", "runs")
    listed = nested(subs, "enrollment_id", ["received_at", "id"], ["id", "runs"], "submissions")
    return with_nested(d.enrollment.where("state = 'wager_submitted'"), listed, "id", "enrollment_id", "submissions").orderBy("created_at", "id")


def decision_log(d, enrollment_id: int | None = None) -> DataFrame:
    """Decisions in the order of time."""
    rows = d.decision if enrollment_id is None else d.decision.where(F.col("enrollment_id") == enrollment_id)
    return rows.orderBy("at", "id")


def participant_list(d, email: str | None = None, contact: str | None = None) -> DataFrame:
    """Participants by exact e-mail and contact, latest first."""
    rows = d.participant
    for name, value in (("email", email), ("contact", contact)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("created_at"), "id")


def participant_history(d, participant_ids: list[int] | None = None) -> DataFrame:
    """Participants with enrollments, latest first, each with submissions, latest first, each with flags."""
    flags = nested(d.integrity_flag, "submission_id", ["id"], ["code"], "flags")
    subs = with_nested(d.submission, flags, "id", "submission_id", "flags")
    subs = nested(subs, "enrollment_id", ["received_at", "id"], ["id", "kind", "flags"], "submissions", descending=True)
    enrolled = with_nested(d.enrollment, subs, "id", "enrollment_id", "submissions")
    enrolled = nested(enrolled, "participant_id", ["created_at", "id"], ["id", "state", "submissions"], "enrollments", descending=True)
    rows = d.participant if participant_ids is None else d.participant.where(F.col("id").isin(*participant_ids))
    return with_nested(rows, enrolled, "id", "participant_id", "enrollments")


SUBMISSION_HEADER = (
    "submission_id", "participant_id", "participant_contact", "enrollment_id", "casino", "enrollment_state", "kind", "channel",
    "received_at", "content_hash", "email_tier", "email_dkim_result", "flags",
)
DECISION_HEADER = ("decision_id", "enrollment_id", "actor", "from_state", "to_state", "at", "note", "hash", "prev_hash")


def submissions_csv(d, participant_id: int | None = None, enrollment_id: int | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(received_at, id, line) of the submission export, latest first. Flags are joined by semicolons and repeat if they do."""
    rows = search_submissions(d, enrollment_id=enrollment_id, participant_id=participant_id, since=since, until=until)
    people = d.participant.select(F.col("id").alias("participant_id"), "contact")
    mail = d.email_evidence.select(F.col("submission_id").alias("id"), "tier", "dkim_result")
    flags = d.integrity_flag.groupBy(F.col("submission_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("n"), "code"))), lambda f: f["code"]), ";").alias("flags"))
    full = rows.join(people, "participant_id").join(mail, "id", "left").join(flags, "id", "left")
    line = csv_line(
        F.col("id"), F.col("participant_id"), F.col("contact"), F.col("enrollment_id"), F.col("casino"), F.col("state"), F.col("kind"), F.col("channel"),
        iso_millis(F.col("received_at")), F.col("content_hash"), F.col("tier"), F.col("dkim_result"), F.coalesce("flags", F.lit("")),
    )
    return full.select("received_at", "id", line.alias("line")).orderBy(F.desc("received_at"), "id")


def submissions_csv_for(d, request: dict) -> DataFrame:
    """submissions_csv() by a request's filters. Only those the export knows count, whatever else the request holds; an empty
    participant_id leaves that filter out."""
    known = {k: request[k] for k in ("participant_id", "enrollment_id", "since", "until") if request.get(k) is not None}
    if known.get("participant_id") == "":
        del known["participant_id"]
    return submissions_csv(d, **known)


def decisions_csv(chained: DataFrame, enrollment_id: int | None = None) -> DataFrame:
    """(at, id, line) of the decision export, in the order of time. chained: decisions with hashes."""
    rows = chained if enrollment_id is None else chained.where(F.col("enrollment_id") == enrollment_id)
    line = csv_line(*(F.col(c) for c in ("id", "enrollment_id", "actor", "from_state", "to_state")), iso_millis(F.col("at")), F.col("note"), F.col("hash"), F.col("prev_hash"))
    return rows.select("at", "id", line.alias("line")).orderBy("at", "id")


def staff_list(staff: DataFrame) -> DataFrame:
    """Staff without their tokens' hashes."""
    return staff.select("id", "name", "role", "created_at").orderBy("created_at", "id")


def staff_by_token(staff: DataFrame, token: str) -> DataFrame:
    """The staff member whose token has this SHA-256."""
    return staff.where(F.col("token_hash") == F.sha2(F.lit(token), 256))


def latest_runs(d) -> DataFrame:
    """The latest extraction run of each submission."""
    return latest(d.extraction_run, "submission_id", "started_at", "id", "id", "status")
