"""Checks across submissions, eligibility checks, retention, quota, ingest and e-mail evidence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import millis_between
from .folds import fold
from .ledger import flag
from .lineage import cut
from .media import encoder_trace, intervals, keyframe_outliers, upper_median

DAY_MS = 86_400_000
#: Fixed values of the checks.
GAP_DAYS, SHARED_CAP, LEAST_SIGNUP_MS = 14, 50, 60_000
FUNDED_OR_LATER = ("funded", "wager_submitted", "wager_verified", "closed")
AWAITING_EMAIL = ("invited", "email_submitted")
SIGNED_HEADERS = ("to", "from", "subject", "date")


def gap_flags(submissions: DataFrame, grants: DataFrame) -> DataFrame:
    """SUBMISSION_GAP for submissions more than 14 days from the grant, either way."""
    gap = F.abs(millis_between(F.col("received_at"), F.col("sent_at"))) > GAP_DAYS * DAY_MS
    return submissions.join(grants.select("enrollment_id", "sent_at"), "enrollment_id").where(gap).select(*flag(F.col("id"), "SUBMISSION_GAP", "warning"))


def intake_flags(submissions: DataFrame) -> DataFrame:
    """MANUAL_INTAKE for manual uploads."""
    return submissions.where("channel = 'manual_upload'").select(*flag(F.col("id"), "MANUAL_INTAKE", "info"))


def sequence_flags(submissions: DataFrame, enrollments: DataFrame) -> DataFrame:
    """OUT_OF_SEQUENCE for wager recordings of enrollments whose state isn't funded."""
    states = enrollments.select(F.col("id").alias("enrollment_id"), "state")
    return submissions.where("kind = 'wager_recording'").join(states, "enrollment_id").where("state <> 'funded'").select(*flag(F.col("id"), "OUT_OF_SEQUENCE", "warning"))


def shared_rows(rows: DataFrame) -> DataFrame:
    """rows (run_id, participant_id, row_key) -> per run: matches, and up to the cap matches and other participants.

    A match is a row of another run and another participant with an equal key. Matches are counted from sums per key,
    never listed: the rows of a key less those of the run's own participant. The rows of a key in one
    run are first made one, with their number, and the keys of one participant only are left out. Rows without a
    participant match none. What is used more than once is written first.
    """
    per_run = cut(rows.where("participant_id is not null").groupBy("row_key", "run_id", "participant_id").agg(F.count(F.lit(1)).alias("n")))
    return shared_by_sums(per_run, per_run.groupBy("row_key", "participant_id").agg(F.sum("n").alias("own")))


def shared_by_sums(per_run: DataFrame, per_person: DataFrame) -> DataFrame:
    """shared_rows of the runs in per_run (row_key, run_id, participant_id), by how many rows of each key each participant has: per_person
    (row_key, participant_id, own), these runs' own among them."""
    per_key = per_person.groupBy("row_key").agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("people")).where("people > 1")
    hits = cut(per_run.select("row_key", "run_id", "participant_id").join(per_key, "row_key").join(per_person, ["row_key", "participant_id"]))
    totals = hits.groupBy("run_id").agg(F.sum(F.col("all") - F.col("own")).alias("n_matches"), F.max("people").alias("most"))
    # A key of more participants than the cap settles its runs. The others' keys are all small, and are listed.
    small = totals.where(F.col("most") <= SHARED_CAP).select("run_id")
    few = hits.where(F.col("people") <= SHARED_CAP).select("row_key").distinct()
    others = per_person.join(few, "row_key", "left_semi").select("row_key", F.col("participant_id").alias("other")).distinct()
    people = hits.join(small, "run_id", "left_semi").select("run_id", "row_key", "participant_id").join(others, "row_key").where("other <> participant_id")
    people = people.groupBy("run_id", "other").agg(F.lit(1).alias("one")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_participants"))
    cap = lambda c: F.least(c, F.lit(SHARED_CAP).cast("long"))
    return totals.join(people, "run_id", "left").select("run_id", "n_matches", cap("n_matches").alias("n_capped"), cap(F.coalesce("n_participants", F.lit(SHARED_CAP).cast("long"))).alias("n_participants"))


def sharing_runs(rows: DataFrame) -> DataFrame:
    """(run_id) of the runs that shared_rows has: only whether a key has two participants is asked of it."""
    seen = rows.where("participant_id is not null")
    keys = seen.groupBy("row_key").agg(F.min("participant_id").alias("_low"), F.max("participant_id").alias("_high")).where("_low <> _high")
    return seen.select("run_id", "row_key").distinct().join(keys.select("row_key"), "row_key", "left_semi").select("run_id").distinct()


def submission_flags(submissions: DataFrame, grants: DataFrame, enrollments: DataFrame, formats: DataFrame, keyframes: DataFrame) -> DataFrame:
    """All flags that a submission has by itself, from one pass: submission_findings without their detail."""
    return submission_findings(submissions, grants, enrollments, formats, keyframes).drop("detail")


def submission_findings(submissions: DataFrame, grants: DataFrame, enrollments: DataFrame, formats: DataFrame, keyframes: DataFrame) -> DataFrame:
    """The flags of gap_flags, intake_flags and sequence_flags, and of recordings from the folder ENCODER_MISMATCH and
    FRAME_DISCONTINUITY, with detail, a sentence with the figures.

    An enrollment has one grant at most, a submission one container format (submission_id, encoder) and one row of
    keyframes (submission_id, times). Nothing known of a submission flags nothing.
    """
    rows = submissions.select("id", "enrollment_id", "kind", "channel", "received_at")
    rows = rows.join(grants.select("enrollment_id", "sent_at"), "enrollment_id", "left")
    rows = rows.join(enrollments.select(F.col("id").alias("enrollment_id"), "state"), "enrollment_id", "left")
    traces = formats.select(F.col("submission_id").alias("id"), "encoder", encoder_trace(F.col("encoder")).alias("trace")).where("trace is not null")
    far = F.col("outliers").cast("string"), (F.size("times") - 1).cast("string"), F.format_string("%.2f", upper_median(intervals(F.col("times"))))
    gaps = keyframes.select(F.col("submission_id").alias("id"), "times", keyframe_outliers(F.col("times")).alias("outliers")).where("outliers > 0")
    gaps = gaps.select("id", "outliers", F.concat(far[0], F.lit(" of "), far[1], F.lit(" keyframe intervals are far from their median of "), far[2], F.lit(" s")).alias("gap_text"))
    rows = rows.join(traces, "id", "left").join(gaps, "id", "left")
    made = lambda hit, code, severity, *text: F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat(*text).alias("detail")))
    days = F.format_string("%.1f", F.abs(millis_between(F.col("received_at"), F.col("sent_at"))) / DAY_MS)
    folder = F.col("channel") == "dropbox"
    found = F.array_compact(
        F.array(
            made(F.abs(millis_between(F.col("received_at"), F.col("sent_at"))) > GAP_DAYS * DAY_MS, "SUBMISSION_GAP", "warning", days, F.lit(f" days from the grant; up to {GAP_DAYS} are usual")),
            made(F.col("channel") == "manual_upload", "MANUAL_INTAKE", "info", F.lit("uploaded by hand; where it comes from isn't verified")),
            made((F.col("kind") == "wager_recording") & (F.col("state") != "funded"), "OUT_OF_SEQUENCE", "warning", F.lit("came while the enrollment was "), F.col("state")),
            made(folder & F.col("trace").isNotNull(), "ENCODER_MISMATCH", "warning", F.lit('the encoder "'), F.col("encoder"), F.lit('" re-encodes: '), F.col("trace")),
            made(folder & F.col("outliers").isNotNull(), "FRAME_DISCONTINUITY", "warning", F.col("gap_text")),
        )
    )
    return rows.select(F.col("id").alias("run_id"), F.inline(found)).select("run_id", "code", "severity", F.lit(None).cast("int").alias("item"), "detail")


def prefunding_checks(enrollments: DataFrame, all_enrollments: DataFrame, participants: DataFrame, submissions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(enrollment_id, code, passed) of up to four checks for each of the enrollments, as one plan.

    DUPLICATE_ENROLLMENT_EMAIL, where the participant has an e-mail: no other participant has the very same one.
    ALREADY_FUNDED: no other enrollment of the participant at the casino is funded or later. RECIPIENT_MISMATCH, where a
    submission has e-mail evidence (the earliest counts): the recipient is the registered address in any case, or either
    is missing. SIGNUP_TIMING as SUBMISSION_TIMING, where there is a sign-up e-mail (the earliest counts): it came at
    least a minute after the enrollment.
    """
    emails = participants.where("email is not null and email <> ''").groupBy("email").agg(F.count(F.lit(1)).alias("same"))
    people = participants.select(F.col("id").alias("participant_id"), "email").join(emails, "email", "left")
    funded = all_enrollments.where(F.col("state").isin(*FUNDED_OR_LATER)).groupBy("participant_id", "casino").agg(F.count(F.lit(1)).alias("funded"))
    first = F.struct("received_at", "id")
    with_mail = submissions.join(evidence.select(F.col("submission_id").alias("id"), "to_addr"), "id")
    mail = with_mail.groupBy("enrollment_id").agg(F.min_by("to_addr", first).alias("to_addr"), F.lit(True).alias("has_mail"))
    signup = submissions.where("kind = 'signup_email'").groupBy("enrollment_id").agg(F.min("received_at").alias("signup_at"))
    base = enrollments.withColumnRenamed("id", "enrollment_id").join(people, "participant_id").join(funded, ["participant_id", "casino"], "left")
    base = base.join(mail, "enrollment_id", "left").join(signup, "enrollment_id", "left")
    own = F.when(F.col("state").isin(*FUNDED_OR_LATER), 1).otherwise(0)
    missing = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    checks = F.array(
        F.when(~missing("email"), F.struct(F.lit("DUPLICATE_ENROLLMENT_EMAIL").alias("code"), (F.col("same") == 1).alias("passed"))),
        F.struct(F.lit("ALREADY_FUNDED").alias("code"), (F.coalesce("funded", F.lit(0)) - own == 0).alias("passed")),
        F.when(F.col("has_mail"), F.struct(F.lit("RECIPIENT_MISMATCH").alias("code"), (missing("email") | missing("to_addr") | (F.lower("to_addr") == F.lower("email"))).alias("passed"))),
        F.when(F.col("signup_at").isNotNull(), F.struct(F.lit("SUBMISSION_TIMING").alias("code"), (millis_between(F.col("signup_at"), F.col("created_at")) >= LEAST_SIGNUP_MS).alias("passed"))),
    )
    return base.select("enrollment_id", F.inline(F.array_compact(checks)))


def retention(media: DataFrame, submissions: DataFrame, enrollments: DataFrame, now: datetime, raw_days: int = 90, email_days: int = 180) -> DataFrame:
    """(id, decision) for media not deleted yet: skipped or deleted.

    Media without a submission stay. Sign-up e-mails of enrollments funded or later have their own period, all else
    the raw one; media go once their age reaches it.
    """
    known = submissions.select(F.col("media_asset_id").alias("id"), "kind", "enrollment_id", F.lit(True).alias("used"))
    states = enrollments.select(F.col("id").alias("enrollment_id"), "state")
    joined = media.where("deleted_at is null").select("id", "created_at").join(known, "id", "left").join(states, "enrollment_id", "left")
    days = F.when((F.col("kind") == "signup_email") & F.col("state").isin(*FUNDED_OR_LATER), email_days).otherwise(raw_days)
    old = millis_between(F.lit(now).cast("timestamp"), F.col("created_at")) >= days.cast("long") * DAY_MS
    return joined.select("id", F.when(F.coalesce(F.col("used") & old, F.lit(False)), "deleted").otherwise("skipped").alias("decision"))


def quota(media: DataFrame, allocated: int | None, threshold: float = 0.9) -> DataFrame:
    """One row: used_bytes and whether they reach the threshold's share of the allocation; never without one."""
    used = media.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("used_bytes"))
    return used.withColumn("warned", (F.col("used_bytes") / allocated >= threshold) if allocated else F.lit(False))


def quota_audit(used: DataFrame, allocated: int | None) -> DataFrame:
    """(actor, action, target): a row where used, of quota, is a warning, else none."""
    target = F.concat(F.col("used_bytes").cast("string"), F.lit(f"/{allocated}"))
    return used.where("warned").select(F.lit("system").alias("actor"), F.lit("dropbox_quota_warning").alias("action"), target.alias("target"))


def enrollment_in_path(path: Column, root: str) -> Column:
    """The first folder below root in a lower-case path; null outside root and for an empty name."""
    base = f"{root[:-1] if root.endswith('/') else root}/"
    return F.when(path.startswith(base), F.nullif(F.split_part(F.substr(path, F.lit(len(base) + 1)), F.lit("/"), F.lit(1)), F.lit("")))


def classify_entries(entries: DataFrame, media: DataFrame, enrollments: DataFrame, root: str) -> DataFrame:
    """entries (path_lower, is_file, content_hash, ...) with enrollment_id, outcome and purge.

    In this order: ignored (no file), skipped (no id in the path), skipped and purged (content known, or an earlier path of
    this batch has it), skipped (unknown enrollment, left in place), ingested and purged.
    """
    known = media.select("content_hash", F.lit(True).alias("known")).distinct()
    ids = enrollments.select(F.col("id").cast("string").alias("enrollment_id"), F.lit(True).alias("exists")).distinct()
    placed = entries.withColumn("enrollment_id", enrollment_in_path(F.col("path_lower"), root))
    placed = placed.join(known, "content_hash", "left").join(ids, "enrollment_id", "left")
    good = placed.where(F.col("is_file") & F.col("enrollment_id").isNotNull() & F.col("known").isNull() & F.col("exists"))
    winner = good.groupBy("content_hash").agg(F.min("path_lower").alias("first_path"))
    placed = placed.join(winner, "content_hash", "left")
    has, repeated = F.col("enrollment_id").isNotNull(), F.col("known").isNotNull() | (F.col("first_path") < F.col("path_lower"))
    repeated = F.coalesce(repeated, F.lit(False))
    outcome = F.when(~F.col("is_file"), "ignored").when(~has | repeated | F.col("exists").isNull(), "skipped").otherwise("ingested")
    purge = F.col("is_file") & has & (repeated | F.col("exists").isNotNull())
    return placed.withColumns({"outcome": outcome, "purge": purge}).drop("known", "exists", "first_path")


def submissions_of(accepted: DataFrame, enrollments: DataFrame, channel: str) -> DataFrame:
    """accepted (enrollment_id, path_lower, ...) with kind, channel, advances and flags, for wager recordings.

    The first recording (by path) of a funded enrollment advances it to wager_submitted; any other is OUT_OF_SEQUENCE.
    Manual uploads are MANUAL_INTAKE besides.
    """
    states = enrollments.select(F.col("id").cast("string").alias("enrollment_id"), "state")
    first = accepted.groupBy("enrollment_id").agg(F.min("path_lower").alias("_first"))
    rows = accepted.join(first, "enrollment_id").join(states, "enrollment_id")
    advances = (F.col("state") == "funded") & (F.col("path_lower") == F.col("_first"))
    flags = F.array_compact(F.array(F.when(F.lit(channel == "manual_upload"), "MANUAL_INTAKE"), F.when(~advances, "OUT_OF_SEQUENCE")))
    return rows.withColumns({"kind": F.lit("wager_recording"), "channel": F.lit(channel), "advances": advances, "flags": flags}).drop("_first", "state")


def email_transitions(routed: DataFrame, enrollments: DataFrame) -> DataFrame:
    """(id, enrollment_id, step, from_state, to_state): the steps that routed messages make their enrollments take.

    A message without the original takes an invited enrollment to email_submitted. One with it takes any to
    email_verified, an invited one by way of email_submitted, whatever its signature's verdict.
    """
    states = enrollments.select(F.col("id").alias("enrollment_id"), "state")
    rows = routed.where(F.col("status").isin("auto_replied", "verified")).join(states, "enrollment_id")
    # messages come in the order of id: only an enrollment's first one finds it invited
    rows = rows.join(rows.groupBy("enrollment_id").agg(F.min("id").alias("_first")), "enrollment_id")
    invited, verified = (F.col("state") == "invited") & (F.col("id") == F.col("_first")), F.col("status") == "verified"
    move = lambda step, a, b: F.struct(F.lit(step).alias("step"), F.lit(a).alias("from_state"), F.lit(b).alias("to_state"))
    steps = F.array_compact(F.array(F.when(invited, move(1, "invited", "email_submitted")), F.when(verified, move(2, "email_submitted", "email_verified"))))
    return rows.select("id", "enrollment_id", F.inline(steps))


def joined_ends(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, component): of every node the smallest that links lead to, itself included.

    Links are brought to stars: each node passes its smallest neighbour on to the larger ones, then to all (large and small stars,
    Kiveris et al. 2014). A pass is a minimum for each node and a join, and passes grow as the logarithm of a component.
    """
    edges, seen = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None
    while True:
        edges = cut(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if now == seen or not now[0]:
            ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            own = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            return own.join(ends, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def first_come(edges: DataFrame) -> DataFrame:
    """Of edges (id, sender, content_hash), those taken when they come in the order of id and each sender and hash is taken once.

    Edges wait for each other only where senders and hashes join them: of each such component the edges pass in order, as
    one stream that holds what the component has taken. However long a chain of waiting messages, the passes that find the
    components grow as its logarithm.
    """
    edges = cut(edges.groupBy("sender", "content_hash").agg(F.min("id").alias("id")))
    sender, content = F.concat(F.lit("s"), "sender"), F.concat(F.lit("h"), "content_hash")
    places = cut(joined_ends(edges.select(sender.alias("u"), content.alias("v"))))

    def step(taken, sender, content):
        taken = taken or set()
        free = ("s", sender) not in taken and ("h", content) not in taken
        if free:
            taken |= {("s", sender), ("h", content)}
        return taken, (free,)

    rows = edges.withColumn("node", sender).join(places, "node").select("component", "id", "sender", "content_hash")
    return cut(fold(rows, "component", ["id"], ["sender", "content_hash"], step, "_free boolean").where("_free").select("id", "sender", "content_hash"))


def unmatched_audit(routed: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, actor, action, target) for messages that no enrollment could be found for."""
    missed = routed.where(F.col("status").isin("no_from_address", "no_participant", "no_pending_enrollment", "ambiguous_enrollment")).select("id", "status")
    rows = missed.join(messages.select("id", "from_addr"), "id")
    return rows.select("id", F.lit("system").alias("actor"), F.concat(F.lit("inbound_email_unmatched:"), "status").alias("action"), F.coalesce(F.nullif("from_addr", F.lit("")), F.lit("unknown")).alias("target"))


def signature_verdict(raw: Column) -> Column:
    """A verifier's result as pass, fail, no_signature or error; null as no_signature."""
    low = F.lower(F.coalesce(raw, F.lit("none")))
    return F.when(low == "pass", "pass").when(low == "none", "no_signature").when(low.isin("temperror", "temperr", "permerror"), "error").otherwise("fail")


def covers_headers(signed: Column) -> Column:
    """Whether a colon-separated list of signed headers has all that must be; false for null."""
    names = F.filter(F.transform(F.split(signed, ":"), lambda h: F.lower(F.trim(h))), lambda h: h != "")
    return F.coalesce(F.forall(F.array(*map(F.lit, SIGNED_HEADERS)), lambda h: F.array_contains(names, h)), F.lit(False))


def evidence_tier(attached: Column, verdict: Column, covered: Column, allowed: Column, image: Column) -> Column:
    """A or B with the original attached, D or C with only an image or nothing."""
    return F.when(attached, F.when((verdict == "pass") & covered & allowed, "A").otherwise("B")).otherwise(F.when(image, "D").otherwise("C"))


def route_emails(messages: DataFrame, participants: DataFrame, enrollments: DataFrame, media: DataFrame, allowlist: DataFrame) -> DataFrame:
    """messages (id, from_addr, content_hash or null, dkim, signed_headers, d_domain, has_image) -> id, status, enrollment_id, tier.

    The sender finds participants in any case; exactly one of their enrollments may await an e-mail. In this order:
    no_from_address, no_participant, no_pending_enrollment, ambiguous_enrollment, auto_replied (no original attached),
    duplicate (the original is archived), verified. Messages come in the order of id: after a verified one its enrollment
    awaits no e-mail any more, and its original is archived. Runs jobs to find which are verified.
    """
    senders = participants.where("email is not null").select(F.lower("email").alias("sender"), F.col("id").alias("participant_id"))
    waiting = enrollments.where(F.col("state").isin(*AWAITING_EMAIL)).select("participant_id", F.col("id").alias("enrollment_id"), "casino")
    per_sender = senders.join(waiting, "participant_id", "left").groupBy("sender").agg(
        F.count("enrollment_id").alias("pending"), F.min("enrollment_id").alias("enrollment_id"), F.min_by("casino", "enrollment_id").alias("casino")
    )
    known = media.select("content_hash", F.lit(True).alias("archived")).distinct()
    allowed = allowlist.select("casino", F.col("domain").alias("d_domain"), F.lit(True).alias("allowed")).distinct()
    rows = messages.withColumn("sender", F.lower("from_addr")).join(per_sender, "sender", "left").join(known, "content_hash", "left").join(allowed, ["casino", "d_domain"], "left")
    attached = F.col("content_hash").isNotNull()
    open_ = F.coalesce(F.col("from_addr") != "", F.lit(False)) & (F.col("pending") == 1) & attached & F.col("archived").isNull()
    taken = first_come(rows.where(open_).select("id", "sender", "content_hash"))
    rows = rows.join(taken.select("sender", F.col("id").alias("_done")), "sender", "left").join(taken.select("content_hash", F.col("id").alias("_stored")), "content_hash", "left")
    status = (
        F.when(F.coalesce(F.col("from_addr") == "", F.lit(True)), "no_from_address")
        .when(F.col("pending").isNull(), "no_participant")
        .when(F.col("pending") == 0, "no_pending_enrollment")
        .when(F.col("pending") > 1, "ambiguous_enrollment")
        .when(F.col("id") > F.col("_done"), "no_pending_enrollment")
        .when(~attached, "auto_replied")
        .when(F.col("archived") | (F.col("id") > F.col("_stored")), "duplicate")
        .otherwise("verified")
    )
    tier = evidence_tier(attached, signature_verdict(F.col("dkim")), covers_headers(F.col("signed_headers")), F.coalesce("allowed", F.lit(False)), F.col("has_image"))
    rows = rows.withColumn("status", status)
    return rows.select(
        "id",
        "status",
        F.when(F.col("status").isin("auto_replied", "duplicate", "verified"), F.col("enrollment_id")).alias("enrollment_id"),
        F.when(F.col("status").isin("auto_replied", "verified"), tier).alias("tier"),
    )
