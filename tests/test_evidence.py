import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import evidence, lifecycle
from ledgerspark.operators.folds import fold
from ledgerspark.plans import search

T0 = datetime(2026, 1, 1)


@pytest.fixture
def domain(spark):
    make = spark.createDataFrame
    return SimpleNamespace(
        participant=make([(1, "ann", "a@x.example", T0), (2, "bob", "a@x.example", T0), (3, "cy", None, T0), (4, "di", "D@x.example", T0), (5, "ed", "", T0)], "id long, contact string, email string, created_at timestamp"),
        enrollment=make(
            [(10, 1, "c1", "email_verified", T0), (11, 1, "c1", "funded", T0), (12, 2, "c1", "invited", T0), (13, 3, "c2", "email_verified", T0), (14, 4, "c2", "email_submitted", T0), (15, 4, "c2", "closed", T0)],
            "id long, participant_id long, casino string, state string, created_at timestamp",
        ),
        submission=make(
            [(100, 10, "signup_email", "email", T0 + timedelta(seconds=60), 100, "h100"), (101, 13, "signup_email", "email", T0 + timedelta(seconds=59), 101, "h101"), (102, 11, "wager_recording", "dropbox", T0 + timedelta(days=31), 102, "h102"),
             (103, 13, "wager_recording", "manual_upload", T0, 103, "h103"), (104, 14, "signup_email", "email", T0 - timedelta(days=1), 104, "h104")],
            "id long, enrollment_id long, kind string, channel string, received_at timestamp, media_asset_id long, content_hash string",
        ),
        email_evidence=make([(100, "A", "pass", "s", "d", "A@X.EXAMPLE"), (101, "B", "fail", "s", "d", None), (104, "B", "pass", "s", "d", "other@x.example")], "submission_id long, tier string, dkim_result string, selector string, d_domain string, to_addr string"),
        grants=make([(11, 50.0, T0)], "enrollment_id long, amount double, sent_at timestamp"),
        integrity_flag=make([(1, 102, "LOW_CONFIDENCE", "warning"), (2, 102, "LOW_CONFIDENCE", "warning"), (3, 103, "MANUAL_INTAKE", "info")], "id long, submission_id long, code string, severity string"),
        media_asset=make([(i, f"h{i}", f"h{i}", 10, T0, None) for i in range(100, 105)] + [(99, "h99", "h99", 5, T0 - timedelta(days=999), None)], "id long, blob_key string, content_hash string, bytes long, created_at timestamp, deleted_at timestamp"),
    )


def test_prefunding_checks(domain):
    got = evidence.prefunding_checks(domain.enrollment, domain.enrollment, domain.participant, domain.submission, domain.email_evidence).collect()
    by = {(r.enrollment_id, r.code): r.passed for r in got}
    assert len(by) == len(got)
    assert by[10, "DUPLICATE_ENROLLMENT_EMAIL"] is False and by[14, "DUPLICATE_ENROLLMENT_EMAIL"] is True and (13, "DUPLICATE_ENROLLMENT_EMAIL") not in by
    assert by[10, "ALREADY_FUNDED"] is False and by[11, "ALREADY_FUNDED"] is True and by[14, "ALREADY_FUNDED"] is False and by[15, "ALREADY_FUNDED"] is True
    assert by[10, "RECIPIENT_MISMATCH"] is True and by[13, "RECIPIENT_MISMATCH"] is True and by[14, "RECIPIENT_MISMATCH"] is False and (11, "RECIPIENT_MISMATCH") not in by
    assert by[10, "SUBMISSION_TIMING"] is True and by[13, "SUBMISSION_TIMING"] is False and by[14, "SUBMISSION_TIMING"] is False


def test_simple_flags(domain):
    assert [r.run_id for r in evidence.gap_flags(domain.submission, domain.grants).collect()] == [102]
    late = domain.grants.withColumn("sent_at", F.lit(T0 + timedelta(days=17)).cast("timestamp"))
    assert evidence.gap_flags(domain.submission, late).count() == 0  # exactly 14 days
    assert [r.run_id for r in evidence.intake_flags(domain.submission).collect()] == [103]
    assert [r.run_id for r in evidence.sequence_flags(domain.submission, domain.enrollment).collect()] == [103]


def test_shared_rows_count_without_pairs(spark):
    rows = [(1, 1, "k"), (1, 1, "k"), (2, 1, "k"), (3, 2, "k"), (4, 3, "k"), (4, 3, "m"), (5, 4, "z")] + [(100 + i, 100 + i, "hot") for i in range(80)]
    got = {r.run_id: (r.n_matches, r.n_capped, r.n_participants) for r in evidence.shared_rows(spark.createDataFrame(rows, "run_id long, participant_id long, row_key string")).collect()}
    assert got[1] == (2, 2, 2) and got[2] == (2, 2, 2) and got[3] == (4, 4, 2) and got[4] == (4, 4, 2) and 5 not in got
    assert got[100] == (79, 50, 50) and len(got) == 84


def test_sharing_runs_are_those_of_shared_rows(spark):
    rows = [(1, 1, "k"), (1, 1, "k"), (2, 1, "k"), (3, 2, "k"), (5, 4, "z"), (6, 4, "z"), (7, None, "z"), (8, None, "k"), (9, 9, None), (10, 10, None)]
    frame = spark.createDataFrame(rows, "run_id long, participant_id long, row_key string")
    want = {r.run_id for r in evidence.shared_rows(frame).collect()}
    assert {r.run_id for r in evidence.sharing_runs(frame).collect()} == want == {1, 2, 3}
    assert evidence.sharing_runs(frame.limit(0)).count() == evidence.shared_rows(frame.limit(0)).count() == 0


def test_submission_flags_are_those_of_the_single_checks(spark, domain):
    from ledgerspark.plans import extraction

    formats = domain.submission.select(F.col("id").alias("submission_id"), "channel", F.lit("Lavf58").alias("encoder"))
    keyframes = domain.submission.select(F.col("id").alias("submission_id"), F.expr("array(0D, 1D, 2D, 3D, 30D)").alias("times"))
    parts = [
        evidence.gap_flags(domain.submission, domain.grants), evidence.intake_flags(domain.submission), evidence.sequence_flags(domain.submission, domain.enrollment),
        extraction.encoder_flags(formats), extraction.discontinuity_flags(keyframes, domain.submission),
    ]
    want = sorted((r.run_id, r.code, r.severity) for p in parts for r in p.collect())
    got = evidence.submission_flags(domain.submission, domain.grants, domain.enrollment, formats, keyframes)
    assert sorted((r.run_id, r.code, r.severity) for r in got.collect()) == want and len({w[1] for w in want}) >= 4
    assert evidence.submission_flags(domain.submission, domain.grants.limit(0), domain.enrollment.limit(0), formats.limit(0), keyframes.limit(0)).where("code <> 'MANUAL_INTAKE'").count() == 0


def test_retention(domain):
    now = T0 + timedelta(days=90)
    got = {r.id: r.decision for r in evidence.retention(domain.media_asset, domain.submission, domain.enrollment, now).collect()}
    assert got == {100: "deleted", 101: "deleted", 102: "deleted", 103: "deleted", 104: "deleted", 99: "skipped"}
    funded = domain.enrollment.withColumn("state", F.lit("funded"))
    got = {r.id: r.decision for r in evidence.retention(domain.media_asset, domain.submission, funded, now).collect()}
    assert (got[100], got[102]) == ("skipped", "deleted")


def test_quota(domain):
    assert evidence.quota(domain.media_asset, 61).first() == (55, True)
    assert evidence.quota(domain.media_asset, 62).first().warned is False and evidence.quota(domain.media_asset, None).first().warned is False


@pytest.mark.parametrize("root", ["/intake", "/intake/"])
def test_ingest_order(spark, domain, root):
    entries = spark.createDataFrame(
        [("/intake/10/a.mp4", True, "new"), ("/intake/10/b.mp4", True, "new"), ("/intake/10", False, None), ("/intake//x", True, "y"), ("/other/10/a", True, "z"), ("/intake/77/a", True, "w"), ("/intake/77/b", True, "h100"), ("/intake/readme", True, "q")],
        "path_lower string, is_file boolean, content_hash string",
    )
    got = {r.path_lower: (r.outcome, r.purge) for r in evidence.classify_entries(entries, domain.media_asset, domain.enrollment, root).collect()}
    assert got == {
        "/intake/10/a.mp4": ("ingested", True), "/intake/10/b.mp4": ("skipped", True), "/intake/10": ("ignored", False), "/intake//x": ("skipped", False),
        "/other/10/a": ("skipped", False), "/intake/77/a": ("skipped", False), "/intake/77/b": ("skipped", True), "/intake/readme": ("skipped", False),
    }


def test_routing_and_tiers(spark, domain):
    messages = spark.createDataFrame(
        [(1, None, "h", "pass", "a", "d", False), (2, "no@x", "h", "pass", "a", "d", False), (3, "A@x.example", "n1", "pass", "to:from:subject:date", "good", False), (4, "d@X.example", "n2", "pass", "To : From:Subject: DATE:x", "good", False),
         (5, "d@x.example", None, "none", None, None, True), (6, "d@x.example", None, None, None, None, False), (7, "d@x.example", "h100", "pass", "to", "good", False), (8, "d@x.example", "n3", "fail", "to:from:subject:date", "good", False), (9, "d@x.example", "n4", "pass", "to:from", "good", False)],
        "id long, from_addr string, content_hash string, dkim string, signed_headers string, d_domain string, has_image boolean",
    )
    allow = spark.createDataFrame([("c2", "good")], "casino string, domain string")
    alone = lambda i, enrollments: evidence.route_emails(messages.where(F.col("id") == i), domain.participant, enrollments, domain.media_asset, allow).first()
    got = {i: (r.status, r.tier) for i in range(1, 10) for r in [alone(i, domain.enrollment)]}
    assert got == {
        1: ("no_from_address", None), 2: ("no_participant", None), 3: ("verified", "B"), 4: ("verified", "A"), 5: ("auto_replied", "D"), 6: ("auto_replied", "C"),
        7: ("duplicate", None), 8: ("verified", "B"), 9: ("verified", "B"),
    }
    two = domain.enrollment.withColumn("state", F.lit("invited"))
    got = {r.id: r.status for r in evidence.route_emails(messages, domain.participant, two, domain.media_asset, allow).collect()}
    assert got[4] == "ambiguous_enrollment"
    none = domain.enrollment.withColumn("state", F.lit("closed"))
    assert {r.id: r.status for r in evidence.route_emails(messages, domain.participant, none, domain.media_asset, allow).collect()}[4] == "no_pending_enrollment"


def test_messages_of_a_batch_come_one_after_the_other(spark):
    rnd = random.Random(6)
    people = spark.createDataFrame([(i, f"p{i}@x") for i in range(12)], "id long, email string")
    waiting = spark.createDataFrame([(100 + i, i, "c", ["invited", "email_submitted", "closed"][i % 3]) for i in range(12)] + [(200, 4, "c", "invited")], "id long, participant_id long, casino string, state string")
    rows = [(k, f"P{rnd.randrange(12)}@x" if rnd.random() < 0.95 else None, rnd.choice([None, "old", *(f"h{i}" for i in range(9))])) for k in range(150)]
    messages = spark.createDataFrame([(*r, "pass", "to:from:subject:date", "d", False) for r in rows], "id long, from_addr string, content_hash string, dkim string, signed_headers string, d_domain string, has_image boolean")
    archive = {"old"}
    state = {100 + i: ["invited", "email_submitted", "closed"][i % 3] for i in range(12)}
    want, steps = {}, []
    for k, sender, h in rows:
        i = int(sender[1:-2]) if sender else None
        if sender is None:
            want[k] = "no_from_address"
        elif i == 4:
            want[k] = "ambiguous_enrollment"
        elif state[100 + i] not in evidence.AWAITING_EMAIL:
            want[k] = "no_pending_enrollment"
        elif h is None or h not in archive:
            want[k] = "auto_replied" if h is None else "verified"
            if state[100 + i] == "invited":
                steps.append((k, 100 + i, 1))
                state[100 + i] = "email_submitted"
            if h is not None:
                steps.append((k, 100 + i, 2))
                state[100 + i] = "email_verified"
                archive.add(h)
        else:
            want[k] = "duplicate"
    media = spark.createDataFrame([("old",)], "content_hash string")
    routed = evidence.route_emails(messages, people, waiting, media, spark.createDataFrame([], "casino string, domain string"))
    assert {r.id: r.status for r in routed.collect()} == want and "verified" in want.values()
    assert sorted((r.id, r.enrollment_id, r.step) for r in evidence.email_transitions(routed, waiting).collect()) == steps


def test_transitions(spark):
    rows = spark.createDataFrame([(a, b) for a in (*lifecycle.STATES, "odd") for b in lifecycle.STATES], "a string, b string")
    got = {(r.a, r.b): (r.o, r.s) for r in rows.select("a", "b", lifecycle.transition_outcome(F.col("a"), F.col("b")).alias("o"), lifecycle.transition_outcome(F.col("a"), F.col("b"), True).alias("s")).collect()}
    assert got["invited", "email_submitted"][0] == "legal" and got["invited", "funded"][0] == "illegal"
    assert got["invited", "closed"] == ("legal", "illegal") and got["wager_verified", "closed"] == ("legal", "legal")
    assert got["closed", "rejected"][0] == "already_terminal" and got["rejected", "invited"][0] == "illegal" and got["odd", "closed"][0] == "unknown_state"


def test_chain_detects_changes(spark):
    rows = spark.createDataFrame([(1, 7, "system", "a", "b", None, T0, "s"), (2, 7, "x", "b", "c", 'say "hi"', T0, "s"), (3, 7, "x", "c", "d", "n", T0 + timedelta(1), "s"), (4, 8, "x", "a", "b", None, T0, "s")],
                                 "id long, enrollment_id long, actor string, from_state string, to_state string, note string, at timestamp, snapshot string")
    chain = lifecycle.build_chain(rows)
    assert all(r.linked and r.intact for r in lifecycle.verify_chain(chain).collect())
    assert chain.where("prev_hash is null").count() == 2
    changed = lifecycle.verify_chain(chain.withColumn("note", F.when(F.col("id") == 2, "other").otherwise(F.col("note")))).collect()
    assert [r.id for r in changed if not r.intact] == [2]
    gone = lifecycle.verify_chain(chain.where("id <> 2")).collect()
    assert [r.id for r in gone if not r.linked] == [3]


def test_search_and_exports(domain):
    ids = lambda **f: [r.id for r in search.search_submissions(domain, **f).collect()]
    assert ids() == [102, 100, 101, 103, 104] and ids(casino="") == [] and ids(flag="") == ids()
    assert ids(flag="LOW_CONFIDENCE") == [102] and ids(state="funded") == [102] and ids(participant_id=4) == [104]
    assert ids(since=T0, until=T0 + timedelta(seconds=59)) == [101, 103]
    lines = {r.id: r.line for r in search.submissions_csv(domain).collect()}
    assert lines[102] == "102,1,ann,11,c1,funded,wager_recording,dropbox,2026-02-01T00:00:00.000Z,h102,,,LOW_CONFIDENCE;LOW_CONFIDENCE"
    asked = {"participant_id": "", "casino": "c2", "state": "closed", "flag": "X", "since": T0}
    assert {r.id for r in search.submissions_csv_for(domain, asked).collect()} == {100, 101, 102, 103}
    queue = search.funding_queue(domain).collect()
    assert [r.id for r in queue] == [10, 13] and len(queue[0].checks) == 4
    rows = search.search_with_relations(domain, participant_id=4).collect()
    assert rows[0].flags == [] and rows[0].email_evidence.tier == "B"


def test_upserts(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int")
    assert {tuple(r) for r in lifecycle.upsert(table, changes, ["k"], "at").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    fill = changes.where("v <> 'c'")
    assert {tuple(r) for r in lifecycle.upsert(table, fill, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "e")}


def test_transitions_in_order(spark, domain):
    asked = [(1, 12, "email_submitted", 1), (2, 12, "funded", 2), (3, 12, "email_verified", 3), (4, 12, "rejected", 4), (5, 12, "closed", 5), (7, 11, "wager_submitted", 1), (6, 11, "wager_submitted", 1), (8, 99, "closed", 1)]
    rows = spark.createDataFrame([(i, e, s, T0 + timedelta(t)) for i, e, s, t in asked], "id long, enrollment_id long, to_state string, at timestamp")
    got = {r.id: (r.from_state, r.outcome) for r in lifecycle.apply_transitions(rows, domain.enrollment).collect()}
    assert got == {
        1: ("invited", "legal"), 2: ("email_submitted", "illegal"), 3: ("email_submitted", "legal"), 4: ("email_verified", "legal"), 5: ("rejected", "already_terminal"),
        6: ("funded", "legal"), 7: ("wager_submitted", "illegal"), 8: (None, "unknown_state"),
    }


def test_folds_over_large_groups(spark):
    n = 25_000
    rows = spark.range(n).select((F.col("id") % 2 * F.when(F.col("id") % 10 == 3, None).otherwise(7)).alias("k"), "id", F.col("id").alias("v"))
    added = fold(rows, "k", ["id"], ["v"], lambda s, v: ((s or 0) + v, ((s or 0) + v, v)), "total long, same long")
    got = added.groupBy("k").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.count_if(F.col("same") == F.col("v")).alias("same")).collect()
    want = {}
    for i in range(n):
        k = None if i % 10 == 3 else i % 2 * 7
        want[k] = [want.get(k, [0, 0])[0] + 1, want.get(k, [0, 0])[1] + i]
    assert {r.k: [r.n, r.total] for r in got} == want and all(r.same == r.n for r in got)
    assert fold(rows.limit(0), "k", ["id"], ["v"], lambda s, v: (s, (v, v)), "total long, same long").count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_each_transition_is_judged_alike(spark, domain, strict):
    names = [*lifecycle.STATES, "other", None]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in pairs.withColumn("o", lifecycle.transition_outcome(F.col("a"), F.col("b"), strict)).collect():
        assert lifecycle._outcome(r.a, r.b, strict) == r.o


def test_a_chain_of_waiting_messages(spark, monkeypatch):
    """Each message waits for the one before: of 500 every other one is taken, in a number of jobs that hardly grows."""
    edges = spark.createDataFrame([(i, f"s{i // 2}", f"h{(i + 1) // 2}") for i in range(500)] + [(1000, "s0", "hx"), (1001, "sy", "hy")], "id long, sender string, content_hash string")
    cuts = []
    whole = evidence.cut
    monkeypatch.setattr(evidence, "cut", lambda df: cuts.append(1) or whole(df))
    assert {r.id for r in evidence.first_come(edges).collect()} == set(range(0, 500, 2)) | {1001}
    assert len(cuts) < 30
    assert evidence.first_come(edges.limit(0)).collect() == []
    assert {r.id for r in evidence.first_come(edges.where("id > 997")).collect()} == {1000, 1001}
