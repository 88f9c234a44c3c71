import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.config import Settings
from ledgerspark.functions import frames as fr
from ledgerspark.operators import evidence, lifecycle, media
from ledgerspark.plans import search
from ledgerspark.plans.process import SCHEMAS, Extraction, read_frames
from ledgerspark.plans.stored import Stored
from ledgerspark.sources.journal import Journal
from ledgerspark.sources.kept import MediaHashes, RowSums, bucket
from ledgerspark.sources.tables import Conflict, Tables

T0 = datetime(2026, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, (tmp_path / "a store").as_uri().replace("%20", " "))


def test_commits_show_whole_or_not_at_all(spark, tables):
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    assert tables.publish("a", {"t": one, "u": two}) == 1 == tables.publish("a", {"t": two, "u": two})
    before = tables.state()
    assert tables.publish("b", {"t": two}) == 2
    assert sorted(r.x for r in tables.read("t", "x int").collect()) == [1, 2] and [r.x for r in tables.read("t", "x int", before).collect()] == [1]
    assert tables.read("none", "x int").collect() == [] and tables.state(1).keys == {"a": 1}
    # files that no commit names aren't there
    tables.write("t", one)
    assert tables.read("t", "x int").count() == 2
    # a number is had once
    assert not tables._put(f"{2:012}.json", {}) and tables._put(f"{9:012}.json", {"key": "z", "add": {}, "drop": {}})


def test_many_commits_are_summed_up(spark, tables):
    for i in range(70):
        tables.commit(f"k{i}", {"t": [{"path": f"p{i}"}]}, {"t": [f"p{i - 1}"]} if i % 2 else None)
    names = tables._names()
    assert [n for n in names if n.endswith(".all")] == [f"{32:012}.all", f"{64:012}.all"]
    now = tables.state()
    assert now.number == 70 and [f["path"] for f in now.files["t"]] == [f"p{i}" for i in range(70) if i % 2] and len(now.keys) == 70
    assert tables.state(33).number == 33


def test_two_writers(spark, tables):
    tables.commit("first", {"t": [{"path": "p"}]})
    base = tables.state().number
    tables.commit("other", {"u": [{"path": "q"}]})
    assert tables.commit("mine", {"t": [{"path": "r"}]}, base=base, clash=lambda c: "t" in c["add"]) == 3
    with pytest.raises(Conflict):
        tables.commit("late", {"t": [{"path": "s"}]}, base=base, clash=lambda c: "t" in c["add"])
    assert [f["path"] for f in tables.state().files["t"]] == ["p", "r"]


def test_upserts_rewrite_only_touched_files(spark, tables, monkeypatch):
    monkeypatch.setattr("ledgerspark.sources.tables.FILE_ROWS", 25)
    schema = "id int, name string, at int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert tables.upsert("g", schema, frame([(i, "old", 0) for i in range(1000, 1100)]), ["id"], "at") == []
    files = {f["path"] for f in tables.state().files["g"]}
    reader, state = tables.read("g", schema), tables.state()
    gone = tables.upsert("g", schema, frame([(1003, "new", 2), (1003, "mid", 1), (1004, "new", 1), (2000, "far", 1)]), ["id"], "at")
    now = {f["path"] for f in tables.state().files["g"]}
    assert len(files) > 2 and len(gone) == 1 and files - set(gone) < now
    got = {r.id: r.name for r in tables.read("g", schema).collect()}
    assert len(got) == 101 and {i for i, n in got.items() if n != "old"} == {1003, 1004, 2000} and got[1003] == "new"
    # who began to read before sees what was there
    assert {r.name for r in reader.collect()} == {"old"} and tables.read("g", schema, state).count() == 100
    # without an order a change only fills a missing key
    tables.upsert("g", schema, frame([(1005, "x", 9), (3000, "x", 9)]), ["id"])
    assert {r.id: r.name for r in tables.read("g", schema).collect()} == got | {3000: "x"}
    # settings are a row of such a table
    for days in (90, 30):
        tables.upsert("retention_settings", "id string, days int, at int", spark.createDataFrame([("default", days, -days)], "id string, days int, at int"), ["id"], "at")
    assert [tuple(r) for r in tables.read("retention_settings", "id string, days int, at int").collect()] == [("default", 30, -30)]


def test_what_staff_set_is_stored(spark, tables):
    stored = Stored(tables)
    assert stored.settings() == Settings() and stored.grants().count() == 0
    assert stored.set_retention(T0, raw_media_days=10).raw_media_retention_days == 10
    assert stored.set_retention(T0 - timedelta(days=1), funded_email_days=20) == Settings(raw_media_retention_days=10, funded_email_evidence_retention_days=20) == Stored(tables).settings()
    with pytest.raises(ValueError, match="at least a day"):
        stored.set_retention(T0, raw_media_days=0)
    grants = lambda rows: spark.createDataFrame(rows, "enrollment_id long, amount double, sent_at timestamp, method string, updated_at timestamp")
    stored.set_grants(grants([(1, 5.0, T0, None, T0), (2, 7.5, T0, "wire", T0), (1, 6.0, T0, "wire", T0 + timedelta(1)), (None, 1.0, T0, None, T0)]))
    stored.set_grants(grants([(2, 9.25, T0, None, T0)]))
    assert {r.enrollment_id: (float(r.amount), r.method) for r in stored.grants().collect()} == {"1": (6.0, "wire"), "2": (9.25, None)}
    signers = lambda rows: spark.createDataFrame(rows, "casino string, domain string")
    stored.allow(signers([("c", "a.example"), ("c", "a.example"), ("d", "a.example")]))
    stored.allow(signers([("c", "a.example"), ("c", "b.example"), (None, "x")]))
    assert sorted(map(tuple, stored.signers().collect())) == [("c", "a.example"), ("c", "b.example"), ("d", "a.example")]


def test_participants_enrollments_and_file_requests_are_stored(spark, tables):
    stored = Stored(tables)
    people = lambda rows: spark.createDataFrame(rows, "id long, contact string, email string, created_at timestamp")
    refused = stored.add_participants(people([(1, "a", "a@b.example", T0), (2, None, None, T0), (3, "c", "c@b", T0), (None, "d", None, T0), (4, "e", "a@b.example\n", T0), (5, "f", "", T0)]))
    assert {(r.id, r.error) for r in refused.collect()} == {("3", "not an e-mail address"), (None, "no id"), ("4", "not an e-mail address"), ("5", "not an e-mail address")}
    stored.add_participants(people([(1, "other", None, T0), (6, "g", None, T0)]))  # who is there stays as they are
    assert {r.id: (r.contact, r.email) for r in stored.participants().collect()} == {"1": ("a", "a@b.example"), "2": (None, None), "6": ("g", None)}

    enroll = lambda rows: stored.enroll(spark.createDataFrame(rows, "id long, participant_id long, casino string, created_at timestamp"))
    refused = enroll([(10, 1, "c", T0), (11, 3, "c", T0), (12, 2, "", T0), (13, 2, None, T0), (14, None, "c", T0), (10, 1, "c", T0)])
    assert {(r.id, r.error) for r in refused.collect()} == {("11", "participant not found"), ("12", "no casino"), ("13", "no casino"), ("14", "participant not found")}
    tables.upsert("enrollment", "id string, participant_id string, casino string, state string, created_at timestamp", stored.enrollments().withColumn("state", F.lit("funded")), ["id"], "created_at")
    assert enroll([(10, 1, "c", T0), (15, 2, "d", T0)]).count() == 0
    assert {(r.id, r.participant_id, r.state) for r in stored.enrollments().collect()} == {("10", "1", "funded"), ("15", "2", "invited")}

    asked = []

    def ask(rows):
        asked.extend(map(tuple, rows.collect()))
        return rows.select("id", F.concat(F.lit("service-"), "id").alias("request_id"), F.concat(F.lit("https://x.example/"), "id").alias("url"))

    request = lambda rows, how: stored.request_files(spark.createDataFrame(rows, "id string, enrollment_id long, created_at timestamp"), "/in/", how)
    refused = request([("r1", 10, T0), ("r2", 15, T0), ("r3", 99, T0), ("r1", 10, T0)], lambda rows: ask(rows.where("id = 'r1'")))
    assert {(r.id, r.error) for r in refused.collect()} == {("r2", "no answer"), ("r3", "no enrollment 99")}
    assert request([("r1", 10, T0), ("r2", 15, T0)], ask).count() == 0
    assert asked == [("r1", "/in/10", "Verification evidence, c"), ("r2", "/in/15", "Verification evidence, d")]
    assert {(r.id, r.request_id, r.url, r.destination_path) for r in stored.file_requests().collect()} == {(r, f"service-{r}", f"https://x.example/{r}", f"/in/{e}") for r, e in (("r1", 10), ("r2", 15))}


def test_staff_come_and_go(spark, tables):
    stored = Stored(tables)
    first, token = stored.add_staff("Ann", "ops", T0)
    second, other = stored.add_staff("Bo", "admin", T0)
    for name, role in (("", "ops"), ("Cy", "reviewer")):
        with pytest.raises(ValueError, match="role"):
            stored.add_staff(name, role, T0)
    assert [r.id for r in search.staff_by_token(stored.staff(), token).collect()] == [first] and token != other
    assert not stored.staff().where(F.col("token_hash").isin(token, other)).count()
    stored.remove_staff(first)
    stored.remove_staff("nobody")
    assert [(r.id, r.name, r.role) for r in stored.staff().collect()] == [(second, "Bo", "admin")]


def test_a_writer_that_finds_another_starts_again(spark, tables, monkeypatch):
    schema = "id int, n int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    tables.upsert("g", schema, frame([(1, 0), (2, 0)]), ["id"], "n")
    whole, other = Tables._ranged, []

    def meanwhile(self, table, rows, keys):
        made = whole(self, table, rows, keys)
        if not other:
            other.append(1)
            Tables(spark, self.root).upsert("g", schema, frame([(1, 5), (3, 5)]), ["id"], "n")
        return made

    monkeypatch.setattr(Tables, "_ranged", meanwhile)
    tables.upsert("g", schema, frame([(2, 7)]), ["id"], "n")
    assert sorted(map(tuple, tables.read("g", schema).collect())) == [(1, 5), (2, 7), (3, 5)]


def plain_hash(width, height, gray):
    from fractions import Fraction

    small = []
    for j in range(8):
        for i in range(9):
            total = Fraction(0)
            for y in range(height):
                for x in range(width):
                    across = min(Fraction((i + 1) * width, 9), x + 1) - max(Fraction(i * width, 9), x)
                    down = min(Fraction((j + 1) * height, 8), y + 1) - max(Fraction(j * height, 8), y)
                    if across > 0 and down > 0:
                        total += across * down * gray[y * width + x]
            small.append((total / Fraction(width * height, 72) + Fraction(1, 2)).__floor__())
    bits = 0
    for j in range(8):
        for i in range(8):
            bits = bits << 1 | (small[9 * j + i] > small[9 * j + i + 1])
    return bits - (1 << 64 if bits >> 63 else 0)


def test_hashes_of_gray_frames(spark):
    rng = np.random.default_rng(3)
    sizes = [(9, 8), (18, 16), (1, 1), (7, 5), (31, 17), (16, 4), (40, 3)]
    rows = [(w, h, rng.integers(0, 256, w * h, dtype=np.uint8).tobytes()) for w, h in sizes for _ in range(3)] + [(2, 2, b"\0\1\2"), (None, 2, b"ab"), (2, 1, None), (0, 0, b"")]
    got = spark.createDataFrame(rows, "w int, h int, g binary").select("w", "h", "g", fr.difference_hash(F.col("w"), F.col("h"), F.col("g")).alias("d")).collect()
    assert [r.d for r in got] == [plain_hash(*r) for r in rows[:-4]] + [None] * 4
    assert fr.pgm(b"P5\n# made by hand\n3 2\n255\nabcdef") == (3, 2, b"abcdef")
    for bad in (b"P6 3 2 255\nabcdef", b"P5 3 2 65535\nabcdef", b"P5 3"):
        with pytest.raises(ValueError):
            fr.pgm(bad)


def near_hashes(rnd, n):
    base = [rnd.getrandbits(64) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        h = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 1, 3, 5, 6, 9])):
            h ^= 1 << rnd.randrange(64)
        out.append(h - (1 << 64 if h >> 63 else 0))
    return out


def test_kept_hashes_find_what_all_pairs_do(spark, tables):
    rnd = random.Random(6)
    assets = [(f"m{i:03}", h, T0 + timedelta(hours=rnd.randrange(40))) for i, h in enumerate(near_hashes(rnd, 120))] + [("none", None, T0)]
    frame = lambda rows: spark.createDataFrame(rows, "media_asset_id string, dhash long, stored_at timestamp")
    index = MediaHashes(tables)
    order = sorted(assets, key=lambda a: (a[2], a[0]))
    found = {}
    for k, at in enumerate(range(0, len(order), 41)):
        batch = frame(order[at : at + 41])
        found |= {r.media_asset_id: (r.match_id, r.distance) for r in index.duplicates(batch).collect()}
        tables.publish(f"b{k}", index.additions(batch), dict.fromkeys(("media_hash", "hash_band"), ["bucket"]))
    want = media.duplicate_media(frame(assets).select(F.col("media_asset_id").alias("id"), "dhash", "stored_at", F.col("stored_at").alias("checked_at")))
    assert found == {r.id: (r.match_id, r.distance) for r in want.collect()} and len(found) > 20
    # in any order of batches, all pairs are found from either side
    mixed, seen = list(assets), set()
    rnd.shuffle(mixed)
    other = MediaHashes(Tables(spark, tables.root + "/other"))
    for k in range(0, len(mixed), 40):
        batch = frame(mixed[k : k + 40])
        seen |= {(min(r.dhash, r.other), max(r.dhash, r.other)) for r in other.pairs(batch).collect()}
        other.media.tables.publish(f"b{k}", other.additions(batch), dict.fromkeys(("media_hash", "hash_band"), ["bucket"]))
    assert seen == {(r.hash_a, r.hash_b) for r in media.near_pairs(frame(assets)).collect()}
    index.bands.compact()
    index.media.compact()
    state = tables.state()
    assert len(state.files["hash_band"]) == len(state.files["media_hash"]) == 1 and index.pairs(frame(assets)).count() == 2 * len(seen)


def test_a_batch_reads_only_its_buckets(spark, tables):
    index = MediaHashes(tables)
    rows = spark.createDataFrame([(f"m{i}", i * 0x9E3779B97F4A7C15 % 2**63, T0) for i in range(200)], "media_asset_id string, dhash long, stored_at timestamp")
    tables.publish("b", index.additions(rows), dict.fromkeys(("media_hash", "hash_band"), ["bucket"]))
    asked = rows.where("media_asset_id = 'm7'")
    hit = {r[0] for r in media.bands(asked.select("dhash")).select(bucket("choice", "value")).distinct().collect()}
    from pathlib import Path
    from urllib.parse import unquote, urlparse

    root = Path(unquote(urlparse(tables.state().files["hash_band"][0]["path"]).path))
    others = [p for p in root.glob("bucket=*/*.parquet") if int(p.parent.name.split("=")[1]) not in hit]
    assert len(hit) <= 21 and len(others) > 100
    for p in others:
        p.write_bytes(b"not to be read")
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    assert index.duplicates(asked.withColumn("media_asset_id", F.lit("new")).withColumn("stored_at", F.lit(T0 + timedelta(days=1)))).first().match_id == "m7"
    plan = index.bands.near(media.bands(asked.select("dhash")))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters", 1)[1].split("PushedFilters")[0]


@pytest.mark.parametrize("order", [0, 1, 2])
def test_kept_sums_equal_shared_rows(spark, tmp_path, order):
    rnd = random.Random(order)
    runs = {f"r{i}": [(f"r{i}", f"p{i % 9}" if i % 13 else None, f"k{rnd.randrange(40)}") for _ in range(rnd.randint(0, 12))] for i in range(40)}
    redone = {f"r{i}": [(f"r{i}", f"p{i % 9}", f"k{rnd.randrange(40)}") for _ in range(5)] for i in (3, 4, 17)}
    frame = lambda rows: spark.createDataFrame(rows, "run_id string, participant_id string, row_key string")
    tables = Tables(spark, (tmp_path / "sums").as_uri())
    sums, names = RowSums(tables), list(runs)
    rnd.shuffle(names)
    for k in range(0, 40, 14):
        tables.publish(f"b{k}", sums.additions(frame([r for n in names[k : k + 14] for r in runs[n]])), {"row_sum": ["bucket"]})
    for n, rows in redone.items():  # what a run had before goes, what it has now comes
        tables.publish(f"undo {n}", sums.additions(frame(runs[n]), -1), {"row_sum": ["bucket"]})
        tables.publish(f"redo {n}", sums.additions(frame(rows)), {"row_sum": ["bucket"]})
        runs[n] = rows
        if order == 1:
            sums.compact()
    everything = frame([r for rows in runs.values() for r in rows])
    want = sorted(map(tuple, evidence.shared_rows(everything).collect()))
    assert sorted(map(tuple, sums.shared(everything).collect())) == want and len(want) > 20
    some = everything.where("run_id in ('r1', 'r17', 'r30')")
    assert sorted(map(tuple, sums.shared(some).collect())) == [w for w in want if w[0] in ("r1", "r17", "r30")]
    sums.compact()
    assert sorted(map(tuple, sums.shared(everything).collect())) == want and tables.read("row_sum", sums.sums.schema).where("n <= 0").count() == 0


# --- the extraction job, over recordings of a made format: "frame,frame,..." each "hash:row;row"


def framed(contents):
    def run(batches):
        import pandas as pd

        for batch in batches:
            for run_id, content in batch.itertuples(index=False, name=None):
                if bytes(content) == b"broken":
                    yield pd.DataFrame([{"run_id": run_id, "error": "no frames in it"}])
                    continue
                for i, f in enumerate(bytes(content).decode().split(",")):
                    h, _, rows = f.partition(":")
                    yield pd.DataFrame([{"run_id": run_id, "frame_index": i, "frame_ts": i * 1.5, "image": rows.encode(), "dhash": int(h), "error": None}])

    return contents.mapInPandas(lambda b: (x.reindex(columns=["run_id", "frame_index", "frame_ts", "image", "dhash", "error"]).astype({"dhash": "Int64", "frame_index": "Int32"}) for x in run(b)), "run_id string, frame_index int, frame_ts double, image binary, dhash long, error string")


def probed(contents):
    return contents.select("run_id", F.lit("Lavf58").alias("encoder"), F.array(*map(F.lit, [0.0, 1.0, 2.0, 9.0])).alias("times"), F.lit(None).cast("string").alias("error"))


def reader():
    # made here, so that it goes to the workers by value
    def read(shown):
        if any(image == b"raise" for _, _, image in shown):
            raise RuntimeError("the model is away")
        rows = []
        for i, _, image in shown:
            for r in image.decode().split(";") if image else ():
                amount, balance, sure = (float(x) if x else None for x in r.split("/"))
                rows.append({"frame_index": i, "timestamp": "2026-01-01T00:00:00Z", "type": "bet", "amount": amount, "balance_after": balance, "confidence": sure})
        return rows, 100 * len(shown), 7

    return read


HASHES = [random.Random(i).getrandbits(62) for i in range(5)]
A = f"{HASHES[0]}:10/90/0.9;5/80/0.2,{HASHES[0] ^ 3}:99/1/0.9,{HASHES[1]}:10/70/0.9"  # its second frame is like the first one
CONTENTS = {"h1": A, "h2": f"{HASHES[0] ^ 1}:10/90/0.9", "h3": "broken", "h5": f"{HASHES[2]}:raise", "h6": f"{HASHES[3]}:"}


def inputs(spark):
    subs = [(i, e, ch, "wager_recording", i + 100, f"h{i}", T0 + timedelta(days=20, hours=i)) for i, e, ch in [(1, 10, "dropbox"), (2, 11, "dropbox"), (3, 10, "dropbox"), (4, 11, "manual_upload"), (5, 10, "manual_upload"), (6, 12, "manual_upload")]]
    submissions = spark.createDataFrame(subs, "id long, enrollment_id long, channel string, kind string, media_asset_id long, content_hash string, received_at timestamp")
    enrollments = spark.createDataFrame([(10, 1, "funded"), (11, 2, "funded"), (12, 3, "invited")], "id long, participant_id long, state string")
    grants = spark.createDataFrame([(10, 100.0, T0), (11, 5.0, T0 + timedelta(days=19))], "enrollment_id long, amount double, sent_at timestamp")
    contents = spark.createDataFrame([(k, v.encode()) for k, v in CONTENTS.items()], "content_hash string, content binary")
    return submissions, enrollments, grants, contents


def all_rows(job):
    runs = {r.id: r.submission_id for r in job.table("extraction_run").collect()}
    out = {"extraction_run": sorted((r.submission_id, r.status, r.error, r.input_tokens, r.output_tokens) for r in job.table("extraction_run").collect())}
    out["transaction_row"] = sorted((runs[r.run_id], r.ordinal, r.amount, r.balance_after, r.source_frame_ts, r.confidence) for r in job.table("transaction_row").collect())
    out["reconciliation"] = sorted((runs[r.run_id], r.n_rows, r.wagered_total, r.delta, r.arithmetic_ok) for r in job.table("reconciliation").collect())
    out["integrity_flag"] = sorted((r.submission_id, r.code, r.detail) for r in job.table("integrity_flag").collect())
    out["media_hash"] = sorted((r.media_asset_id, r.dhash, r.source_meta) for r in job.tables.read("media_hash", job.hashes.media.schema).collect())
    return out


WANT = {
    "extraction_run": [("1", "succeeded", None, 200, 7), ("2", "succeeded", None, 100, 7), ("3", "failed", "no frames in it", None, None), ("4", "failed", "no content h4", None, None), ("5", "failed", "the model is away", None, None), ("6", "succeeded", None, 100, 7)],
    "transaction_row": [("1", 0, 10.0, 90.0, 0.0, 0.9), ("1", 1, 5.0, 80.0, 0.0, 0.2), ("1", 2, 10.0, 70.0, 3.0, 0.9), ("2", 0, 10.0, 90.0, 0.0, 0.9)],
    "reconciliation": [("1", 3, 25.0, -75.0, False), ("2", 1, 10.0, 5.0, True), ("6", 0, 0.0, None, True)],
    "media_hash": sorted([("101", HASHES[0], f'{{"dHash":"{HASHES[0]:x}"}}'), ("102", HASHES[0] ^ 1, f'{{"dHash":"{HASHES[0] ^ 1:x}"}}')]),
}
CODES = [
    ("1", "ARITHMETIC_MISMATCH"), ("1", "ENCODER_MISMATCH"), ("1", "FRAME_DISCONTINUITY"), ("1", "LOW_CONFIDENCE"), ("1", "SHARED_ROWS"), ("1", "SUBMISSION_GAP"), ("1", "WAGER_SHORTFALL"),
    ("2", "DUPLICATE_MEDIA"), ("2", "ENCODER_MISMATCH"), ("2", "FRAME_DISCONTINUITY"), ("2", "SHARED_ROWS"),
]


def test_extraction_in_one_commit(spark, tables, monkeypatch):
    make = lambda: Extraction(tables, reader(), "v1", frames=framed, probe=probed)
    job, now = make(), datetime(2026, 3, 1)
    # a crash before any of the writes, or before the commit, shows nothing
    whole = Tables.write
    for dies in (0, 2, 6):
        left = [dies]

        def failing(self, table, rows, partition=None, left=left):
            if not left[0]:
                raise OSError("lost")
            left[0] -= 1
            return whole(self, table, rows, partition)

        monkeypatch.setattr(Tables, "write", failing)
        with pytest.raises(OSError, match="lost"):
            job.run("b1", *inputs(spark), now)
        assert tables.state().files == {} and job.table("integrity_flag").count() == 0
    monkeypatch.undo()
    monkeypatch.setattr(Tables, "_put", lambda self, name, value: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        job.run("b1", *inputs(spark), now)
    monkeypatch.undo()
    assert tables.state().number == 0 and make().table("extraction_run").count() == 0
    assert make().run("b1", *inputs(spark), now) == 1
    got = all_rows(job)
    assert {k: got[k] for k in WANT} == WANT and [(s, c) for s, c, _ in got["integrity_flag"]] == CODES
    details = {(s, c): d for s, c, d in got["integrity_flag"]}
    assert details["1", "ARITHMETIC_MISMATCH"].endswith(": the balance moved by 10.00, the amount is 5.00") and details["1", "WAGER_SHORTFALL"] == "wagered 25.00 of 100.00 granted"
    assert details["1", "LOW_CONFIDENCE"] == "1 of 3 rows were read with a confidence under 0.5" and details["2", "DUPLICATE_MEDIA"] == "like media 101, 1 bits apart" and details["1", "SUBMISSION_GAP"].startswith("20.0 days")
    assert details["1", "FRAME_DISCONTINUITY"] == "1 of 3 keyframe intervals are far from their median of 1.00 s" and details["1", "SHARED_ROWS"] == "1 rows are also in recordings of 1 other participants"
    # the same batch again adds nothing; another one meets what is published
    assert make().run("b1", *inputs(spark), now) == 1 and all_rows(job) == got
    subs, enrollments, grants, _ = inputs(spark)
    late = subs.where("id = 6").withColumns({"id": F.lit(7), "channel": F.lit("dropbox"), "media_asset_id": F.lit(107), "content_hash": F.lit("h7")})
    more = spark.createDataFrame([("h7", f"{HASHES[0] ^ 6}:10/90/0.9".encode())], "content_hash string, content binary")
    job.run("b2", late, enrollments, grants, more, now)
    new = [(c, d) for s, c, d in all_rows(job)["integrity_flag"] if s == "7"]
    assert [c for c, _ in new] == ["DUPLICATE_MEDIA", "ENCODER_MISMATCH", "FRAME_DISCONTINUITY", "SHARED_ROWS"] and dict(new)["SHARED_ROWS"] == "2 rows are also in recordings of 2 other participants"
    assert dict(new)["DUPLICATE_MEDIA"] == "like media 101, 2 bits apart" and set(job.tables.state().files) >= set(SCHEMAS)
    assert job.run("b3", subs.limit(0), enrollments, grants, more, now) == 3


def test_runs_pass_a_reader_as_one_stream(spark):
    rnd, frames, want = random.Random(2), [], {}
    for n in range(300):
        last, shown, values = None, [], [rnd.choice([None, *HASHES]) for _ in range(rnd.randint(1, 6))]
        values = [v if v is None else v ^ rnd.choice([0, 1, 0xFFFF]) for v in values]
        for i, v in enumerate(values):
            frames.append((f"r{n:03}", i, i * 1.5, f"{n}".encode(), v))
            if last is None or None in (last[0], v) or (last[0] ^ v).bit_count() > 4:
                shown.append(i)
                last = (v,)
        reads = [(i, i * 1.5, k, float(n)) for i in shown for k in (0, 1)] + [(99, 0.0, 0, float(n))]
        error = {7: "away", 8: "wrong", 9: "'frame_index'"}.get(n)
        want[f"r{n:03}"] = (values[0], error and error != "wrong" and error, None if error else len(shown), [] if error else reads)

    def read(shown):
        n = int(shown[0][2])
        if n == 7:
            raise RuntimeError("away")
        amount = "ten" if n == 8 else n  # no number: the run's error, not the job's
        return [{} if n == 9 else {"frame_index": i, "amount": amount} for i, _, _ in shown for _ in (0, 1)] + [{"frame_index": 99, "amount": amount}], len(shown), 1

    rnd.shuffle(frames)
    table = spark.createDataFrame(frames, "run_id string, frame_index int, frame_ts double, image binary, dhash long")
    got = {r.run_id: (r.dhash, r.error, r.input_tokens, [(x.frame_index, x.frame_ts, x.row_pos, x.amount) for x in r.reads]) for r in read_frames(table, read, 4).collect()}
    assert got.pop("r008")[1] and want.pop("r008") and got == want
    # a run costs as much as its frames do, with nothing beside for a group
    many = spark.range(40_000).select(F.col("id").cast("string").alias("run_id"), F.lit(0).alias("frame_index"), F.lit(0.0).alias("frame_ts"), F.lit(b"1").alias("image"), F.col("id").alias("dhash"))
    began = time.monotonic()
    assert read_frames(many, read, 4).agg(F.sum("input_tokens")).first()[0] == 40_000 and time.monotonic() - began < 30


def test_two_writers_of_a_journal(spark, tmp_path, monkeypatch):
    path = (tmp_path / "journal").as_uri()
    rows = lambda *steps: spark.createDataFrame([(e, a, b, "staff", None, T0 + timedelta(hours=h), None) for e, a, b, h in steps], "enrollment_id string, from_state string, to_state string, actor string, note string, at timestamp, snapshot string")
    one, two = Journal(spark, path), Journal(spark, path)
    one.append(rows(("1", "invited", "email_submitted", 0), ("2", "invited", "email_submitted", 0)))
    whole, did, others = Tables.write, [], [("1", "email_submitted", "email_verified", 1), ("3", "invited", "email_submitted", 1)]

    def meanwhile(self, table, chained, partition=None):
        files = whole(self, table, chained, partition)
        if not did:  # another writer comes between: on the same enrollment, and on another one
            did.append(1)
            two.append(rows(*others))
        return files

    monkeypatch.setattr(Tables, "write", meanwhile)
    one.append(rows(("1", "email_submitted", "email_verified", 2), ("1", "email_verified", "funded", 3), ("2", "email_submitted", "email_verified", 2)))
    monkeypatch.undo()
    table = one.table()
    assert sorted((r.enrollment_id, r.to_state) for r in table.collect()) == [("1", "email_submitted"), ("1", "email_verified"), ("1", "funded"), ("2", "email_submitted"), ("2", "email_verified"), ("3", "email_submitted")]
    assert {(r.linked, r.intact) for r in lifecycle.verify_chain(table).collect()} == {(True, True)}
    # writers on other enrollments don't start again
    did.clear()
    others[:], calls = [("3", "email_submitted", "email_verified", 8)], []
    monkeypatch.setattr(Tables, "write", meanwhile)
    monkeypatch.setattr("ledgerspark.sources.journal.build_chain", lambda *a: calls.append(1) or lifecycle.build_chain(*a))
    one.append(rows(("9", "invited", "email_submitted", 9)))
    monkeypatch.undo()
    assert len(calls) == 2 and one.table().count() == 8
    # twice the same, or after a terminal state, adds nothing
    one.append(rows(("9", "invited", "email_submitted", 9)))
    one.append(rows(("9", "email_submitted", "rejected", 10)))
    one.append(rows(("9", "rejected", "abandoned", 11), ("9", "email_submitted", "email_verified", 11)))
    assert [r.to_state for r in one.table().where("enrollment_id = '9'").orderBy("at").collect()] == ["email_submitted", "rejected"]
