from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import values
from ledgerspark.operators import ledger
from ledgerspark.sources.extractors import READS

NOW = datetime(2026, 9, 15, 12)


def reads(spark, rows):
    return spark.createDataFrame(rows, READS)


def row(run, frame, pos, ts, amount, balance, confidence=0.9, kind="bet"):
    return (run, frame, float(frame), pos, ts, kind, amount, balance, confidence)


def test_identical_reads_are_one_row(spark):
    got = ledger.stitch(reads(spark, [row(1, f, 0, "2026-09-15T12:00:00Z", 10.0, 100.0) for f in range(5)])).collect()
    assert len(got) == 1 and got[0].source_frame_ts == 0.0 and got[0].ordinal == 0


def test_noise_goes_and_order_is_first_seen(spark):
    data = [row(1, 0, 0, None, None, 5.0), row(1, 0, 1, "b", 2.0, None), row(1, 0, 2, "a", 1.0, None), row(1, 1, 0, "c", 3.0, None), row(1, 1, 1, "b", 2.0, None)]
    got = ledger.stitch(reads(spark, data)).orderBy("ordinal").collect()
    assert [r.timestamp for r in got] == ["b", "a", "c"]


@pytest.mark.parametrize("seen, kept", [([None, 0.0], None), ([None, 0.2], 0.2), ([0.5, 0.4], 0.5), ([0.5, None, 0.7], 0.7), ([0.0, None], 0.0)])
def test_confidence_of_the_best_read(spark, seen, kept):
    data = [row(1, f, 0, "t", 1.0, None, c) for f, c in enumerate(seen)]
    assert ledger.stitch(reads(spark, data)).first().confidence == kept


def test_row_key_treats_null_and_empty_alike_and_numbers_plainly(spark):
    one = spark.range(1).select(
        values.row_key(F.lit(None).cast("string"), F.lit("bet"), F.lit(10.0), F.lit(99.5)).alias("a"),
        values.row_key(F.lit(""), F.lit("bet"), F.lit(10), F.lit(99.50)).alias("b"),
        F.sha2(F.lit("|bet|10|99.5"), 256).alias("c"),
    ).first()
    assert one.a == one.b == one.c


def test_numbers_as_written(spark):
    seen = {10.004: "10.004", 10.0: "10", 10.5: "10.5", -0.25: "-0.25", 1e13: "10000000000000", 1e20: "100000000000000000000", 0.1: "0.1", 1234567.89: "1234567.89", 100.0: "100", 0.0: "0"}
    rows = spark.createDataFrame([(x,) for x in seen] + [(None,), (1e300,), (float("nan"),)], "x double").select("x", values.plain_number(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows[: len(seen)]} == seen
    assert [r.t for r in rows[len(seen) :]] == [None, "1.0E300", "NaN"]


def test_each_layout_of_times(spark):
    seen = ["2026-09-15T12:00:00.250Z", "2026-09-15T12:00:00+02", "2026-09-15T12:00:00", "2026-09-15 12:00:00", "2026-09-15", "soon", "", None, "2026-09-15T12:00", "15 Sep 2026", "2026-09-15t12:00:00z"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(seen)], "i int, x string")
    plain = F.coalesce(*(F.try_to_timestamp("x", F.lit(f)) for f in values.TIMESTAMP_FORMATS))
    got = rows.select(values.lenient_timestamp(F.col("x")).alias("a"), plain.alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a is None for r in got) == 5


@pytest.mark.parametrize("balances, amount, flagged", [((100, 90), 10, False), ((100, 50), 10, True), ((100, 110), -10, False), ((100, 90.02), 10, True), ((100, None), 10, False), ((None, 90), 10, False), ((100, 90), None, False)])
def test_arithmetic(spark, balances, amount, flagged):
    data = [row(1, 0, 0, "a", 1.0, balances[0] and float(balances[0])), row(1, 1, 0, "b", amount and float(amount), balances[1] and float(balances[1]))]
    got = ledger.arithmetic_flags(ledger.stitch(reads(spark, data))).collect()
    assert [(r.code, r.severity, r.item) for r in got] == ([("ARITHMETIC_MISMATCH", "high", 1)] if flagged else [])


def test_balances_are_not_carried_forward(spark):
    data = [row(1, 0, 0, "a", 1.0, 100.0), row(1, 1, 0, "b", 1.0, None), row(1, 2, 0, "c", 1.0, 50.0)]
    assert ledger.arithmetic_flags(ledger.stitch(reads(spark, data))).count() == 0


def test_future_times_are_strictly_later_than_five_minutes(spark):
    data = [row(1, i, 0, t, 1.0, None) for i, t in enumerate(["2026-09-15T12:05:00Z", "2026-09-15T12:05:00.001Z", "soon", "2026-09-16"])]
    got = ledger.future_flags(ledger.stitch(reads(spark, data)), NOW).collect()
    assert sorted(r.item for r in got) == [1, 3]


@pytest.mark.parametrize("minutes, flagged", [([0, 1, 2], False), ([0, 2, 1], True), ([0, 2], False), ([0, 1, 2, 3, 4, 3], False), ([0, 1, 2, 3, 2], True), ([0, 0, 0], False)])
def test_order_needs_more_than_a_fifth(spark, minutes, flagged):
    data = [row(1, i, 0, f"2026-09-15T12:{m:02}:00Z", float(i), None) for i, m in enumerate(minutes)]
    assert ledger.order_flags(ledger.stitch(reads(spark, data))).count() == flagged


def test_confidence_flag_once_per_run_and_strict(spark):
    data = [row(1, 0, 0, "a", 1.0, None, 0.49), row(1, 1, 0, "b", 1.0, None, 0.1), row(2, 0, 0, "a", 1.0, None, 0.5), row(3, 0, 0, "a", 1.0, None, None)]
    assert [r.run_id for r in ledger.confidence_flags(ledger.stitch(reads(spark, data))).collect()] == [1]


def test_reconciliation(spark):
    data = [row(1, 0, 0, "a", -5.0, 100.0, kind="Bet"), row(1, 1, 0, "b", 7.0, 93.0, kind="Better luck"), row(1, 2, 0, "c", 9.0, 102.0, kind="deposit"), row(1, 3, 0, "d", 3.0, None, kind=None)]
    runs = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "run_id long, enrollment_id long")
    grants = spark.createDataFrame([(11, 1000.0), (12, 0.0)], "enrollment_id long, amount double")
    got = {r.run_id: r for r in ledger.reconcile(runs, ledger.stitch(reads(spark, data)), grants).collect()}
    assert (got[1].wagered_total, got[1].delta, got[1].shortfall, got[1].arithmetic_ok) == (12.0, -988.0, True, True)
    assert (got[2].wagered_total, got[2].shortfall) == (0.0, False)
    assert (got[3].granted_amount, got[3].delta, got[3].shortfall) == (None, None, False)
    assert [r.run_id for r in ledger.shortfall_flags(ledger.reconcile(runs, ledger.stitch(reads(spark, data)), grants)).collect()] == [1]


def test_empty_reads(spark):
    rows = ledger.stitch(reads(spark, []))
    assert rows.count() == ledger.arithmetic_flags(rows).count() == ledger.order_flags(rows).count() == 0


def test_csv_fields(spark):
    cases = {"plain": "plain", 'a "b"': '"a ""b"""', "a,b": '"a,b"', "a\nb": '"a\nb"', "a\rb": "a\rb", None: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", values.csv_field(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_difference_hash(spark):
    falling = [9 - i for i in range(9)] * 8
    got = spark.createDataFrame([(falling,), ([0] * 72,), ([1, 0] + [0] * 70,)], "p array<int>").select(values.difference_hash(F.col("p")).alias("h")).collect()
    assert [r.h for r in got] == [-1, 0, -(2**63)]


def test_hash_text_and_distance(spark):
    r = spark.range(1).select(
        values.hash_from_hex(F.lit("ff00ff00ff00ff00")).alias("h"), values.hamming(values.hash_from_hex(F.lit("0")), values.hash_from_hex(F.lit("f" * 16))).alias("d")
    ).first()
    assert r.h == 0xFF00FF00FF00FF00 - 2**64 and r.d == 64


def test_all_flags_at_once_are_those_of_the_single_checks(spark):
    import random

    rnd = random.Random(8)
    data = []
    for run in range(40):
        for i in range(rnd.randint(0, 8)):
            ts = rnd.choice([None, "soon", *(f"2026-09-1{d}T12:0{m}:00Z" for d in (4, 5) for m in range(9))])
            data.append(row(run, i, 0, ts, rnd.choice([None, 1.0, 2.0]), rnd.choice([None, 10.0, 11.0, 12.0]), rnd.choice([None, 0.3, 0.9]), rnd.choice(["bet", "x", None])))
    rows = ledger.stitch(reads(spark, data))
    runs = spark.createDataFrame([(i, 100 + i) for i in range(45)], "run_id long, enrollment_id long")
    grants = spark.createDataFrame([(100 + i, float(i % 4)) for i in range(0, 45, 2)], "enrollment_id long, amount double")
    parts = [ledger.arithmetic_flags(rows), ledger.future_flags(rows, NOW), ledger.order_flags(rows), ledger.confidence_flags(rows), ledger.shortfall_flags(ledger.reconcile(runs, rows, grants))]
    want = sorted((tuple(r) for p in parts for r in p.collect()), key=str)
    assert sorted((tuple(r) for r in ledger.run_flags(runs, rows, grants, NOW).collect()), key=str) == want and len(want) > 50
