import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import lifecycle
from ledgerspark.streaming import states

T0 = datetime(2026, 1, 1)
REQUEST = "id long, enrollment_id long, to_state string, actor string, note string, at timestamp, snapshot string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, states.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def test_states_as_a_stream_equal_the_batch(rocks, tmp_path):
    rnd = random.Random(2)
    enrollments = rocks.createDataFrame([(i, rnd.choice(lifecycle.STATES[:4])) for i in range(12)], "id long, state string")
    requests = [(i, rnd.randrange(14), rnd.choice([*lifecycle.STATES, "nowhere", None]) if rnd.random() < 0.4 else lifecycle.STATES[1 + i // 25], "staff", rnd.choice([None, 'a "note", é\n']), T0 + timedelta(minutes=rnd.randrange(3) + 10 * (i // 40)), rnd.choice([None, "{}"])) for i in range(160)]
    source, out = tmp_path / "in", (tmp_path / "out").as_uri()
    source.mkdir()

    def start():
        stream = rocks.readStream.schema(REQUEST).parquet(source.as_uri())
        query = states.decide(stream, enrollments).writeStream.format("parquet").option("checkpointLocation", (tmp_path / "checkpoint").as_uri()).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()

    for k in range(0, 160, 80):  # started anew for each part
        rocks.createDataFrame(requests[k : k + 80], REQUEST).coalesce(1).write.mode("append").parquet(source.as_uri())
        start()
    start()
    got = rocks.read.parquet(out)
    frame = rocks.createDataFrame(requests, REQUEST)
    want = lifecycle.apply_transitions(frame, enrollments.withColumn("id", F.col("id")))
    assert {(r.id, r.from_state, r.outcome) for r in got.collect()} == {(r.id, r.from_state, r.outcome) for r in want.collect()} and got.count() == 160
    legal = want.where("outcome = 'legal'").select("id", "from_state").join(frame.withColumn("enrollment_id", F.col("enrollment_id").cast("string")), "id")
    chain = {r.id: (r.prev_hash, r.hash) for r in lifecycle.build_chain(legal.select("id", "enrollment_id", "actor", "from_state", "to_state", "note", "at", "snapshot")).collect()}
    assert {r.id: (r.prev_hash, r.hash) for r in got.where("outcome = 'legal'").collect()} == chain and len(chain) > 20
    assert got.where("outcome <> 'legal' and hash is not null").count() == 0


def test_the_state_store_is_asked_for(spark):
    with pytest.raises(ValueError, match="providerClass"):
        states.decide(spark.createDataFrame([], REQUEST), spark.createDataFrame([], "id long, state string"))
