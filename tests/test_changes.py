import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.sources import archive
from ledgerspark.sources.changes import _Reader, read_changes
from ledgerspark.streaming.ingest import Ingest


def log_of(folder, size=2):
    """A change log in a file, one entry for each line; made here, so that it goes to the workers by value."""
    path = str(folder / "log")

    class Log:
        def page(self, cursor):
            with open(path) as lines:
                entries = [json.loads(x) for x in lines]
            at = int(cursor or 0)
            return entries[at : at + size], str(min(at + size, len(entries))), at + size < len(entries)

    return Log


def write(folder, entries, mode="a"):
    with open(folder / "log", mode) as out:
        out.writelines(json.dumps(e) + "\n" for e in entries)


def test_pages_and_any_restart(tmp_path):
    write(tmp_path, [{"path": f"/p{i}", "is_file": i % 3 > 0, "deleted": i % 5 == 0, "bytes": i} for i in range(11)])
    make = log_of(tmp_path)
    reader = _Reader(make(), 2)
    whole, at, cuts = [], reader.initialOffset(), []
    while True:
        rows, after = reader.read(at)
        if after == at:
            break
        own = list(rows)
        cuts.append((at, after, own))
        whole += own
        at = after
    assert [r[0] for r in whole] == [f"/p{i}" for i in range(11)] and len(cuts) == 3
    for start, end, own in cuts:  # as another process would
        assert list(_Reader(make(), 50).readBetweenOffsets(start, end)) == own
    with pytest.raises(ValueError, match="any more"):
        list(reader.readBetweenOffsets({"cursor": "0"}, {"cursor": "3"}))


def test_a_query_goes_on_at_its_cursor(spark, tmp_path):
    make = log_of(tmp_path)
    seen, fail = [], []

    def batch(rows, batch_id):
        if fail:
            raise RuntimeError("lost")
        seen.extend((r.path, r.deleted) for r in rows.collect())

    def run():
        stream = read_changes(spark, make, "changes_test")
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", (tmp_path / "checkpoint").as_uri()).trigger(availableNow=True).start()
        query.awaitTermination()

    write(tmp_path, [{"path": f"/p{i}", "is_file": True, "bytes": 1} for i in range(5)])
    run()
    run()
    assert seen == [(f"/p{i}", False) for i in range(5)]
    write(tmp_path, [{"path": "/p1", "deleted": True}, {"path": "/p5", "is_file": True}])
    fail.append(1)
    with pytest.raises(Exception, match="lost"):
        run()
    fail.clear()
    write(tmp_path, [{"path": "/p6", "is_file": True}])
    run()
    run()
    assert seen[5:] == [("/p1", True), ("/p5", False), ("/p6", False)]


def test_intake_by_changes(spark, tmp_path):
    folder = tmp_path / "intake"
    for name, data in (("10/a.mp4", b"one"), ("10/b.mp4", b"two"), ("11/c.mp4", b"one")):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    uri = folder.as_uri()
    entries = [("10/a.mp4", True, False), ("10", False, False), ("10/gone.mp4", True, False), ("10/b.mp4", True, False), ("11/c.mp4", True, False), ("10/b.mp4", True, True)]
    changes = spark.createDataFrame([(f"{uri}/{p}", f, d, 3) for p, f, d in entries] + [(None, True, False, None)], "path string, is_file boolean, deleted boolean, bytes long")
    enrollments = spark.createDataFrame([(10, "funded"), (11, "funded")], "id long, state string")
    job = Ingest(spark, uri, (tmp_path / "media").as_uri(), archive.ContentStore(spark, (tmp_path / "store").as_uri()), lambda: enrollments)
    for k in range(2):
        job.changed(changes, k)
        assert job.archived().count() == 2 and {r.path_lower.rsplit("/", 1)[1] for r in job.archived().collect()} == {"a.mp4", "b.mp4"}
    job.changed(changes.where(F.col("deleted")), 3)
    assert job.archived().count() == 2
