"""Incremental ingest: a checkpointed file stream into the archive, once per content.

The stream's checkpoint is the folder's cursor. Each micro-batch is classified against what is archived and what is
known of enrollments; new content is stored before its rows are, and sources are purged last, so that a batch that is
repeated after a failure finds its own content and adds nothing twice. Submissions and flags are plans over those rows
(operators.records); decisions are added to a journal, by the repeated batch too where it failed before that.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import classify_entries, submissions_of
from ..operators.lineage import cut
from ..operators.records import recording_decisions, recording_flags, recording_submissions, with_snapshots
from ..sources.archive import SMALL_BATCH, ContentStore, describe
from ..sources.journal import Journal, table_at

log = logging.getLogger(__name__)
FILES = "path string, modificationTime timestamp, length bigint, content binary"
MEDIA = "content_hash string, enrollment_id string, bytes bigint, path_lower string, kind string, channel string, advances boolean, flags array<string>, ingested_at timestamp"


class Ingest:
    """Files under folder/<enrollment id>/ into `target`, a Parquet table of MEDIA. enrollments() gives (id, state) as they are now.

    purge gets the sources that may go, as (path, path_lower); sources.archive.remove_sources deletes them. With a journal,
    states are those it leads to, and a recording that advances its enrollment becomes a decision there; its snapshot has
    the dossier of this intake and of the others. then gets the submissions that advanced, once all is recorded (to extract
    them, with Settings.auto_extract_on_ingest); when it fails, that is logged and the intake goes on.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        target: str,
        store: ContentStore,
        enrollments: Callable[[], DataFrame],
        purge: Callable[[DataFrame], None] | None = None,
        channel: str = "dropbox",
        journal: Journal | None = None,
        others: tuple[Callable[[], tuple[DataFrame, DataFrame, DataFrame]], ...] = (),
        then: Callable[[DataFrame], None] | None = None,
    ):
        self.spark, self.folder, self.target, self.store, self.enrollments, self.purge, self.channel = spark, folder.rstrip("/"), target, store, enrollments, purge, channel
        self.journal, self.others, self.then = journal, others, then

    def archived(self) -> DataFrame:
        return table_at(self.spark, self.target, MEDIA)

    def dossier(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Submissions, evidence (none) and flags of all files so far."""
        rows = self.archived()
        none = "submission_id string, tier string, dkim_result string, d_domain string, selector string"
        return recording_submissions(rows), self.spark.createDataFrame([], none), recording_flags(rows)

    def batch(self, files: DataFrame, batch_id: int) -> None:
        root = "/" + self.folder.split(":", 1)[-1].lstrip("/").lower()
        found = describe(files).persist()
        hashes = found.select("content_hash").distinct()
        small = found.count() <= SMALL_BATCH
        hashes = F.broadcast(hashes) if small else hashes
        known = self.archived().select("content_hash").join(hashes, "content_hash", "left_semi")
        enrollments = self.journal.states(self.enrollments()) if self.journal else self.enrollments()
        entries = classify_entries(found, known, enrollments, root).persist()
        try:
            fresh = entries.where("outcome = 'ingested'")
            # settled before anything is written: judged again, its content would be known
            accepted = cut(fresh.select("content_hash", "enrollment_id", "bytes", "path_lower"))
            self.store.put(fresh.select("content"))
            made = submissions_of(accepted, enrollments, self.channel)
            made.select("content_hash", "enrollment_id", "bytes", "path_lower", "kind", "channel", "advances", "flags", F.current_timestamp().alias("ingested_at")).write.mode("append").parquet(self.target)
            if self.journal:
                # all of the batch's content, so that what an earlier attempt left out is made up for
                decisions = recording_decisions(self.archived().join(hashes, "content_hash", "left_semi"))
                self.journal.append(with_snapshots(decisions, [self.dossier(), *(other() for other in self.others)]))
            if self.purge:
                self.purge(entries.where("purge").select("path", "path_lower"))
            if self.then:
                own = accepted.select("content_hash")
                advanced = self.archived().join(F.broadcast(own) if small else own, "content_hash", "left_semi").where("advances")
                self._follow(recording_submissions(advanced))
        finally:
            entries.unpersist()
            found.unpersist()

    def _follow(self, submissions: DataFrame) -> None:
        try:
            self.then(submissions)
        except Exception:
            log.exception("what follows an intake failed; the intake stands")

    def changed(self, changes: DataFrame, batch_id: int) -> None:
        """A batch of sources.changes: the files that are named and still there, as a batch. Paths are as Spark reads them; deletions and
        folders change nothing."""
        own = changes.where("is_file and not deleted and path is not null").select("path").distinct()
        there = sorted(r[0] for r in own.collect() if _there(self.spark, r[0]))  # as many as the pages of a batch have
        if there:
            self.batch(self.spark.read.format("binaryFile").schema(FILES).option("ignoreMissingFiles", "true").load(there), batch_id)

    def start(self, checkpoint: str, poll_seconds: float | None = None) -> StreamingQuery:
        """Everything there is, then stops; with poll_seconds, again and again."""
        files = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(self.folder)
        writer = files.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if poll_seconds is None else writer.trigger(processingTime=f"{poll_seconds} seconds")
        return writer.start()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
