"""Raw messages as a stream: routed, their originals stored, evidence and decisions recorded.

One row for each message is the record of what was done with it; media, submissions, evidence and audit rows are plans over
these (operators.records). The original is stored before the row is written and decisions are added after it, so a batch
that is repeated after a failure goes on where the first attempt stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import iso_millis
from ..operators.evidence import route_emails, unmatched_audit
from ..operators.lineage import cut
from ..operators.records import mail_decisions, mail_evidence, mail_media, mail_submissions, with_snapshots
from ..operators.signatures import verify
from ..sources.archive import ContentStore
from ..sources.journal import Journal, table_at
from ..sources.mail import SCHEMA, parse_messages
from .ingest import FILES

HANDLED = f"id string, status string, enrollment_id string, tier string, dkim string, content_hash string, bytes long, handled_at timestamp, public_key string, {SCHEMA.replace(', original binary', '')}"


class Mailbox:
    """Message files in a folder into `target`, a Parquet table of HANDLED, in the order of their time and path.

    tables() gives participants, enrollments, media of other intakes and the allow-list as they are now. keys() gives the records
    (selector, domain, key) that the originals' signatures are checked by; in its place verdict, of the parsed message, may be
    the signature's result. Without either there is none.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        target: str,
        store: ContentStore,
        journal: Journal,
        tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame, DataFrame]],
        verdict: Column | None = None,
        others: tuple[Callable[[], tuple[DataFrame, DataFrame, DataFrame]], ...] = (),
        keys: Callable[[], DataFrame] | None = None,
    ):
        self.spark, self.folder, self.target, self.store, self.journal, self.tables, self.others, self.keys = spark, folder, target, store, journal, tables, others, keys
        self.verdict = F.lit(None).cast("string") if verdict is None else verdict

    def handled(self) -> DataFrame:
        return table_at(self.spark, self.target, HANDLED)

    def dossier(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Submissions, evidence and flags (none) of all messages so far."""
        rows = self.handled()
        return mail_submissions(rows), mail_evidence(rows), self.spark.createDataFrame([], "submission_id string, code string, severity string")

    def audit(self) -> DataFrame:
        """Messages that no enrollment was found for."""
        return unmatched_audit(self.handled(), self.handled())

    def replies(self) -> DataFrame:
        """(id, to_addr, enrollment_id) of messages to answer, as they came without the original."""
        return self.handled().where("status = 'auto_replied'").select("id", F.col("from_addr").alias("to_addr"), "enrollment_id")

    def batch(self, files: DataFrame, batch_id: int) -> None:
        raw = files.select(F.concat_ws("|", iso_millis(F.col("modificationTime")), "path").alias("id"), "content")
        parsed = parse_messages(raw).withColumn("dkim", self.verdict).drop("content").select("id", "content_hash", "dkim", "mail.*", F.lit(None).cast("string").alias("public_key"))
        parsed = cut(verify(parsed, self.keys()) if self.keys else parsed)
        participants, enrollments, media, allowlist = self.tables()
        done = cut(self.handled().join(parsed.select("id"), "id", "left_semi"))
        new = parsed.join(done.select("id"), "id", "left_anti")
        new = new.withColumn("bytes", F.octet_length("original").cast("long"))
        media = media.select("content_hash").unionByName(mail_media(self.handled()).select("content_hash"))
        routed = route_emails(new, participants, self.journal.states(enrollments), media.join(new.select("content_hash"), "content_hash", "left_semi"), allowlist)
        routed = cut(routed.withColumns({"enrollment_id": F.col("enrollment_id").cast("string"), "handled_at": F.current_timestamp()}).join(new, "id"))
        self.store.put(routed.where("status = 'verified'").select(F.col("original").alias("content")))
        columns = [c.split()[0] for c in HANDLED.split(", ")]
        routed.select(*columns).write.mode("append").parquet(self.target)
        # with the rows of an earlier attempt, whose decisions may be missing
        rows = done.unionByName(routed.select(*columns))
        decisions = mail_decisions(rows, self.journal.states(enrollments.withColumn("id", F.col("id").cast("string"))))
        self.journal.append(with_snapshots(decisions, [self.dossier(), *(other() for other in self.others)]))

    def start(self, checkpoint: str, poll_seconds: float | None = None) -> StreamingQuery:
        """Everything there is, then stops; with poll_seconds, again and again."""
        files = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(self.folder)
        writer = files.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if poll_seconds is None else writer.trigger(processingTime=f"{poll_seconds} seconds")
        return writer.start()
