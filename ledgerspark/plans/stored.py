"""What staff set, as stored tables, by upserts of sources.tables: participants, enrollments, file requests, staff, retention periods,
grants and allowed signers."""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import people
from ..operators.lineage import cut
from ..sources.tables import Tables

RETENTION = "id string, raw_media_retention_days int, funded_email_evidence_retention_days int, updated_at timestamp"
GRANTS = "enrollment_id string, amount decimal(12,2), sent_at timestamp, method string, updated_at timestamp"
SIGNERS = "casino string, domain string"
PARTICIPANTS = "id string, contact string, email string, created_at timestamp"
ENROLLMENTS = "id string, participant_id string, casino string, state string, created_at timestamp"
STAFF = "id string, name string, token_hash string, role string, created_at timestamp"
FILE_REQUESTS = "id string, enrollment_id string, request_id string, url string, destination_path string, created_at timestamp"


class Stored:
    """The tables of one store. Writers may come at the same time; a reader sees one version."""

    def __init__(self, tables: Tables):
        self.tables, self.spark = tables, tables.spark

    def settings(self, base: Settings | None = None) -> Settings:
        """base (the defaults) with the retention periods that are stored, for plans.retire."""
        row = self.tables.read("retention_settings", RETENTION).where("id = 'default'").first()
        known = {k: row[k] for k in ("raw_media_retention_days", "funded_email_evidence_retention_days") if row[k] is not None} if row else {}
        return replace(base or Settings(), **known)

    def set_retention(self, now: datetime, raw_media_days: int | None = None, funded_email_days: int | None = None) -> Settings:
        """Periods of at least a day; one that isn't given stays as it is."""
        old = self.settings()
        raw, mail = (old.raw_media_retention_days if raw_media_days is None else raw_media_days), (old.funded_email_evidence_retention_days if funded_email_days is None else funded_email_days)
        if raw < 1 or mail < 1:
            raise ValueError("a retention period has at least a day")
        row = self.spark.createDataFrame([("default", raw, mail, now)], RETENTION)
        self.tables.upsert("retention_settings", RETENTION, row, ["id"], "updated_at")
        return self.settings()

    def grants(self) -> DataFrame:
        return self.tables.read("grant", GRANTS)

    def set_grants(self, grants: DataFrame) -> None:
        """grants (enrollment_id, amount, sent_at, method, updated_at): one for each enrollment, the last of a call wins and replaces the one before."""
        rows = grants.select(*(F.col(n).cast(k).alias(n) for n, k in (c.split() for c in GRANTS.split(", "))))
        self.tables.upsert("grant", GRANTS, rows.where("enrollment_id is not null"), ["enrollment_id"], "updated_at")

    def signers(self) -> DataFrame:
        return self.tables.read("dkim_allowed_signer", SIGNERS)

    def allow(self, signers: DataFrame) -> None:
        """signers (casino, domain) that aren't there yet."""
        rows = signers.select("casino", "domain").where("casino is not null and domain is not null")
        self.tables.upsert("dkim_allowed_signer", SIGNERS, rows, ["casino", "domain"])

    def participants(self) -> DataFrame:
        return self.tables.read("participant", PARTICIPANTS)

    def add_participants(self, rows: DataFrame) -> DataFrame:
        """rows as people.new_participants has them; those that are refused, with their error. An id that is there stays as it is."""
        return self._add("participant", PARTICIPANTS, people.new_participants(rows))

    def enrollments(self) -> DataFrame:
        return self.tables.read("enrollment", ENROLLMENTS)

    def enroll(self, rows: DataFrame) -> DataFrame:
        """rows as people.new_enrollments has them, for participants that are stored; those that are refused, with their error.
        An id that is there stays as it is, whatever its state."""
        return self._add("enrollment", ENROLLMENTS, people.new_enrollments(rows, self.participants()))

    def _add(self, table: str, schema: str, asked: DataFrame) -> DataFrame:
        asked = cut(asked)
        self.tables.upsert(table, schema, asked.where("error is null").drop("error"), ["id"])
        return asked.where("error is not null")

    def file_requests(self) -> DataFrame:
        return self.tables.read("file_request", FILE_REQUESTS)

    def request_files(self, rows: DataFrame, intake_root: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows as people.file_requests has them, for enrollments that are stored; those that are refused, with their error.

        ask stands for the folder's service: (id, destination_path, title) to (id, request_id, url). It is asked for ids that
        aren't stored yet, one for each; one that it leaves out is refused. A call that is repeated asks for what is missing.
        """
        asked = people.file_requests(rows.dropDuplicates(["id"]), self.enrollments(), intake_root)
        asked = cut(asked.join(self.file_requests().select("id"), "id", "left_anti"))
        answers = cut(ask(asked.where("error is null").select("id", "destination_path", "title")).select(F.col("id").cast("string").alias("id"), "request_id", "url"))
        done = cut(asked.where("error is null").join(answers.dropDuplicates(["id"]), "id", "left"))
        self.tables.upsert("file_request", FILE_REQUESTS, done.where("request_id is not null").select(*(c.split()[0] for c in FILE_REQUESTS.split(", "))), ["id"])
        silent = done.where("request_id is null").withColumn("error", F.lit("no answer"))
        return asked.where("error is not null").unionByName(silent.select(*asked.columns))

    def staff(self) -> DataFrame:
        return self.tables.read("staff_user", STAFF)

    def add_staff(self, name: str, role: str, now: datetime) -> tuple[str, str]:
        """A member's id and token. The token is shown here only; what is stored is its SHA-256."""
        if not name or role not in people.ROLES:
            raise ValueError(f"staff need a name, and a role out of {people.ROLES}")
        own, token = str(uuid.uuid4()), secrets.token_urlsafe(24)
        row = self.spark.createDataFrame([(own, name, hashlib.sha256(token.encode()).hexdigest(), role, now)], STAFF)
        self.tables.upsert("staff_user", STAFF, row, ["id"])
        return own, token

    def remove_staff(self, own: str) -> None:
        self.tables.remove("staff_user", STAFF, self.spark.createDataFrame([(own,)], "id string"), ["id"])
