"""Who takes part: new participants, new enrollments, and requests for files, with what is refused and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the form of an e-mail address. It has no two dots in a row and none in front, too.
EMAIL = r"(?i)^[a-z0-9_'+.-]*[a-z0-9_+-]@([a-z0-9][a-z0-9-]*\.)+[a-z]{2,}\z"
#: Fixed: roles of staff, and the state in which an enrollment begins.
ROLES, FIRST_STATE = ("ops", "admin"), "invited"


def is_email(text: Column) -> Column:
    """Whether a text is an address; null for null."""
    return text.rlike(EMAIL) & ~text.startswith(".") & ~text.contains("..")


def new_participants(rows: DataFrame) -> DataFrame:
    """rows (id, contact, email, created_at) with error: null for those that can be added. Contact and email may be null."""
    refused = F.when(F.col("id").isNull(), "no id").when(~is_email(F.col("email")), "not an e-mail address")
    return _texts(rows, "id", "contact", "email").select("id", "contact", "email", F.col("created_at").cast("timestamp").alias("created_at"), refused.alias("error"))


def new_enrollments(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """rows (id, participant_id, casino, created_at) with state and error: an enrollment needs a participant (id) that is there, and a casino.

    An id or a participant that stands more than once gives no further rows.
    """
    there = participants.select(F.col("id").cast("string").alias("_there")).where("_there is not null").distinct()
    rows = _texts(rows, "id", "participant_id", "casino").join(there, F.col("participant_id") == F.col("_there"), "left")
    refused = F.when(F.col("id").isNull(), "no id").when(F.col("_there").isNull(), "participant not found").when(F.coalesce(F.col("casino") == "", F.lit(True)), "no casino")
    return rows.select("id", "participant_id", "casino", F.lit(FIRST_STATE).alias("state"), F.col("created_at").cast("timestamp").alias("created_at"), refused.alias("error"))


def file_requests(rows: DataFrame, enrollments: DataFrame, intake_root: str, title: str = "Verification evidence, ") -> DataFrame:
    """rows (id, enrollment_id, created_at) with the folder that a request's files go to, its title, and error where there is no such
    enrollment (id, casino). One / at the end of intake_root counts as none."""
    own = enrollments.select(F.col("id").cast("string").alias("_there"), F.col("casino").alias("_casino")).where("_there is not null").dropDuplicates(["_there"])
    rows = _texts(rows, "id", "enrollment_id").join(own, F.col("enrollment_id") == F.col("_there"), "left")
    found = F.col("_there").isNotNull()
    path, named = F.concat(F.lit(intake_root.removesuffix("/") + "/"), "enrollment_id"), F.concat(F.lit(title), F.coalesce("_casino", F.lit("")))
    refused = F.when(F.col("id").isNull(), "no id").when(~found, F.concat(F.lit("no enrollment "), F.coalesce("enrollment_id", F.lit(""))))
    created = F.col("created_at").cast("timestamp").alias("created_at")
    return rows.select("id", "enrollment_id", F.when(found, path).alias("destination_path"), F.when(found, named).alias("title"), created, refused.alias("error"))


def _texts(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("string") for n in names})
