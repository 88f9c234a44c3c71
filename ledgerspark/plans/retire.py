"""Retention as a job: what its period has passed of goes from the store, and the media table says so."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.evidence import retention
from ..operators.lineage import cut
from ..sources.archive import ContentStore


def retire(store: ContentStore, media: DataFrame, submissions: DataFrame, enrollments: DataFrame, now: datetime, settings: Settings | None = None) -> DataFrame:
    """media with deleted_at set for those that go now; their content is deleted first, so that a job that fails is simply run again.

    Content (blob_key) that an asset that stays has too is kept. An asset is deleted at most once: deleted_at is never changed.
    """
    settings = settings or Settings()
    decided = retention(media, submissions, enrollments, now, settings.raw_media_retention_days, settings.funded_email_evidence_retention_days)
    going = cut(decided.where("decision = 'deleted'").select("id").distinct())
    stays = media.where("deleted_at is null").join(going, "id", "left_anti").select("blob_key")
    gone = media.join(going, "id", "left_semi").select("blob_key").join(stays, "blob_key", "left_anti")
    store.delete(cut(gone.select(F.col("blob_key").alias("content_hash")).distinct()))
    at = F.when(F.col("_gone"), F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at"))
    rows = media.join(going.withColumn("_gone", F.lit(True)), "id", "left")
    return rows.withColumn("deleted_at", at).select(*media.columns)
