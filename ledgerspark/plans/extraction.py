"""From frame reads to the flags of a run: one plan, with one pass over the stitched ledger."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, ledger, media


def encoder_flags(formats: DataFrame) -> DataFrame:
    """ENCODER_MISMATCH for recordings from the folder whose encoder names a re-encoding tool."""
    hits = formats.where("channel = 'dropbox'").where(media.encoder_trace(F.col("encoder")).isNotNull())
    return hits.select(*ledger.flag(F.col("submission_id"), "ENCODER_MISMATCH", "warning"))


def discontinuity_flags(keyframes: DataFrame, submissions: DataFrame) -> DataFrame:
    """FRAME_DISCONTINUITY for recordings from the folder with an outlier among their keyframe intervals."""
    own = keyframes.join(submissions.where("channel = 'dropbox'").select(F.col("id").alias("submission_id")), "submission_id")
    return own.where(media.keyframe_outliers(F.col("times")) > 0).select(*ledger.flag(F.col("submission_id"), "FRAME_DISCONTINUITY", "warning"))


def duplicate_flags(assets: DataFrame) -> DataFrame:
    """DUPLICATE_MEDIA for assets with a near-equal one stored before."""
    return media.duplicate_media(assets).select(*ledger.flag(F.col("id"), "DUPLICATE_MEDIA", "high"))


def shared_flags(rows: DataFrame) -> DataFrame:
    """SHARED_ROWS for runs with rows that another participant's runs have too."""
    return evidence.sharing_runs(rows).select(*ledger.flag(F.col("run_id"), "SHARED_ROWS", "high"))


def all_flags(d, rows: DataFrame, now: datetime) -> DataFrame:
    """Every flag of every run and submission (run = submission = enrollment here): run_id, code, severity, item.

    A check may flag a run that has a flag already; nothing is made distinct.
    """
    runs = d.submission.where("kind = 'wager_recording'").select(F.col("id").alias("run_id"), "enrollment_id")
    assets = d.media_asset.join(d.submission.where("channel = 'dropbox'").select("media_asset_id"), F.col("id") == F.col("media_asset_id"))
    assets = assets.select("id", "dhash", F.col("created_at").alias("stored_at"), F.col("created_at").alias("checked_at"))
    parts = [
        ledger.run_flags(runs, rows, d.grants, now),
        evidence.submission_flags(d.submission, d.grants, d.enrollment, d.container_format, d.keyframes),
        duplicate_flags(assets),
        shared_flags(d.shared_line),
    ]
    return reduce(DataFrame.unionByName, parts)
