"""Extraction runs as a job: contents to a reader, and from each run its rows or its error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.lineage import cut
from ..operators.records import begin_runs, finish_runs
from ..sources.extractors import READS

_READ = f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in READS.split(', ')[1:])}>>"
TRIED = f"id string, error string, input_tokens long, output_tokens long, reads {_READ}"
#: What a reader makes of a content: rows with the fields of READS but run_id, tokens in and out.
Reader = Callable[[bytes], tuple[list[dict], int, int]]


def _attempts(read: Reader):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for id_, key, content in batch[["id", "content_hash", "content"]].itertuples(index=False, name=None):
                row = dict.fromkeys(c.split()[0] for c in TRIED.split(", ")[:5]) | {"id": id_, "reads": []}
                try:
                    if content is None:
                        raise LookupError(f"no content {key}")
                    rows, row["input_tokens"], row["output_tokens"] = read(content)
                    row["reads"] = [{c.split()[0]: r.get(c.split()[0]) for c in READS.split(", ")[1:]} for r in rows]
                except Exception as problem:  # noqa: BLE001 - whatever goes wrong with one run is that run's error
                    row["error"] = str(problem) or type(problem).__name__
                yield pd.DataFrame([row])

    return run


def extract(submissions: DataFrame, contents: DataFrame, read: Reader, version: str, model: str, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """submissions (id, content_hash) -> their new runs, each ended, and the reads (run_id, ...) of those that succeeded.

    contents (content_hash, content), as of a ContentStore. A run whose content isn't there, or whose reader raises, has
    failed with that as its error; the others go on. A submission has one run from each call. Batches of
    contents are as large as spark.sql.execution.arrow.maxRecordsPerBatch has it: set it low where these are recordings.
    """
    settings = settings or Settings()
    runs = cut(begin_runs(submissions.withColumn("started_at", F.current_timestamp()), version, model))
    wanted = runs.select("id", "content_hash").join(contents.select("content_hash", "content"), "content_hash", "left")
    tried = cut(wanted.mapInPandas(_attempts(read), TRIED).withColumn("finished_at", F.current_timestamp()))
    ended = finish_runs(runs, tried, settings.input_token_price, settings.output_token_price)
    reads = tried.where("error is null").select(F.col("id").alias("run_id"), F.inline("reads"))
    return ended, reads
