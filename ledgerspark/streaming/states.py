"""Enrollments' states as a stateful stream: requests in, decisions out, each chained to the one before.

The state of an enrollment is what its decisions have led to and the hash of the last one; nothing of the journal is read
again. It lives in the query's checkpoint, so a query that is started again goes on where it was. Needs the RocksDB state store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import iso_millis
from ..operators.lifecycle import _outcome

DECISIONS = "enrollment_id string, id long, actor string, from_state string, to_state string, note string, at timestamp, snapshot string, outcome string, prev_hash string, hash string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [c.split()[0] for c in DECISIONS.split(", ")]


class _Machine(StatefulProcessor):
    """One enrollment's requests in the order of (at, id) within a micro-batch."""

    def __init__(self, strict: bool):
        self.strict = strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, head string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803 - Spark's names
        row = initialState.iloc[0]
        self.now.update((row["state"], None if pd.isna(row["head"]) else row["head"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, head = self.now.get() if self.now.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        made = []
        for r in batch.itertuples(index=False):
            outcome, before, own = _outcome(state, r.to_state, self.strict), None, None
            if outcome == "legal":
                before = head
                shown = "null" if head is None else f'"{head}"'
                body = f'{r.begins[:-1]},"fromState":"{state}",{r.ends[1:]}'
                own = hashlib.sha256(f'{{"payload":{body},"prevHash":{shown}}}'.encode()).hexdigest()
            made.append((key[0], r.id, r.actor, state, r.to_state, r.note, r.at, r.snapshot, outcome, before, own))
            if outcome == "legal":
                state, head = r.to_state, own
        self.now.update((state, head))
        yield pd.DataFrame(made, columns=_COLUMNS)

    def close(self) -> None:
        pass


def decide(requests: DataFrame, enrollments: DataFrame, strict: bool = False) -> DataFrame:
    """requests, a stream (id, enrollment_id, to_state, actor, note, at, snapshot), as a stream of DECISIONS.

    enrollments (id, state, and head where there are decisions already: the last one's hash) give the states to begin with, when the
    query starts for the first time. Requests come in the order of (at, id) within a micro-batch, and micro-batches in their own; an
    enrollment's requests of one micro-batch are held by a task, so bound these (maxFilesPerTrigger). Each request has
    one row: outcomes are those of lifecycle.transition_outcome, and only legal ones change the state and have hashes, which are
    lifecycle.build_chain's. The session's state store has to be PROVIDER.
    """
    spark = requests.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    begins = F.to_json(F.struct(F.col("enrollment_id").cast("string").alias("enrollmentId"), "actor"), {"ignoreNullFields": "false"})
    ends = F.to_json(F.struct(F.col("to_state").alias("toState"), "note", iso_millis(F.col("at")).alias("at"), "snapshot"), {"ignoreNullFields": "false"})
    rows = requests.select(F.col("enrollment_id").cast("string").alias("enrollment_id"), F.col("id").cast("long").alias("id"), "actor", "to_state", "note", "at", "snapshot", begins.alias("begins"), ends.alias("ends"))
    head = F.col("head") if "head" in enrollments.columns else F.lit(None).cast("string")
    first = enrollments.select(F.col("id").cast("string").alias("enrollment_id"), "state", head.alias("head")).groupBy("enrollment_id")
    return rows.groupBy("enrollment_id").transformWithStateInPandas(statefulProcessor=_Machine(strict), outputStructType=DECISIONS, outputMode="Append", timeMode="None", initialState=first)
