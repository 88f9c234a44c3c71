"""The log of decisions as a table that is only added to, by any number of writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import STATES, TERMINAL, build_chain, latest
from ..operators.lineage import cut
from ..operators.records import current_states, numbered
from .tables import TRIES, Conflict, State, Tables


def table_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, empty where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


class Journal:
    """Decisions of all enrollments, each with the hash of the one before.

    Writers don't wait for each other: each chains its decisions to what it has read and commits them (sources.tables). Where
    another one has decided on the same enrollments meanwhile, it reads again and starts anew, so no chain forks.
    """

    SCHEMA = "enrollment_id string, id long, actor string, from_state string, to_state string, note string, at timestamp, snapshot string, prev_hash string, hash string"

    def __init__(self, spark: SparkSession, path: str):
        self.tables = Tables(spark, path)

    def table(self, state: State | None = None) -> DataFrame:
        return self.tables.read("decision", self.SCHEMA, state)

    def states(self, enrollments: DataFrame) -> DataFrame:
        """enrollments (id, state, ...) as the log leaves them."""
        return current_states(enrollments, self.table())

    def append(self, decisions: DataFrame) -> None:
        """Adds decisions (enrollment_id, from_state, to_state, actor, note, at, snapshot) that aren't there, chained to what is.

        A state that an enrollment has reached, or has left behind, isn't recorded again, and nothing is after a terminal one; so the
        same call can be made twice, and a decision that another writer has overtaken is left out.
        """
        columns = [c.split()[0] for c in self.SCHEMA.split(", ")]
        new = cut(numbered(decisions.withColumn("enrollment_id", F.col("enrollment_id").cast("string"))).select(*columns[:-2]))
        own = new.select("enrollment_id").distinct()
        for _ in range(TRIES):
            now = self.tables.state()
            old = cut(self.table(now).select("enrollment_id", "id", "at", "hash").join(own, "enrollment_id", "left_semi"))
            last = old.groupBy("enrollment_id").agg(F.max("id").alias("_last"))
            fresh = new.join(last, "enrollment_id", "left").where(F.col("_last").isNull() | ((F.col("id") > F.col("_last")) & (F.col("_last") <= len(STATES) - len(TERMINAL))))
            chained = cut(build_chain(cut(fresh.drop("_last")), latest(old, "enrollment_id", "at", "id", "hash")).select(*columns))
            if chained.isEmpty():
                return
            files = self.tables.write("decision", chained)
            try:
                self.tables.commit(uuid.uuid4().hex, {"decision": files}, base=now.number, clash=lambda c: self._touches(c, own))
                return
            except Conflict:
                continue
        raise Conflict(f"the journal was changed {TRIES} times meanwhile")

    def _touches(self, change: dict, own: DataFrame) -> bool:
        """Whether a commit has decisions on any of these enrollments."""
        files = change["add"].get("decision")
        return bool(files) and not self.tables.read("decision", self.SCHEMA, files=files).join(own, "enrollment_id", "left_semi").isEmpty()
