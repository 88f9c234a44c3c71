"""Content-addressed archive, folder scans, exports."""

from __future__ import annotations

import itertools
import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut

log = logging.getLogger(__name__)
#: Batches of up to this number of files send their hashes (64 bytes each) to the archive's scan; larger ones are joined.
SMALL_BATCH = 100_000
#: Files that are deleted at the same time, and names that are held for that.
DELETERS, NAMES = 16, 1024


def scan_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder, with their bytes: path, path_lower, is_file, content, bytes, content_hash, modified_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return describe(files)


def describe(files: DataFrame) -> DataFrame:
    """The columns of binaryFile, batch or stream, as folder entries."""
    return files.select(
        "path",
        F.lower(F.regexp_replace("path", "^[a-z0-9]+:/*", "/")).alias("path_lower"),
        F.lit(True).alias("is_file"),
        "content",
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("content_hash"),
        F.col("modificationTime").alias("modified_at"),
    )


def _file(spark: SparkSession, uri: str):
    """The Hadoop path of a file's address, as Spark's readers give it, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_sources(rows: DataFrame) -> None:
    """Deletes the files of rows (path), as binaryFile names them. One that can't be deleted is logged and left.

    Paths come to the driver partition by partition; so many files at a time are deleted side by side.
    """
    spark = rows.sparkSession

    def remove(name: str) -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            gone = path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
        except Exception as problem:  # noqa: BLE001 - whatever a file system throws, the archive already has the content
            log.warning("could not delete %s: %s", name, problem)
        else:
            if not gone:
                log.warning("%s was not there any more", name)

    names = (r[0] for r in rows.select("path").where("path is not null").distinct().toLocalIterator())
    with ThreadPoolExecutor(DELETERS) as pool:
        while some := list(itertools.islice(names, NAMES)):
            list(pool.map(remove, some))


class ContentStore:
    """Bytes by SHA-256 in a Parquet table, partitioned by the first two digits of the hash; written once each.

    The layout root/shard=ab/ keeps point reads and existence checks to one partition. Works on any file system that
    Spark writes to, object stores included.
    """

    SCHEMA = "content_hash string, content binary, shard string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self) -> DataFrame:
        if not self._there():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.root)

    def put(self, rows: DataFrame) -> None:
        """Adds rows (content) whose hash isn't there yet; equal bytes in a batch are stored once."""
        named = rows.select(F.sha2("content", 256).alias("content_hash"), "content").withColumn("shard", F.substring("content_hash", 1, 2))
        own = cut(named.select("content_hash", "shard").distinct())
        shards = [r[0] for r in own.select("shard").distinct().collect()]  # 256 at most
        # the batch's hashes go to the archive's files, not the archive's to the batch
        small = own.count() <= SMALL_BATCH
        there = self.table().where(F.col("shard").isin(*shards)).select("content_hash").join(F.broadcast(own) if small else own.hint("merge"), "content_hash", "left_semi")
        fresh = named.join(there.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
        fresh.write.mode("append").partitionBy("shard").parquet(self.root)

    def get(self, content_hash: str) -> DataFrame:
        """One row, or none."""
        return self.table().where((F.col("shard") == content_hash[:2]) & (F.col("content_hash") == content_hash)).limit(1)

    def exists(self, content_hash: str) -> bool:
        return not self.get(content_hash).isEmpty()

    def delete(self, hashes: DataFrame) -> None:
        """Removes hashes (content_hash): only the files that hold one are written anew.

        What stays of a file is added first and the file deleted then. A crash between the two loses nothing: content
        stands twice until the same call is made again.
        """
        gone = hashes.select("content_hash").distinct()
        shards = [r[0] for r in gone.select(F.substring("content_hash", 1, 2)).distinct().collect()]  # 256 at most
        for shard in shards if self._there() else ():
            held = self.table().where(F.col("shard") == shard).select("content_hash", F.col("_metadata.file_path").alias("file"))
            hit = held.join(gone, "content_hash", "left_semi").select("file").distinct()
            files = [_file(self.spark, r[0]) for r in hit.collect()]
            if not files:
                continue
            rows = self.spark.read.schema(self.SCHEMA).option("basePath", self.root).parquet(*(path.toString() for path, _ in files))
            others = held.join(hit, "file", "left_anti").select("content_hash")
            kept = rows.join(gone, "content_hash", "left_anti").join(others, "content_hash", "left_anti").dropDuplicates(["content_hash"])
            kept.select("content_hash", "content", "shard").write.mode("append").partitionBy("shard").parquet(self.root)
            for path, fs in files:
                if not fs.delete(path, False) and fs.exists(path):
                    raise OSError(f"could not delete {path.toString()}")


def write_csv_lines(lines: DataFrame, header: tuple[str, ...], path: str) -> None:
    """One CSV file with CRLF line ends from (line), in the frame's order, for exports that are read by people.

    The rows go through one task, as one file has to; a large export is better written as the frame it is.
    """
    spark = lines.sparkSession
    first = spark.createDataFrame([(",".join(header),)], "line string")
    whole = first.unionByName(lines.select("line")).coalesce(1)
    whole.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """Rows as JSON text in one column, nulls written, for nested results."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
