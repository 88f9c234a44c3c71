"""WARC archives with a gzip member for each record, written by tasks and read back by byte ranges.

Writing: equal payloads are found by their SHA-256; one of them becomes a response, the others revisit it and carry
no payload. Each task writes files of its own and returns their names; only files that a finished task has returned
belong to the archive, so a task that is tried again leaves nothing double.

Reading: files are cut into byte ranges. A task looks for the gzip magic in its range, takes a place for a member where
it inflates to a WARC header and on to its checksum, and owns the records that start inside, also those that end
outside. From one member to the next no search is needed. Only the first member of a range is a guess: compressed data
may hold a whole archive inside. So ranges are marked first (where the first own record starts, where the next
one after the range does), and a range whose start isn't where the ranges before it lead to is marked again from there.

Files are opened through pyarrow's file systems (local or shared folders, S3, GCS, HDFS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

MAGIC = b"\x1f\x8b\x08"
#: A file is closed once it has so many bytes; a range has so many.
FILE_BYTES, RANGE_BYTES = 256 << 20, 64 << 20
#: Bytes read at once, and given to inflate at once; bytes of payload in a batch of rows; a header's size at most.
READ_BYTES, FEED_BYTES, BATCH_BYTES, HEADER_BYTES = 1 << 20, 1 << 14, 8 << 20, 1 << 20
FILES = "path string, bytes long, records long"
MARKS = "path string, start long, stop long, entry long, exit long, damaged long, settled boolean"
RECORDS = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
ID = "urn:page:"


def sha1(data: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324 - the format's digest


def _line(value: str) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member; fields that are None are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {_line(v)}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id, url, payload: bytes, refers_to, refers_uri, date: str) -> bytes:
    """A page as a response, or as a revisit of another page's response (refers_to): then with its HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = lambda x: None if x is None else f"<{ID}{x}>"
    fields = {"WARC-Record-ID": named(page_id) or f"<{ID}>", "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{sha1(payload)}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        return record("response", fields, http + payload)
    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": named(refers_to), "WARC-Refers-To-Target-URI": refers_uri}
    return record("revisit", fields, http)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address as Spark's readers give it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, file_bytes: int, date: str):
    def run(batches):
        out, made, size, records, name = None, [], 0, 0, ""

        def close():
            out.close()
            made.append((f"{folder}/{name}", size, records))

        for batch in batches:
            for page_id, url, payload, refers_to, refers_uri in zip(*batch.columns, strict=True):
                if out is None:
                    system, place = _opened(folder)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, records = system.open_output_stream(f"{place}/{name}", compression=None), 0, 0
                    info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                data = page_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), refers_uri.as_py(), date)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*made, strict=True)) if made else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str | None = None) -> DataFrame:
    """pages (page_id, url, html, ...) as archives under folder -> path, bytes, records of each file.

    The payload is html in UTF-8; null counts as empty. Of pages with equal payloads of at least least_bytes, that with the
    smallest page_id becomes a response and the others revisit it; all other pages are responses. Rows that repeat
    the smallest page_id are all responses; rows without a page_id revisit, where there is a page to revisit. A null url
    is left out; control characters in it are percent-encoded. date is the records' (now by default). An empty table
    gives no files. Other columns don't matter. A payload has to fit a row: 2 GB.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    scratch = Scratch(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    # Payloads too short to be compared have no key; the join leaves them as they are.
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha2("payload", 256))))
    ided = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = rows.where("key is not null").groupBy("key").agg(F.min(ided).alias("first"), F.max("page_id").alias("last"), F.bool_or(F.col("page_id").isNull()).alias("lone"))
    # Only keys with another page; written, so that both sides of the join are plain exchanges, of which large partitions can be split.
    first = first.where("last > first.page_id or lone and first is not null").select(F.col("key").alias("_key"), F.col("first.page_id").alias("_id"), F.col("first.url").alias("_url"))
    first = scratch.keep(first)
    late = F.coalesce(F.col("page_id") > F.col("_id"), F.col("_id").isNotNull())
    judged = rows.join(first.hint("merge"), rows["key"] == F.col("_key"), "left").select("page_id", "url", "payload", F.when(late, F.col("_id")).alias("refers_to"), F.when(late, F.col("_url")).alias("refers_uri"))
    system, place = _opened(folder)
    system.create_dir(place)
    return scratch.finish(judged.mapInArrow(_write(folder, file_bytes, date), FILES))


class Archive:
    """A file of gzip members: its bytes by place, read ahead in blocks."""

    def __init__(self, uri: str):
        system, path = _opened(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.at, self.block = 0, b""

    def bytes(self, at: int, n: int = READ_BYTES) -> bytes:
        """Up to n bytes from a place, fewer than asked for only at the end of a block or of the file."""
        if not self.at <= at < self.at + len(self.block) or at + min(n, 64) > self.at + len(self.block) < self.size:
            self.at, self.block = at, self.file.read_at(max(0, min(READ_BYTES, self.size - at)), at)
        return self.block[at - self.at : at - self.at + n]

    def candidates(self, start: int, stop: int) -> Iterator[int]:
        """Places of the magic that start in the range."""
        while start < stop:
            part = self.bytes(start)
            if len(part) < len(MAGIC):
                return
            hit = part.find(MAGIC)
            if hit < 0:
                start += len(part) - len(MAGIC) + 1
            elif start + hit < stop:
                yield start + hit
                start += hit + 1
            else:
                return

    def inflated(self, at: int) -> Iterator[bytes]:
        """The bytes of the member at a place, piece by piece; self.end is where it ends. zlib.error where there is none, or it is cut off."""
        unpacker, feed = zlib.decompressobj(31), b""
        while not unpacker.eof:
            if not feed:
                feed = self.bytes(at, FEED_BYTES)
                at += len(feed)
                if not feed:
                    raise zlib.error("the member is cut off")
            yield unpacker.decompress(feed, READ_BYTES)
            feed = unpacker.unconsumed_tail
        self.end = at - len(unpacker.unused_data)

    def header(self, at: int) -> tuple[dict[str, str], bytes, Iterator[bytes]]:
        """The WARC header of the member at a place, what of the block has been inflated, and the rest to come. ValueError where there is none."""
        pieces, data = self.inflated(at), b""
        for piece in pieces:
            data += piece
            if not b"WARC/".startswith(data[:5]) or len(data) > HEADER_BYTES + READ_BYTES:
                break
            if b"\r\n\r\n" in data:
                break
        text, mark, rest = data.partition(b"\r\n\r\n")
        if not mark or not text.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        named = (line.partition(":") for line in text.decode("utf-8", "replace").split("\r\n")[1:])
        fields = {k.strip().lower(): v.strip() for k, _, v in named}
        if "warc-type" not in fields or not fields.get("content-length", "").isdecimal():
            raise ValueError("a WARC header without its fields")
        return fields, rest, pieces

    def passes(self, at: int) -> bool:
        """Whether a whole record stands at the place; self.end is where it ends."""
        try:
            fields, rest, pieces = self.header(at)
            return len(rest) + sum(map(len, pieces)) >= int(fields["content-length"])
        except (zlib.error, ValueError):
            return False

    def members(self, entry: int, stop: int) -> Iterator[tuple[int, bool]]:
        """Places of whole records that start from entry on and before stop, and whether bytes were skipped to reach each; self.end
        is then where the last one ends."""
        at, skipped = entry, False
        while at < min(stop, self.size):
            if self.passes(at):
                yield at, skipped
                at, skipped = self.end, False
                continue
            skipped = True
            at = next((c for c in self.candidates(at + 1, stop)), stop)


def _mark(batches):
    """(path, start, stop, entry) -> MARKS of each range: from its entry where that is known (then it is settled), else from the first member found."""
    for batch in batches:
        out = []
        for path, start, stop, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            archive = Archive(path)
            first = last = None
            damaged = 0
            for at, skipped in archive.members(start if entry is None else entry, stop):
                damaged += skipped and (first is not None or entry is not None)
                first = at if first is None else first
                last = archive.end
            out.append((path, start, stop, first, last, damaged, entry is not None))
        kinds = (pa.string(), *[pa.int64()] * 5, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=[c.split(" ")[0] for c in MARKS.split(", ")])


def marked(files: DataFrame, scratch: Scratch, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (path, bytes) -> MARKS and due, one row for each byte range.

    entry is the place of its first own record (null: none), exit the one after its last, due where the ranges before it
    lead to. A range's first guess holds if it is due there. Others are marked again from there, the first of each
    file in each pass; with archives that hold no archives there is nothing to mark again.
    """
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.where("bytes > 0").select("path", "bytes", cut)
    ranges = scratch.keep(ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("stop")))
    spread = lambda df: df.repartition(max(1, min(df.count(), 1 << 16)))  # noqa: E731  a range or a few for each task
    known = F.when(F.col("start") == 0, F.lit(0).cast("long"))
    marks = scratch.keep(spread(ranges).select("path", "start", "stop", known.alias("entry")).mapInArrow(_mark, MARKS))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # ranges of one file
    while True:
        due = marks.withColumn("due", F.coalesce(F.last("exit", ignorenulls=True).over(before), F.lit(0)))
        off = F.when(F.col("due") < F.col("stop"), ~F.col("entry").eqNullSafe(F.greatest("due", "start"))).otherwise(F.col("entry").isNotNull())
        wrong = due.where(~F.col("settled") & off).groupBy("path").agg(F.min_by(F.struct("start", "stop", "due"), "start").alias("w")).select("path", "w.*")
        wrong = scratch.keep(wrong)
        if wrong.isEmpty():
            return due
        anew = spread(wrong.select("path", "start", "stop", F.least(F.greatest("due", "start"), "stop").alias("entry"))).mapInArrow(_mark, MARKS)
        marks = scratch.keep(marks.join(wrong.select("path", "start"), ["path", "start"], "left_anti").unionByName(anew))


def _records(payloads: bool):
    def run(batches):
        rows, size = [], 0
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        named = [c.split(" ") for c in RECORDS.split(", ")]

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(named)], names=[n for n, _ in named])

        for batch in batches:
            for path, entry, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = Archive(path)
                at = entry
                while at < min(stop, archive.size):
                    row = _read(archive, path, at, payloads)
                    if row is None:
                        at = next((c for c in archive.candidates(at + 1, stop)), stop)
                        continue
                    rows.append(row)
                    size += 512 + len(row[-1] or b"")
                    at = archive.end
                    if size >= BATCH_BYTES:
                        yield packed()
                        rows, size = [], 0
        if rows:
            yield packed()

    return run


def _read(archive: Archive, path: str, at: int, payloads: bool) -> tuple | None:
    """A row of RECORDS; None where no whole record stands at the place. The payload passes piece by piece and is kept only where asked for."""
    try:
        fields, rest, pieces = archive.header(at)
        left = int(fields["content-length"])
        http, digest, n, kept, head = {}, hashlib.sha1(), 0, [], b""  # noqa: S324 - the format's digest
        inside = not fields.get("content-type", "").startswith("application/http")
        for piece in chain((rest,), pieces):
            piece, left = piece[:left], left - len(piece[:left])
            if not inside:
                head += piece
                text, mark, piece = head.partition(b"\r\n\r\n")
                if not mark:
                    continue
                inside = True
                http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode("latin-1").split("\r\n")[1:])}
            digest.update(piece)
            n += len(piece)
            if payloads:
                kept.append(piece)
        if left:
            return None
    except (zlib.error, ValueError):
        return None
    kind = fields["warc-type"]
    own = base64.b32encode(digest.digest()).decode()
    told = fields.get("warc-payload-digest", "")
    told = told.removeprefix("sha1:") if told.startswith("sha1:") else None
    if kind == "revisit":  # the payload stands in the record that it refers to
        n, own = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None, told
    elif kind == "response" and told not in (None, own):
        raise ValueError(f"the payload at {at} of {path} doesn't have the digest of its record")
    bare = lambda x: x.strip("<>") if x else None
    return (path, at, kind, bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), n, own, b"".join(kept) if payloads and kind != "revisit" else None)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files that a path or pattern names, as Spark's readers find them; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.when(F.col("path").rlike("^file:/[^/]"), F.regexp_replace("path", "^file:/", "file:///")).otherwise(F.col("path")).alias("path"), F.col("length").alias("bytes"))


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True, strict: bool = True) -> DataFrame:
    """files (path, bytes, ...) of gzipped WARC archives -> RECORDS, one row for each record.

    payload is a response's body (of other records the whole block) as it stands there, payload_digest its SHA-1; of
    a revisit both belong to the record that it refers to: the payload is null, payload_bytes comes from its HTTP header and
    the digest from its own header. A response whose payload hasn't the digest that it names fails the job. payloads=False
    leaves payloads out; they are still read and hashed. Bytes that belong to no whole record (damage) fail the job
    where strict, else they are skipped. Files that hold nothing give no rows. Archives that aren't compressed record
    by record can't be read by ranges and count as damage.
    """
    spark = files.sparkSession
    scratch = Scratch(spark)
    marks = marked(files.select("path", F.col("bytes").cast("long").alias("bytes")), scratch, range_bytes)
    if strict:
        # an archive's records stand one after the other, from its start to its end
        gaps = F.bool_or((F.col("damaged") > 0) | F.coalesce(F.col("entry") != F.col("due"), F.lit(False)))
        whole = marks.groupBy("path").agg(gaps.alias("gaps"), F.max("stop").alias("bytes"), F.max("exit").alias("exit"))
        bad = whole.where("gaps or exit is null or exit <> bytes").select("path").first()
        if bad:
            raise ValueError(f"{bad.path} holds bytes that belong to no record")
    own = marks.where("entry is not null").select("path", "entry", "stop")
    own = own.repartition(max(1, min(own.count(), 1 << 16)))
    return scratch.leave(own.mapInArrow(_records(payloads), RECORDS))


def archived_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id, null for responses).

    folder is one that all executors share; by default one under spark.checkpoint.dir, which goes when Python ends.
    """
    scratch = Scratch(pages.sparkSession)
    files = write_archives(pages, folder or scratch.folder("archives"), least_bytes, file_bytes)
    found = read_archives(files, range_bytes, payloads=False).where("record_type in ('response', 'revisit')")
    of = lambda c: F.expr(f"try_cast(nullif(substring({c}, {len(ID) + 1}), '') as long)")
    return found.select(of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", of("refers_to").alias("refers_to"))
