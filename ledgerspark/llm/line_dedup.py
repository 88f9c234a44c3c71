"""Repeated lines, found with two Bloom filters before anything but hashes is moved.

Pass 1 sends the first half of each long line's 128-bit digest to the task of its segment; the task puts it into the
once-seen filter and, when it was there already, into the twice-seen filter. Only the twice-seen filter leaves the task,
at a bounded size. Pass 2 reads the documents again: lines in the twice-seen filter are suspected repeats, and only those
shuffle, as whole digests, for the exact count of documents and the choice of the one that keeps the line. Pass 3 drops
lines by whole digests. A wrong hit in a filter costs a row in a shuffle and never changes the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .bloom import Filter, filter_of, twice_seen
from .storage import Scratch
from .textbytes import U

MIN_CHARS, MIN_DOCS = 40, 5
#: Of the twice-seen filter, which is broadcast: 16 MB.
MAX_FILTER_BITS = 1 << 27
#: Repeated keys that are broadcast at most: 12 MB. Beyond that they are joined.
MAX_KEYS = 1 << 19


class Lines:
    """All lines of a chunk: begin of each text's lines, spans, and the spans, digests of those long enough to count."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, min_chars: int):
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        inside = np.searchsorted(offsets, breaks, "right") - 1
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(inside, minlength=n) + 1)))
        self.starts = np.empty(self.begin[-1], np.int64)
        self.ends = np.empty(self.begin[-1], np.int64)
        head, tail = np.zeros(self.begin[-1], bool), np.zeros(self.begin[-1], bool)
        head[self.begin[:-1]] = True
        tail[self.begin[1:] - 1] = True
        self.starts[head], self.starts[~head] = offsets[:-1], breaks + 1
        self.ends[tail], self.ends[~tail] = offsets[1:], breaks
        solid = np.flatnonzero(~tb.SEPARATOR[data])
        lo, hi = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        some = np.flatnonzero(hi > lo)
        lo, hi = solid[lo[some]], solid[hi[some] - 1] + 1
        long = points[hi] - points[lo] >= min_chars
        #: of the lines that count: which they are, their keys' spans, their text
        self.at, self.lo, self.hi = some[long], lo[long], hi[long]
        raw = data.tobytes().lower()
        self.digest = np.frombuffer(b"".join([tb.digest(raw[a:b]) for a, b in zip(self.lo.tolist(), self.hi.tolist(), strict=True)]), U).reshape(-1, 2)
        self.text = np.searchsorted(self.begin, self.at, "right") - 1


def _once_each(lines: Lines) -> np.ndarray:
    """Places of the first occurrence of each key in each text."""
    d = lines.digest
    order = np.lexsort((np.arange(len(d)), d[:, 1], d[:, 0], lines.text))
    new = np.ones(len(order), bool)
    new[1:] = (d[order][1:] != d[order][:-1]).any(axis=1) | (lines.text[order][1:] != lines.text[order][:-1])
    return np.sort(order[new])


def suspects_filter(docs: DataFrame, min_chars: int, max_bits: int, scratch: Scratch) -> tuple[bytes, int]:
    """The twice-seen filter over the keys of long lines of all documents."""

    def keys(batches):
        for batch in batches:
            for _, offsets, data in tb.text_chunks(batch):
                lines = Lines(offsets, data, min_chars)
                got, counts = np.unique(lines.digest[_once_each(lines), 0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(got.view(np.int64)), "again": pa.array(counts > 1)})

    found = scratch.keep(docs.mapInArrow(keys, "key long, again boolean"))
    return twice_seen(found, found.count(), max_bits)


class Keepers:
    """Repeated keys and the largest document that holds each."""

    def __init__(self, blocks: list[bytes]):
        rows = np.frombuffer(b"".join(blocks), np.int64).reshape(-1, 3)
        self.rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def keeper(self, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is repeated, and its keeper."""
        d = digest.view(np.int64)
        at = np.searchsorted(self.rows[:, 0], d[:, 0])
        found, keeper = np.zeros(len(d), bool), np.zeros(len(d), np.int64)
        go = np.arange(len(d))
        while len(go):  # keys that share their first half stand next to each other
            go = go[at[go] < len(self.rows)]
            go = go[self.rows[at[go], 0] == d[go, 0]]
            same = self.rows[at[go], 1] == d[go, 1]
            found[go[same]] = True
            keeper[go[same]] = self.rows[at[go[same]], 2]
            at[go] += 1
            go = go[~same]
        return found, keeper


def _block(batches):
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        yield pa.RecordBatch.from_pydict({"data": pa.array([np.stack(columns, axis=1).tobytes()], pa.binary())})


def _without(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, lines: Lines, gone: np.ndarray) -> dict:
    """text, n_lines and n_dropped of the rows without the lines of gone, which says so for each line that counts."""
    size = np.diff(lines.begin)
    keep = np.ones(lines.begin[-1], bool)
    keep[lines.at[gone]] = False
    dropped = np.bincount(lines.text[gone], minlength=rows.num_rows)
    texts = rows.column(rows.schema.get_field_index("text"))
    hit = np.flatnonzero(dropped)
    if len(hit):
        raw, texts = data.tobytes(), texts.cast(pa.binary()).to_pylist()
        for d in hit.tolist():
            stay = lines.begin[d] + np.flatnonzero(keep[lines.begin[d] : lines.begin[d + 1]])
            texts[d] = b"\n".join([raw[a:b] for a, b in zip(lines.starts[stay].tolist(), lines.ends[stay].tolist(), strict=True)])
        # bytes that aren't UTF-8 pass as they came
        texts = pa.Array.from_buffers(pa.string(), len(texts), pa.array(texts, pa.binary()).buffers())
    return {"text": texts, "n_lines": pa.array(size, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bits: int = MAX_FILTER_BITS, max_keys: int = MAX_KEYS
) -> DataFrame:
    """docs with text without its repeated lines, and n_lines, n_dropped.

    Texts are split at \\n; a line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. Keys of
    at least min_chars code points found in at least min_docs distinct doc_ids lose all their lines except in the
    largest doc_id. A null or empty text is one empty line; it stays as it is, as does any text that loses nothing. A
    text that loses every line becomes empty. Rows that share a doc_id count as one document and keep or lose a line
    alike; rows without a doc_id count for no key and lose every line that some other document may keep. Columns
    n_lines and n_dropped of docs are replaced; names that begin with __line_ are taken, all other columns pass. An empty
    table gives an empty result.

    Up to max_keys repeated keys (24 bytes each) are broadcast, and no text is moved. Beyond that, documents that
    hold none by a filter of bounded size still pass as they are, and only the others are joined with their lines.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.drop("n_lines", "n_dropped").withColumns({"text": F.col("text").cast("string"), "__line_doc": F.col("doc_id").cast("long")})
    plain = docs.select("__line_doc", "text")
    twice = spark.sparkContext.broadcast(suspects_filter(plain, min_chars, max_filter_bits, scratch))

    def of(rows: pa.RecordBatch, lines: Lines, at: np.ndarray, name: str) -> pa.RecordBatch:
        digest = lines.digest[at].view(np.int64)
        own = rows.column(rows.schema.get_field_index(name)).take(pa.array(lines.text[at]))
        return pa.RecordBatch.from_pydict({name: own, "d1": pa.array(digest[:, 0]), "d2": pa.array(digest[:, 1])})

    def suspects(batches):
        held = Filter(*twice.value)
        for batch in batches:
            for rows, offsets, data in tb.text_chunks(batch):
                lines = Lines(offsets, data, min_chars)
                at = _once_each(lines)
                yield of(rows, lines, at[held.holds(lines.digest[at, 0])], "__line_doc")

    found = plain.where("__line_doc is not null").mapInArrow(suspects, "__line_doc long, d1 long, d2 long")
    each = found.groupBy("d1", "d2", "__line_doc").agg(F.lit(1).alias("one"))
    repeated = each.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("docs"), F.max("__line_doc").alias("keeper")).where(F.col("docs") >= min_docs)
    repeated = scratch.keep(repeated.select("d1", "d2", "keeper"))
    count = repeated.count()

    names = [n for n in docs.columns if not n.startswith("__line_")]
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    passed = lambda rows: {n: rows.column(rows.schema.get_field_index(n)) for n in names}

    if count <= max_keys:
        blocks = [bytes(r[0]) for r in repeated.mapInArrow(_block, "data binary").collect()]  # 24 * max_keys bytes at most
        scratch.drop()
        shared = spark.sparkContext.broadcast(blocks)

        def apply(batches):
            keepers = Keepers(shared.value)
            for batch in batches:
                for rows, offsets, data in tb.text_chunks(batch):
                    lines = Lines(offsets, data, min_chars)
                    gone, keeper = keepers.keeper(lines.digest)
                    ids = rows.column(rows.schema.get_field_index("__line_doc")).take(pa.array(lines.text))
                    gone &= ids.is_null().to_numpy(zero_copy_only=False) | (ids.fill_null(0).to_numpy() != keeper)
                    yield pa.RecordBatch.from_pydict(passed(rows) | _without(rows, offsets, data, lines, gone))

        return docs.mapInArrow(apply, schema)

    some = spark.sparkContext.broadcast(filter_of(repeated.select(F.col("d1").alias("key")), count, max_filter_bits))

    def parted(hold: bool):
        def run(batches):
            held = Filter(*some.value)
            for batch in batches:
                for rows, offsets, data in tb.text_chunks(batch):
                    lines = Lines(offsets, data, min_chars)
                    hit = np.zeros(rows.num_rows, bool)
                    hit[lines.text[held.holds(lines.digest[:, 0])]] = True
                    if hold:
                        yield rows.filter(pa.array(hit))
                    else:
                        out = passed(rows) | _without(rows, offsets, data, lines, np.zeros(len(lines.at), bool))
                        yield pa.RecordBatch.from_pydict(out).filter(pa.array(~hit))

        return run

    def own_lines(batches):
        held = Filter(*some.value)
        for batch in batches:
            for rows, offsets, data in tb.text_chunks(batch):
                lines = Lines(offsets, data, min_chars)
                at = _once_each(lines)
                yield of(rows, lines, at[held.holds(lines.digest[at, 0])], "__line_row")

    def apply_rows(batches):
        for batch in batches:
            for rows, offsets, data in tb.text_chunks(batch):
                lines = Lines(offsets, data, min_chars)
                gone = np.zeros(len(lines.at), bool)
                first = np.searchsorted(lines.text, np.arange(rows.num_rows + 1))
                for d, drops in enumerate(rows.column(rows.schema.get_field_index("__line_gone"))):
                    if drops.is_valid:
                        a, b = first[d], first[d + 1]
                        own = {(x["d1"], x["d2"]) for x in drops.as_py()}
                        gone[a:b] = [x in own for x in map(tuple, lines.digest[a:b].view(np.int64).tolist())]
                yield pa.RecordBatch.from_pydict(passed(rows) | _without(rows, offsets, data, lines, gone))

    touched = scratch.keep(docs.mapInArrow(parted(True), docs.schema).withColumn("__line_row", F.monotonically_increasing_id()))
    lost = touched.select("__line_row", "text").mapInArrow(own_lines, "__line_row long, d1 long, d2 long")
    lost = lost.join(touched.select("__line_row", "__line_doc"), "__line_row").join(repeated.hint("merge"), ["d1", "d2"])
    lost = lost.where("__line_doc is null or __line_doc <> keeper").groupBy("__line_row").agg(F.collect_list(F.struct("d1", "d2")).alias("__line_gone"))
    whole = touched.join(scratch.keep(lost).hint("merge"), "__line_row", "left")
    return scratch.leave(docs.mapInArrow(parted(False), schema).unionByName(whole.mapInArrow(apply_rows, schema)))
