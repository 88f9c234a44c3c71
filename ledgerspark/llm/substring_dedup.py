"""Repeated passages by recompression: equal passages get equal symbols inside, and shared symbols reveal and verify repeats.

A text is a row of words. A round shortens it: each maximal run of one symbol is named after the symbol and its length,
then each symbol falls left or right by its name, and a left one directly before a right one becomes one symbol named after
the two. A name is a keyed 128-bit digest of what it stands for, so it means the same in every text and task.

Each round is a Spark job. It names the runs and pairs of its level and finds, over all texts, which of them occur more than
once (a twice-seen filter of bounded size). A passage that repeats has only repeated symbols inside, so windows with any
other symbol are out, and the next round names only what lies in windows that are still in.

A window's own words decide which symbols lie wholly inside it: in a round its outermost runs may go on outside, and so
may a pair at either end; these are popped and stay words. What is left, the interior, and the popped words on both sides
are the same for equal windows wherever they stand. They bring the windows that are still in after the rounds together;
128 bits of keyed BLAKE2b of a window's words verify that it is equal to another before a word goes, so names that are shared by
accident or design remove nothing. Only these are moved, the earliest of equal ones of a run of chunks.
Texts that are copies of others as a whole are settled before the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .bloom import Filter, filter_of, twice_seen
from .storage import Scratch
from .textbytes import U, mix

WINDOW = 20
MAX_FILTER_BITS = 1 << 27
#: Suspect windows of a shard, about; tasks at most, each of which takes its shards one after the other.
SHARD_WINDOWS, MAX_TASKS = 200_000, 1 << 14
#: Records of windows that a task compares with each other before it sends them on; bytes of a shard that are compared at once.
COMBINE_RECORDS, FOLD_BYTES = 1 << 18, 16 << 20
LAST = np.iinfo(np.int64).max
#: row tells texts apart that share a doc_id; starts of rows without a doc_id have their highest bit set, so that these come last.
#: h1, h2: the digest of the window's words.
RECORD = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("row", "<i8")])
NO_ID = 1 << 31
#: The first round whose names are tested: words and pairs of words repeat nearly always.
FIRST = 2
PLACE = np.dtype([("row", "<i8"), ("doc", "<i8"), ("start", "<u4")])
MOVED, GONE = "shard long, bucket long, data binary", "_row long, _id long, _gone binary"


def rounds_for(window: int) -> int:
    """So many rounds that windows mostly keep an interior; none for windows of a few words."""
    return max(0, int(np.log2(window)) - 1)


class Level:
    """Symbols of a chunk of texts after some rounds: names, first words, and the number of the symbol at each word that begins one."""

    def __init__(self, names: np.ndarray, at: np.ndarray, first: np.ndarray):
        self.names, self.at, self.first = names, at, first

    def _merged(self, keep: np.ndarray, names: np.ndarray) -> Level:
        number = np.cumsum(keep) - 1
        out = Level(names[keep], self.at[keep], np.concatenate(([0], np.cumsum(keep)))[self.first])
        #: which symbol of the next level each of this level's belongs to
        self.number = number
        return out

    def _heads(self) -> np.ndarray:
        head = np.zeros(len(self.names) + 1, bool)
        head[self.first] = True
        return head

    def runs(self) -> Level:
        """Each maximal run as one symbol, named after the symbol and its length; single symbols keep their names."""
        keep = self._heads()[:-1]
        keep[1:] |= (self.names[1:] != self.names[:-1]).any(axis=1)
        begin = np.flatnonzero(keep)
        size = np.diff(np.append(begin, len(keep)))
        names = self.names.copy()
        long = begin[size > 1]
        count = np.zeros((len(long), 2), U)
        count[:, 0], count[:, 1] = size[size > 1], 1  # digests of words are not of this form
        names[long] = tb.join(count, names[long])
        return self._merged(keep, names)

    def sides(self, round_: int) -> np.ndarray:
        """Whether each symbol is a right one."""
        return (mix(self.names[:, 1] ^ U(0xA0761D6478BD642F * (round_ + 1) & (2**64 - 1))) & U(1)).astype(bool)

    def pairs(self, right: np.ndarray) -> Level:
        """Each left symbol directly before a right one as one symbol with it."""
        pair = np.zeros(len(right), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~self._heads()[1:-1]
        names = self.names.copy()
        names[pair] = tb.join(names[pair], names[np.flatnonzero(pair) + 1])
        keep = np.ones(len(right), bool)
        keep[1:] = ~pair[:-1]
        return self._merged(keep, names)


class Chunk:
    """A chunk of texts, its windows (by their first words), and after each round the interior of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, window: int, known: tb.Digests):
        self.spans = *tb.words(offsets, data), data
        starts, ends, self.first, _ = self.spans
        self.words = known.of(data, starts, ends, False)
        self.key = known.key
        size = np.diff(self.first)
        last = np.repeat(self.first[1:], size) - window
        self.at = np.flatnonzero(np.arange(len(starts)) <= last)
        self.window = window
        self.round = 0
        self.level = Level(self.words, np.arange(len(starts)), self.first)
        #: of each window: interior as symbols of the level, from and to; the same as words, of the last level where there was one
        self.lo, self.hi = self.at.copy(), self.at + window
        #: where each window's interior begins in the names of all levels, its size in symbols, its first and last word
        self.names, self.base = [self.words], 0
        self.held = (self.lo.copy(), np.full(len(self.at), window), self.at.copy(), self.at + window)

    def keep(self, go: np.ndarray) -> None:
        """Only these windows stay in."""
        self.at, self.lo, self.hi = self.at[go], self.lo[go], self.hi[go]
        self.held = tuple(x[go] for x in self.held)

    def compress(self) -> None:
        """One round."""
        before = self.level
        runs = before.runs()
        some = self.hi > self.lo
        lo, hi = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        # the outermost runs may go on outside
        lo[some], hi[some] = before.number[self.lo[some]] + 1, before.number[self.hi[some] - 1]
        right = runs.sides(self.round)
        level = runs.pairs(right)
        some &= hi > lo
        # a right symbol may belong to one before it, a left one to one after it
        lo[some], hi[some] = lo[some] + right[lo[some]], hi[some] - ~right[hi[some] - 1]
        some &= hi > lo
        self.lo, self.hi = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        self.lo[some], self.hi[some] = runs.number[lo[some]], runs.number[hi[some] - 1] + 1
        self.level, self.round = level, self.round + 1
        self.base += len(self.names[-1])
        self.names.append(level.names)
        edge = np.append(level.at, len(self.words))
        begin, size, head, tail = (x.copy() for x in self.held)
        begin[some], size[some] = self.base + self.lo[some], self.hi[some] - self.lo[some]
        head[some], tail[some] = edge[self.lo[some]], edge[self.hi[some]]
        self.held = begin, size, head, tail

    def inside(self) -> np.ndarray:
        """First halves of the names of this level's symbols that lie inside any window."""
        n = len(self.level.names) + 1
        step = np.bincount(self.lo, minlength=n) - np.bincount(self.hi, minlength=n)
        return self.level.names[np.cumsum(step)[:-1] > 0, 0]

    def prune(self, held: Filter) -> None:
        """Windows with a symbol that isn't known to repeat go."""
        other = np.concatenate(([0], np.cumsum(~held.holds(np.ascontiguousarray(self.level.names[:, 0])))))
        self.keep(other[self.hi] - other[self.lo] == 0)

    def digests(self) -> np.ndarray:
        """Of each window's words."""
        starts, ends, _, data = self.spans
        return tb.Phrases(data, starts, ends).digests(self.at, self.at + self.window - 1, self.key)

    def keys(self) -> np.ndarray:
        """A name of each window: the words before its interior, the interior's symbols, the words after it."""
        every = np.concatenate(self.names)
        begin, size, head, tail = self.held
        before, after = head - self.at, self.at + self.window - tail
        out = np.stack((before.astype(U) << U(32) | after.astype(U), size.astype(U)), axis=1)
        for edge, count, step, shift in ((head, before, -1, -1), (begin, size, 1, 0), (tail, after, 1, 0)):
            out = tb.join(out, _chains(every, edge, count, step, shift))
        return out


def _chains(names: np.ndarray, edge: np.ndarray, count: np.ndarray, step: int, shift: int) -> np.ndarray:
    """Digests of so many names from each edge on, or before it. Windows mostly share their edges."""
    where, own = np.unique(edge, return_inverse=True)
    most = np.zeros(len(where), np.int64)
    np.maximum.at(most, own, count)
    chain, out = np.ones((len(where), 2), U), np.ones((len(edge), 2), U)
    by = np.argsort(count, kind="stable")
    cut = np.searchsorted(count[by], np.arange(int(count.max(initial=0)) + 2))
    for k in range(1, len(cut) - 1):
        go = np.flatnonzero(most >= k)
        chain[go] = tb.join(chain[go], names[where[go] + step * (k - 1) + shift])
        mine = by[cut[k] : cut[k + 1]]
        out[mine] = chain[own[mine]]
    return out


def _runs(starts: np.ndarray) -> np.ndarray:
    """Ascending starts as pairs of the first and the one after the last of each run."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return np.stack((starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))] + 1), axis=1).astype("<u4")


def _packed(records: np.ndarray, at: np.ndarray, place: np.ndarray):
    """(place, bytes) of the records at these places in their order, one for each place."""
    order = np.argsort(place, kind="stable")
    at, place = at[order], place[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)] * (len(place) > 0)))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(place[a]), records[at[a:b]].tobytes()


def _late(records: np.ndarray, late: np.ndarray, buckets: int):
    """Rows (any shard, bucket, bytes) of windows that occur earlier: their texts and starts."""
    places = np.empty(len(late), PLACE)
    for name in PLACE.names:
        places[name] = records[name][late]
    return [(k, k, x) for k, x in _packed(places, np.arange(len(late)), (places["row"] & np.int64(buckets - 1)).astype(np.int64))]


def _texts(places: np.ndarray):
    """(row, doc_id, runs) of each text among the places."""
    places = places[np.lexsort((places["start"], places["row"], places["doc"]))]
    new = (places["doc"][1:] != places["doc"][:-1]) | (places["row"][1:] != places["row"][:-1])
    cut = np.concatenate(([0], np.flatnonzero(new) + 1, [len(places)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(places["row"][a]), int(places["doc"][a]), _runs(np.unique(places["start"][a:b] & ~np.uint32(NO_ID))).tobytes()


def _groups(batches, done):
    """Rows (key, null, bytes) sorted by key: done(all bytes of a key) of one key after the other. Other rows pass as they come."""
    now, parts = None, []
    for batch in batches:
        out = []
        for key, other, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if other is not None:
                out.append((key, other, x))
                continue
            if key != now and parts:
                out += done(b"".join(parts))
                parts = []
            now = key
            parts.append(x)
        yield out
    if parts:
        yield list(done(b"".join(parts)))


def _later(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each window's records at its earliest place (one for each text that stands there), and of those that start later."""
    order = np.lexsort((records["row"], records["start"], records["doc"], records["h2"], records["h1"]))
    r = records[order]
    new = np.ones(len(r), bool)
    new[1:] = (r["h1"][1:] != r["h1"][:-1]) | (r["h2"][1:] != r["h2"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    same = (r["doc"] == r["doc"][head]) & (r["start"] == r["start"][head])
    new[1:] |= same[1:] & (r["row"][1:] != r["row"][:-1])
    return order[new], order[~same]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the whole window's name, so that windows that share a symbol spread."""
    return ((keys[:, 0] >> U(12)) & U(shards - 1)).astype(np.int64)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    named = [column.split(" ") for column in schema.split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(named)})


def _without(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, window: int, gone: list) -> pa.RecordBatch:
    """The rows without the words of the runs of windows in gone (one entry for each row, or None)."""
    starts, ends, first = tb.words(offsets, data)
    keep = np.ones(len(starts), bool)
    for d, runs in enumerate(gone):
        for a, b in np.frombuffer(runs or b"", "<u4").reshape(-1, 2).tolist():
            keep[first[d] + a : min(first[d] + b - 1 + window, first[d + 1])] = False
    total = np.concatenate(([0], np.cumsum(keep)))[first]
    kept = np.flatnonzero(keep)
    inner = np.ones(len(kept), bool)  # words with a kept word before them in their text
    inner[total[:-1][np.diff(total) > 0]] = False
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[kept]] += 1
    edge[ends[kept]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = data.copy()
    space = starts[kept[inner]] - 1
    mask[space], out[space] = True, 32
    sizes = np.concatenate(([0], np.cumsum(mask)))[offsets]
    text = pa.StringArray.from_buffers(rows.num_rows, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(out[mask]))
    n = np.diff(first)
    return pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n_words": pa.array(n), "n_removed": pa.array(n - np.diff(total)), "text": text})


def remove_repeats(docs: DataFrame, window: int = WINDOW, max_filter_bits: int = MAX_FILTER_BITS, key: bytes = tb.KEY) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, text, one row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A window is `window` consecutive words of one document. Each word covered
    by a window whose words also start earlier (smaller doc_id, or same document and earlier start) goes; the others
    are joined by one space. Windows are judged on the input. Null, empty and blank texts have no words and give an empty
    text; texts of fewer words than a window lose nothing. Rows that share a doc_id stand at the same place: of equal
    windows in them the one with the earlier start comes first, and none does at the same start. Rows without a doc_id
    stand together after all others. An empty table gives an empty result. key is the digests' (up to 64 bytes); results
    are the same for all.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"))
    rounds = rounds_for(window)
    filters: dict = {}  # by round: of the symbols that repeat

    # Texts of the same words throughout are one symbol at the top. All but the first lose every window, and take no further part.
    def whole(batches):
        known = tb.Digests(key)
        for batch in batches:
            for rows, offsets, data in tb.text_chunks(batch):
                starts, ends, first = tb.words(offsets, data)
                raw, n = known.of(data, starts, ends, False), np.diff(first)
                names = np.frombuffer(b"".join([tb.digest(raw[a:b].tobytes(), key) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]), np.int64).reshape(-1, 2)
                every = [np.array([0, max(0, k - window + 1)], "<u4").tobytes() for k in n.tolist()]
                out = {"doc_id": rows.column(0), "row": rows.column(2), "every": pa.array(every, pa.binary()), "d1": pa.array(names[:, 0]), "d2": pa.array(names[:, 1])}
                yield pa.RecordBatch.from_pydict(out).filter(pa.array(n >= window))

    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"))
    texts = scratch.keep(docs.mapInArrow(whole, "doc_id long, row long, every binary, d1 long, d2 long").withColumn("place", place))
    least = texts.groupBy("d1", "d2").agg(F.min("place").alias("least"))
    ranked = scratch.keep(texts.join(least.hint("merge"), ["d1", "d2"]).select("row", "place", "every", (F.col("place") == F.col("least")).alias("leads")))
    leaders = ranked.where("leads").select(F.col("row").alias("key"))
    lead = spark.sparkContext.broadcast(filter_of(leaders, leaders.count(), max_filter_bits))
    copies = ranked.where("not leads").select(F.col("row").alias("_row"), F.col("place.doc").alias("_id"), F.col("every").alias("_gone"))

    def chunks(batches, upto: int):
        """Chunks after so many rounds, with the windows that are still in by the filters so far."""
        known, held, leads = tb.Digests(key), {r: Filter(*f.value) for r, f in filters.items()}, Filter(*lead.value)
        for batch in batches:
            go = leads.holds(batch.column(2).to_numpy().view(U))  # a copy that passes changes nothing
            for rows, offsets, data in tb.text_chunks(batch.filter(pa.array(go))):
                chunk = Chunk(offsets, data, window, known)
                for r in range(upto):
                    if r:
                        chunk.compress()
                    if r in held:
                        chunk.prune(held[r])
                yield rows, chunk

    def round_names(level: int):
        def run(batches):
            for _, chunk in chunks(batches, level + 1):
                names, counts = np.unique(chunk.inside(), return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(names.view(np.int64)), "again": pa.array(counts > 1)})

        return run

    count = 0
    for level in range(min(rounds, FIRST), rounds + 1):
        passing = Scratch(spark)
        named = passing.keep(docs.mapInArrow(round_names(level), "key long, again boolean"))
        count = named.count()
        filters[level] = spark.sparkContext.broadcast(twice_seen(named, count, max_filter_bits))
        passing.drop()
    shards = 1 << int(max(6, np.ceil(np.log2(4 * count / SHARD_WINDOWS + 1))))
    buckets = max(64, shards // 4)

    def suspects(batches):
        held, names, n = [], [], 0

        def sent():
            records, keys = np.concatenate(held), np.concatenate(names)
            early, late = _later(records)
            out = [(k, None, x) for k, x in _packed(records, early, _shard(keys, shards)[early])]
            return _batch(out + _late(records, late, buckets), MOVED)

        for rows, chunk in chunks(batches, rounds + 1):
            if not len(chunk.at):
                continue
            ids, text = rows.column(0), np.searchsorted(chunk.first, chunk.at, "right") - 1
            none = ids.is_null().to_numpy(zero_copy_only=False)
            records = np.empty(len(chunk.at), RECORD)
            records["h1"], records["h2"] = chunk.digests().T
            records["doc"], records["row"] = ids.fill_null(LAST).to_numpy()[text], rows.column(2).to_numpy()[text]
            records["start"] = chunk.at - chunk.first[text] + np.where(none, NO_ID, 0)[text]
            held.append(records)
            names.append(chunk.keys())
            n += len(records)
            if n >= COMBINE_RECORDS:
                yield sent()
                held, names, n = [], [], 0
        if n:
            yield sent()

    def settle(batches):
        """A shard's records as they come; of what has come, only those that may be a window's earliest are held."""
        now, parts, size = None, [], 0

        def fold():
            nonlocal parts, size
            records = np.frombuffer(b"".join(parts), RECORD)
            early, late = _later(records)
            parts = [records[early].tobytes()]
            size = 0
            return _late(records, late, buckets)

        for batch in batches:
            out = []
            for shard, other, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if other is not None:
                    out.append((shard, other, data))
                    continue
                if shard != now:
                    out += fold() if parts else []
                    now, parts, size = shard, [], 0
                parts.append(data)
                size += len(data)
                if size >= FOLD_BYTES:
                    out += fold()
            yield _batch(out, MOVED)
        if parts:
            yield _batch(fold(), MOVED)

    def texts_of(batches):
        for out in _groups(batches, lambda data: _texts(np.frombuffer(data, PLACE))):
            yield _batch(out, GONE)

    # as many tasks as shards up to a bound; shards, which are held one at a time, don't grow with the input
    settled = docs.mapInArrow(suspects, MOVED).repartition(min(shards, MAX_TASKS), "shard").sortWithinPartitions("shard").mapInArrow(settle, MOVED)
    settled = settled.select("bucket", F.lit(None).cast("long").alias("shard"), "data")
    gone = settled.repartition(min(buckets, MAX_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(texts_of, GONE)
    gone = gone.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    gone = scratch.keep(gone.groupBy("_row", "_id").agg(F.max(F.struct("copy", "_gone"))["_gone"].alias("_gone")))
    some = spark.sparkContext.broadcast(filter_of(gone.select(F.col("_row").alias("key")), gone.count(), max_filter_bits))

    def parted(hold: bool):
        """Texts that lose nothing pass as they are; the others, and a few that the filter can't tell, are joined with their windows."""

        def run(batches):
            held = Filter(*some.value)
            for batch in batches:
                hit = held.holds(batch.column(2).to_numpy().view(U))
                if hold:
                    yield batch.filter(pa.array(hit))
                else:
                    for rows, offsets, data in tb.text_chunks(batch.filter(pa.array(~hit))):
                        yield _without(rows, offsets, data, window, [])

        return run

    def apply(batches):
        for batch in batches:
            for rows, offsets, data in tb.text_chunks(batch):
                yield _without(rows, offsets, data, window, rows.column(2).to_pylist())

    out = "doc_id long, n_words long, n_removed long, text string"
    moved = docs.mapInArrow(parted(True), docs.schema)
    # Merged, never broadcast: the same plan at every size.
    same = (moved["row"] == gone["_row"]) & (F.coalesce("doc_id", F.lit(LAST)) == gone["_id"])
    whole = moved.join(gone.hint("merge"), same, "left").select("doc_id", "text", "_gone")
    return scratch.leave(docs.mapInArrow(parted(False), out).unionByName(whole.mapInArrow(apply, out)))
