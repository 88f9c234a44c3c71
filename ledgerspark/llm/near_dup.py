"""Near-duplicate documents: SetSketch registers, banded, joint estimates by likelihood, then exact sets.

Each distinct 5-word shingle of a document sends points of a Poisson process to m registers; a register
keeps its smallest point, rounded down on an exponential scale and truncated (SetSketch, O. Ertl 2021). Registers
of two documents agree about as often as their sets' Jaccard similarity. Registers are mergeable by max.

Plan: sketch in one pass; sets that are equal collapse into one class; classes that share a band of registers
are compared with the band's smallest class (a star, not all pairs). Where the members of a band still lie in
different components after that, they are compared in tiles of two bounded blocks, and a tile gives only the links of
a spanning forest. A pair is dropped by its estimate only where the similarity asked for is out of reach by a wide
likelihood ratio; all others are confirmed on their full sets, and shared shingles on their words. A shingle is named by 128 bits of
keyed BLAKE2b of its words, a set by the same of its sorted shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .bloom import Filter, filter_of
from .components import as_edges, contract, converge, labels
from .storage import Scratch
from .textbytes import U, mix

SHINGLE = 5
#: Registers, and registers in a band. 48 bands of 5 lose a pair at similarity 0.75 with probability 2e-6.
REGISTERS, BAND = 240, 5
BASE, RATE, TOP = 1.001, 20.0, 65534
#: A pair is dropped when the similarity asked for is e**12 times less likely than the best one.
LIKELIHOOD_DROP = 12.0
MAX_FILTER_BITS = 1 << 27
#: Documents in a block of a tile, on average.
TILE = 1024


class Sets:
    """Distinct shingles of each text: 128-bit digests in ascending order, one text's after the other."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, key: bytes):
        starts, ends, self.first = tb.words(offsets, data)
        counts = np.diff(self.first)
        counts = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)  # fewer words are one shingle
        begin = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(begin[-1]) + np.repeat(self.first[:-1] - begin[:-1], counts)
        last = np.minimum(at + SHINGLE, np.repeat(self.first[1:], counts)) - 1
        grams = tb.Phrases(data, starts, ends, lower=True).digests(at, last, key)
        order = np.arange(len(grams))
        lead = np.ascontiguousarray(grams[:, 0])
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            o = lead[a:b].argsort(kind="stable")
            x = grams[a + o]
            if ((x[1:, 0] == x[:-1, 0]) & (x[1:, 1] != x[:-1, 1])).any():
                o = np.lexsort((grams[a:b, 1], lead[a:b]))
            order[a:b] = a + o
        grams = grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]).any(axis=1)
        new[begin[:-1][begin[:-1] < len(grams)]] = True
        #: digests, the number of each one's first word, and where each text's begin
        self.digests, self.at = grams[new], at[order][new]
        self.begin = np.concatenate(([0], np.cumsum(new)))[begin]

    def of(self, text: int) -> slice:
        return slice(int(self.begin[text]), int(self.begin[text + 1]))


class Compared(Sets):
    """Sets of texts that are compared with each other, and their words: shingles count as equal only where these are."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, key: bytes):
        super().__init__(offsets, data, key)
        starts, ends, _ = tb.words(offsets, data)
        raw, numbers = data.tobytes().lower(), {}
        self.word = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)

    def similar(self, x: int, y: int, percent: int) -> bool:
        """Whether two texts' sets are: by their digests, then by the words of each shingle that they share."""
        a, b = self.of(x), self.of(y)
        n = (a.stop - a.start) + (b.stop - b.start)
        dx, dy = self.digests[a], self.digests[b]
        at = np.searchsorted(dy[:, 0], dx[:, 0])
        at[at == len(dy)] = 0
        if not len(dy):
            return False
        same = (dx == dy[at]).all(axis=1)
        shared = int(same.sum())
        if 100 * shared < percent * (n - shared):
            return False
        short = [min(SHINGLE, int(self.first[t + 1] - self.first[t])) for t in (x, y)]
        if short[0] != short[1]:
            return False
        p, q = self.at[a][same], self.at[b][at[same]]
        equal = np.ones(len(p), bool)
        for k in range(short[0]):
            equal &= self.word[p + k] == self.word[q + k]
        shared = int(equal.sum())
        return shared > 0 and 100 * shared >= percent * (n - shared)


def registers(elements: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """uint16 registers (texts x REGISTERS). A text without elements has zeros."""
    n, m = len(begin) - 1, REGISTERS
    least = np.full(n * m, np.inf)
    text = np.repeat(np.arange(n), np.diff(begin))
    element, t, step = elements, np.zeros(len(elements)), 0
    while len(text):
        for _ in range(1 if len(text) > 20000 else 4 if len(text) > 4000 else 24):
            step += 1
            r = mix(element + U((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            at = ((r >> U(32)) * U(m)) >> U(32)
            t = t - np.log(((r & U(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32) / m
            np.minimum.at(least, text * m + at.astype(np.int64), t)
        go = t < least.reshape(n, m).max(axis=1)[text]
        text, element, t = text[go], element[go], t[go]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, TOP + 1).astype(np.uint16).reshape(n, m)


def _sketch(key: bytes):
    def run(batches):
        for batch in batches:
            for rows, offsets, data in tb.text_chunks(batch):
                sets = Sets(offsets, data, key)
                regs = registers(np.ascontiguousarray(sets.digests[:, 0]), sets.begin)
                raw = [tb.digest(sets.digests[sets.of(t)].tobytes(), key) for t in range(rows.num_rows)]
                names = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
                n = np.diff(sets.begin)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column(0),
                    "n": pa.array(n, pa.int64()),
                    "f1": pa.array(names[:, 0]),
                    "f2": pa.array(names[:, 1]),
                    "regs": pa.array([r.tobytes() if f else None for r, f in zip(regs, n > 0, strict=True)], pa.binary()),
                })

    return run


def log_likelihood(j, n_a, n_b, more, less, same):
    """Of a similarity, from how many registers of a are more, less, and the same as b's (SetSketch joint estimator)."""
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    equal = np.clip(1 - up - down, 1e-12, 1)
    return more * np.log(up) + less * np.log(down) + same * np.log(equal)


def hopeful(n_a, n_b, more, less, same, percent: int) -> np.ndarray:
    """Whether the similarity asked for is not much less likely than the best one, and the sizes allow it."""
    asked = percent / 100
    grid = np.concatenate((np.linspace(0, asked, 61), np.linspace(asked, 1, 21)[1:]))
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    best, reached = np.full(len(n_a), -np.inf), np.full(len(n_a), -np.inf)
    for j in grid:
        got = np.where(j <= most + 1e-9, log_likelihood(j, n_a, n_b, more, less, same), -np.inf)
        best = np.maximum(best, got)
        if j >= asked - 1e-9:
            reached = np.maximum(reached, got)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (reached >= best - LIKELIHOOD_DROP)


def _registers_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimate(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            ra, rb = _registers_of(batch.column(4)), _registers_of(batch.column(5))
            more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
            go = hopeful(n_a, n_b, more, less, REGISTERS - more - less, percent)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[go]), "b": pa.array(b[go])})

    return run


def _confirm(percent: int, key: bytes):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            step = 512
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                # the same document often stands in neighbouring rows
                own = pa.chunked_array([part.column(2), part.column(3)]).combine_chunks().dictionary_encode()
                offsets, data = tb.text_column(own.dictionary)
                sets = Compared(offsets - offsets[0], data[offsets[0] : offsets[-1]], key)
                where = own.indices.to_numpy().reshape(2, -1)
                keep = pa.array([sets.similar(x, y, percent) for x, y in where.T.tolist()], pa.bool_())
                yield pa.RecordBatch.from_pydict({"a": part.column(0).filter(keep), "b": part.column(1).filter(keep)})

    return run


def _compare_tile(rows: pa.Table, percent: int, key: bytes):
    """Links between the two blocks of a tile (or inside its one block) that join what isn't joined yet."""
    col = lambda name: rows.column(name)
    ids, n, block, place = (col(c).to_numpy() for c in ("doc_id", "n", "block", "component"))
    i, j, band = col("i")[0].as_py(), col("j")[0].as_py(), col("band")[0].as_py()
    regs = _registers_of(col("regs"))
    codes = np.ascontiguousarray(regs).view([("", np.uint16)] * BAND)
    offsets, data = tb.text_column(col("text"))
    sets = Compared(offsets - offsets[0], data[offsets[0] : offsets[-1]], key)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    root = {c: c for c in np.unique(place).tolist()}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    step = 32
    for at in range(0, len(left), step):
        l = left[at : at + step]  # noqa: E741
        go = place[l][:, None] != place[right][None, :]
        if i == j:
            go &= l[:, None] < right[None, :]
        for k in range(band):  # a pair belongs to its first common band
            go &= codes[l, k][:, None] != codes[right, k][None, :]
        x, y = np.nonzero(go)
        x, y = l[x], right[y]
        for part in range(0, len(x), 4096):
            a, b = x[part : part + 4096], y[part : part + 4096]
            more, less = (regs[a] > regs[b]).sum(axis=1), (regs[a] < regs[b]).sum(axis=1)
            same = REGISTERS - more - less
            hope = np.flatnonzero(hopeful(n[a], n[b], more, less, same, percent))
            for p in hope[np.argsort(-same[hope], kind="stable")].tolist():
                u, v = find(int(place[a[p]])), find(int(place[b[p]]))
                if u != v and sets.similar(int(a[p]), int(b[p]), percent):
                    root[v] = u
                    yield int(ids[a[p]]), int(ids[b[p]])


def _tiles(percent: int, key: bytes):
    """Rows of one tile after the other; a tile is held at a time."""

    def run(batches):
        held, now = [], None
        for batch in batches:
            place = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bucket", "i", "j")])
            cut = np.concatenate(([0], np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1, [batch.num_rows]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b > a:
                    mine = tuple(place[:, a].tolist())
                    if mine != now and held:
                        yield links(held)
                        held = []
                    now = mine
                    held.append(batch.slice(a, b - a))
        if held:
            yield links(held)

    def links(held):
        found = list(_compare_tile(pa.Table.from_batches(held).combine_chunks(), percent, key))
        return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents named by ids (doc_id, distinct), and of a few others: only these are moved, by a
    filter of bounded size; the joins that follow settle which are needed."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(filter_of(ids.select(F.xxhash64("doc_id").alias("key")), ids.count(), MAX_FILTER_BITS))

    def needed(batches):
        held = Filter(*wanted.value)
        for batch in batches:
            go = held.holds(batch.column(2).to_numpy().view(U))
            yield batch.filter(pa.array(go)).select([0, 1])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(needed, "doc_id long, text string")


def _star_links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, key: bytes, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b) of classes' smallest documents, those that are similar enough."""
    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"r_{k}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    pairs = scratch.keep(pairs.mapInArrow(_estimate(percent), "a long, b long").distinct())
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = scratch.keep(_texts(ids, docs))
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t_{k}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")
    return scratch.keep(full.mapInArrow(_confirm(percent, key), "a long, b long").distinct())


def _tile_links(rest: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, key: bytes, scratch: Scratch) -> DataFrame:
    """Links between members (bucket, band, blocks, doc_id, component) of a bucket in different components."""
    texts = scratch.keep(_texts(scratch.keep(rest.select("doc_id").distinct()), docs))
    block = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("blocks"))
    full = rest.withColumn("block", block).join(reps, "doc_id").join(texts, "doc_id")
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    full = full.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    placed = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return scratch.keep(placed.mapInArrow(_tiles(percent, key), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, percent: int = 75, key: bytes = tb.KEY) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, one row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A set is the distinct 5-word shingles of the whole text;
    with fewer words the whole sequence is one shingle. Two documents are linked when
    100 * |A and B| >= percent * |A or B|. component_id is the smallest doc_id reachable, kept says that it is the
    row's own. Null, empty and blank texts have 0 shingles and are linked with nothing. Rows that share a doc_id
    are one document as to links. Rows without a doc_id link with nothing: null component_id, kept true. An empty
    table gives an empty result. Other columns don't matter. key is the digests' (up to 64 bytes); results are the same for all.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.keep(docs.mapInArrow(_sketch(key), "doc_id long, n long, f1 long, f2 long, regs binary"))
    named = sketched.where("n > 0 and doc_id is not null")
    classes = named.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id"))
    reps = scratch.keep(named.join(classes, ["doc_id", "n", "f1", "f2"]).dropDuplicates(["doc_id", "n", "f1", "f2"]).select("doc_id", "n", "regs"))

    bands = REGISTERS // BAND
    code = F.expr(f"posexplode(transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(regs, i * {2 * BAND} + 1, {2 * BAND}))))")
    member = reps.select("doc_id", code.alias("band", "bucket"))
    shared = member.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot <> last")
    member = scratch.keep(member.join(shared.select("bucket", "pivot"), "bucket"))
    star = member.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _star_links(star, reps, docs, percent, key, scratch)
    edges = scratch.keep(contract(as_edges(links), scratch))

    # What is left to compare: members of a bucket that aren't known to be in one component, neither of them its pivot.
    found = scratch.keep(labels(edges))
    placed = member.where("doc_id <> pivot").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.where("lo <> hi").select("bucket", F.ceil(F.col("size") / TILE).alias("blocks"))
    rest = scratch.keep(placed.join(mixed, "bucket"))
    if not rest.isEmpty():
        edges = edges.unionByName(as_edges(_tile_links(rest, reps, docs, percent, key, scratch)))
    found = labels(converge(edges, scratch))

    classes = classes.withColumnRenamed("doc_id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    # Written, so that both sides of the last join are plain exchanges, of which large partitions can be split.
    classes = scratch.keep(classes.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")))
    out = sketched.drop("regs").join(classes, ["n", "f1", "f2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
    return scratch.finish(out)
