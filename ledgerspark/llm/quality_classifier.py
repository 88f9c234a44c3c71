"""A quality classifier by compression: text compresses better with a dictionary built from text of its own kind.

Two zstandard dictionaries are built from good and from bad labelled texts. A text is compressed with each, in blocks
so that a dictionary helps alike all along a long text. The difference of the two compressed sizes over their sum becomes a
probability by a logistic curve in that one number, calibrated on labelled texts which the dictionaries haven't seen.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import Scratch

BLOCK, LEVEL, DICTIONARY = 512, 3, 112 << 10
#: Labelled rows of each class that are read at most, and blocks of each of them for a dictionary, for fitting only.
TRAIN_ROWS, TRAIN_BLOCKS = 2000, 40


def blocks(data: bytes, size: int = BLOCK):
    for at in range(0, len(data), size):
        yield data[at : at + size]


def spread(data: bytes, most: int) -> bytes:
    """A text's blocks, or of more than `most` those of the smallest hash, wherever they stand."""
    cut = list(blocks(data))
    least = sorted(range(len(cut)), key=lambda i: (zlib.crc32(cut[i]), i))[:most]
    return b"".join(cut[i] for i in sorted(least))


def dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """Of the same size and kind, so that neither has an advantage: trained, or where there is too little to train on,
    the texts' own last bytes."""
    samples = [[b for t in texts for b in blocks(t)] for texts in (good, bad)]
    least = min(sum(map(len, x)) for x in samples)
    try:
        size = min(DICTIONARY, least // 8)
        out = [zstandard.train_dictionary(size, x, level=LEVEL).as_bytes() for x in samples] if size >= 4096 else []
    except zstandard.ZstdError:
        out = []
    size = min(DICTIONARY, least)
    return tuple(out or [b"".join(x)[-size:] if size else b"" for x in samples])


class Sizes:
    """Sizes of texts when compressed with a dictionary."""

    def __init__(self, data: bytes):
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False}
        if data:
            options |= {"dict_data": zstandard.ZstdCompressionDict(data), "write_dict_id": False}
            options["dict_data"].precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(**options).compress

    def __call__(self, data: bytes) -> int:
        return sum(len(self.compress(b)) for b in blocks(data))


def difference(good: Sizes, bad: Sizes, data: bytes) -> float:
    """How much smaller the good dictionary makes a text than the bad one does, over the sum of both sizes; 0 for none."""
    g, b = good(data), bad(data)
    return (b - g) / (b + g) if b + g else 0.0


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: of the logistic curve in the difference
    slope: float
    offset: float

    def scorer(self):
        """A function from a list of texts' bytes to scores between 0 and 1."""
        sizes = Sizes(self.good), Sizes(self.bad)

        def score(texts: list[bytes]) -> np.ndarray:
            z = np.array([difference(*sizes, t) for t in texts]) * self.slope + self.offset
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset by Newton's method, of x in units of its spread; the slope has a small ridge."""
    unit = x.std() + 1e-9
    a = np.stack((x / unit, np.ones(len(x))), axis=1)
    w, keep = np.zeros(2), np.diag([ridge, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / unit), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, each: int = TRAIN_BLOCKS) -> Model:
    """A model from labels (doc_id, quality 0/1) of doc_ids whose crc32 mod 3 is not 1.

    Reads at most `rows` labelled documents of each class, those of the smallest hash, as whole texts: the dictionaries
    get up to `each` blocks of a text, by hash from all of it; calibration measures all of it, on the executors. With
    fewer than two of a class every score is the labels' share of good ones, 0.5 without labels.
    Conflicting labels of one doc_id count as their largest; null labels don't count. Of documents that share a doc_id
    the one whose text has the smallest hash counts.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("long").alias("quality"))
    order = F.xxhash64(F.lit(7), "doc_id")
    picked = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(rows) for q in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * rows rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    found = texts.join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("own"))
    found = scratch.keep(found.select("quality", F.xxhash64(F.lit(11), "doc_id").alias("h"), "own.t", "own.text"))
    got = sorted(tuple(r) for r in found.select("quality", "h", "t").collect())
    keys = {q: [k for k in got if k[0] == q] for q in (0, 1)}
    # the first of each class that is for calibration; those before are for the dictionaries
    edge = {q: k[(len(k) + 1) // 2] if len(k) > 1 else (q + 1,) for q, k in keys.items()}
    total = {q: known.where(F.col("quality") == q).count() for q in (0, 1)}

    def texts_of(batches, calibration):
        for batch in batches:
            for q, h, t, text in zip(*batch.columns, strict=True):
                key = (q.as_py(), h.as_py(), t.as_py())
                if (key >= edge[key[0]]) == calibration:
                    yield *key, text.as_py().encode()

    def parts(batches):
        for *key, data in texts_of(batches, False):
            yield pa.RecordBatch.from_pylist([dict(zip("qht", key, strict=True), data=spread(data, each))])

    def measured(batches):
        sizes = [Sizes(d) for d in shared.value]
        for *key, data in texts_of(batches, True):
            yield pa.RecordBatch.from_pylist([dict(zip("qhtx", (*key, difference(*sizes, data)), strict=True))])

    sample = sorted(tuple(r) for r in found.mapInArrow(parts, "q long, h long, t long, data binary").collect())
    good, bad = dictionaries(*([bytes(r[3]) for r in sample if r[0] == q] for q in (1, 0)))
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))
    seen = sorted(tuple(r) for r in found.mapInArrow(measured, "q long, h long, t long, x double").collect())
    scratch.drop()
    n = [sum(r[0] == q for r in seen) for q in (0, 1)]
    if not all(n):  # nothing to calibrate on: everything is what the labels mostly are
        return Model(good, bad, 0.0, float(np.log((total[1] + 0.5) / (total[0] + 0.5))))
    slope, offset = _logistic(np.array([r[3] for r in seen]), np.repeat([0.0, 1.0], n))
    # The sample may hold the classes in other shares than the labels do; the prior is that of all labels.
    return Model(good, bad, slope, offset + float(np.log(total[1] / total[0]) - np.log(n[1] / n[0])))


def held_out(doc_id):
    """Whether a document is kept from fitting: crc32 of its id as text is 1 mod 3. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double, of the whole text's bytes alone. Null and empty texts get a score like any others.

    Rows are scored one by one: equal texts get equal scores, an empty table gives an empty result. A column score of
    docs is replaced; all others pass.
    """
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            for rows, offsets, data in tb.text_chunks(batch):
                raw = data.tobytes()
                ends = offsets.tolist()
                got = of([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
                yield pa.RecordBatch.from_pydict({n: rows.column(rows.schema.get_field_index(n)) for n in names} | {"score": pa.array(got, pa.float64())})

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("double").alias("score")).schema)
