"""Bloom filters of a bounded size over 64-bit hashes.

The number of bits is chosen by the number of keys up to a fixed most, so what is broadcast never exceeds
max_bits / 8 bytes whatever the input's size. Past that, more keys pass that needn't; callers confirm each
key that passes, so results stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U, mix

PROBES = 4
#: Filters beyond 2**SEGMENT bits are filled in segments of that size.
SEGMENT = 23


def places(keys: np.ndarray, bits: int):
    """Byte and bit of each key's probes in a filter of so many bits, a power of two."""
    a, b = mix(keys), mix(keys ^ U(0x5851F42D4C957F2D)) | U(1)
    for k in range(PROBES):
        p = (a + U(k) * b) & U(bits - 1)
        yield (p >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & U(7)).astype(np.uint8))


class Bits:
    """One filter that is being filled."""

    def __init__(self, bits: int):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for at, bit in places(keys, self.bits):
            np.bitwise_or.at(self.data, at, bit)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at, bit in places(keys, self.bits):
            out &= (self.data[at] & bit) != 0
        return out


def bits_for(keys: int) -> int:
    """A power of two, about 12 bits a key."""
    return 1 << max(13, int(np.ceil(np.log2(12 * keys + 1))))


def _gather(parts: DataFrame, segments: int, each: int) -> tuple[bytes, int]:
    out = np.zeros(segments * each // 8, np.uint8)
    for row in parts.toLocalIterator():
        at = row["segment"] * (each // 8)
        out[at : at + each // 8] |= np.frombuffer(row["data"], np.uint8)
    return out.tobytes(), segments


def _segment(s: int, data: Bits) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int64()), "data": pa.array([data.data.tobytes()], pa.binary())})


def filter_of(keys: DataFrame, count: int, max_bits: int) -> tuple[bytes, int]:
    """The filter of the long column `key`, whose values are hashes, and its number of segments.

    A key's low bits name its segment, and one task fills a segment, so each segment is sent once; the driver gets
    max_bits / 8 bytes at most.
    """
    bits = min(max_bits, bits_for(count))
    segments = max(1, bits >> SEGMENT)
    each = bits // segments

    def fill(batches):
        own: dict[int, Bits] = {}
        for batch in batches:
            got = batch.column(0).to_numpy().view(U)
            for s in np.unique(got & U(segments - 1)).tolist():
                own.setdefault(s, Bits(each)).add(got[(got & U(segments - 1)) == U(s)])
        for s, f in own.items():
            yield _segment(s, f)

    placed = keys.select("key").repartition(segments, F.expr(f"pmod(key, {segments})"))
    return _gather(placed.mapInArrow(fill, "segment long, data binary"), segments, each)


def twice_seen(keys: DataFrame, count: int, max_bits: int) -> tuple[bytes, int]:
    """The twice-seen filter of (key long, again boolean), and its number of segments.

    again: the key was met more than once already. Each segment's task holds a once-seen filter of a fixed size (there
    are as many segments as all keys need); a key that is in it already goes into the segment's twice-seen filter.
    Only those come to the driver, together max_bits / 8 bytes at most.
    """
    bits = bits_for(count)
    segments = max(1, bits >> SEGMENT)
    each = bits // segments
    each_twice = max(1 << 10, min(each, max_bits // segments))

    def fill(batches):
        own: dict[int, tuple[Bits, Bits]] = {}
        for batch in batches:
            got, again = batch.column(0).to_numpy().view(U), batch.column(1).to_numpy(zero_copy_only=False)
            for s in np.unique(got & U(segments - 1)).tolist():
                mine = (got & U(segments - 1)) == U(s)
                once, twice = own.setdefault(s, (Bits(each), Bits(each_twice)))
                key, where, counts = np.unique(got[mine], return_inverse=True, return_counts=True)
                repeated = counts > 1
                np.logical_or.at(repeated, where, again[mine])
                twice.add(key[repeated | once.holds(key)])
                once.add(key)
        for s, (_, twice) in own.items():
            yield _segment(s, twice)

    placed = keys.select("key", "again").repartition(segments, F.expr(f"pmod(key, {segments})"))
    return _gather(placed.mapInArrow(fill, "segment long, data binary"), segments, each_twice)


class Filter:
    """Tests keys against what filter_of() or twice_seen() returned."""

    def __init__(self, data: bytes, segments: int):
        self.segments = segments
        self.each = len(data) * 8 // segments
        self.whole = np.frombuffer(data, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        base = (keys & U(self.segments - 1)).astype(np.int64) * (self.each // 8)
        out = np.ones(len(keys), bool)
        for at, bit in places(keys, self.each):
            out &= (self.whole[base + at] & bit) != 0
        return out
