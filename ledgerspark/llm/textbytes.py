"""Words and lines of whole texts, found and hashed over the UTF-8 bytes of Arrow columns with numpy.

Word separators and line ends are ASCII bytes, which never occur inside a longer UTF-8 sequence, so bytes
and code points give the same cuts. What decides equality are 128 bits of keyed BLAKE2b over the bytes of a word, line or phrase
(a short word's own bytes for it); they depend on the content only. Joins of digests are faster and not as strong: they
may only name what such a digest settles afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Of the digests of words and lines. They decide what counts as equal; pass a secret of your own for hostile texts.
KEY = b"ledgerspark-words"
#: Longer words that a worker remembers the digests of, and the longest such word; words that are worked on at once.
KNOWN, KNOWN_BYTES = 1 << 17, 64
PART_WORDS = 1 << 15


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def text_chunks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK_BYTES of text each: the rows, offsets from 0, bytes.

    What earlier batches held is given back first: a worker outlives its task and shares the executor's memory.
    """
    pa.default_memory_pool().release_unused()
    offsets, data = text_column(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def digest(data: bytes, key: bytes = KEY) -> bytes:
    """128 bits of keyed BLAKE2b."""
    return hashlib.blake2b(data, digest_size=16, key=key).digest()


class Digests(dict):
    """128 bits for each word. A word of up to 15 bytes is those bytes and their number, mixed one to one, so that no two
    share a digest; a longer one is digest(word), remembered within bounds."""

    def __init__(self, key: bytes = KEY):
        super().__init__()
        self.key, self.halves = key, np.frombuffer(digest(b"", key), U)

    def __missing__(self, word: bytes) -> bytes:
        out = digest(word, self.key)
        if len(word) <= KNOWN_BYTES:
            self[word] = out
        return out

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """Rows of two 64-bit halves, of the words at these spans; A-Z as a-z where asked."""
        out = np.empty((len(starts), 2), U)
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        if lower:
            padded = np.frombuffer(padded.tobytes().lower(), np.uint8)
        views = np.lib.stride_tricks.sliding_window_view(padded, 16)
        for at in range(0, len(starts), PART_WORDS):
            s, e = starts[at : at + PART_WORDS], ends[at : at + PART_WORDS]
            size = e - s
            raw = views[s]
            raw[np.arange(16) >= np.minimum(size, 15)[:, None]] = 0
            part = raw.view("<u8")
            part[:, 1] |= size.astype(U) << U(56)
            part[:, 0] = mix(part[:, 0] ^ self.halves[0])
            part[:, 1] = mix(part[:, 1] ^ self.halves[1] ^ part[:, 0])
            part[:, 0] += part[:, 1]
            long = np.flatnonzero(size > 15)
            if len(long):
                if len(self) > KNOWN:
                    self.clear()
                words = [padded[a:b].tobytes() for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True)]
                part[long] = np.frombuffer(b"".join(map(self.__getitem__, words)), U).reshape(-1, 2)
            out[at : at + PART_WORDS] = part
        return out


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words `[^\\x20\\x09-\\x0D]+` of the chunk, and for each text the number of its first word."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of what is named by the rows of a followed by those of b. Four words pass one after the other through a state
    of two, so that both halves depend on each of them; a name is no proof that two things are equal."""
    x, y = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
    for word in (a[:, 0], a[:, 1], b[:, 0], b[:, 1]):
        x = mix(word ^ x) + y
        y = ((x ^ y) * U(0xD6E8FEB86659FD93)) ^ (x >> U(29))
    return np.stack((mix(x ^ y), y), axis=1)


class Phrases:
    """The words of a chunk with one space between them, A-Z as a-z where asked, and digests of runs of words."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False):
        # of what follows a word one byte stays, as a space; a word that ends its text may have none
        space = np.zeros(len(data) + 1, bool)
        space[ends] = True
        space = space[:-1] & SEPARATOR[data]
        size, apart = ends - starts, np.append(space, False)[ends]
        self.end = np.cumsum(size + apart) - apart
        self.start = self.end - size
        keep = ~SEPARATOR[data] | space
        joined = data[keep]
        joined[space[keep]] = 32
        self.raw = joined.tobytes().lower() if lower else joined.tobytes()

    def digests(self, first: np.ndarray, last: np.ndarray, key: bytes = KEY) -> np.ndarray:
        """128 bits of keyed BLAKE2b of each run of words, by the numbers of its first and last one."""
        begin, raw = hashlib.blake2b(digest_size=16, key=key).copy, self.raw
        out = np.empty((len(first), 2), U)
        for at in range(0, len(first), PART_WORDS):
            parts = []
            for a, b in zip(self.start[first[at : at + PART_WORDS]].tolist(), self.end[last[at : at + PART_WORDS]].tolist(), strict=True):
                run = begin()
                run.update(raw[a:b])
                parts.append(run.digest())
            out[at : at + PART_WORDS] = np.frombuffer(b"".join(parts), U).reshape(-1, 2)
        return out
