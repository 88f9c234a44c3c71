"""Byte-level BPE as a transducer that is made deterministic as it is used, and a streaming decoder.

Read left to right, every prefix of a piece has one encoding, and a row of tokens is the encoding of its bytes exactly
when each neighbouring pair is (Berglund and van der Merwe, 2023). A state holds the positions at which a token may
still begin, with the token that ends there, and the bytes since the farthest. A transition by a byte gives the next
state and the last token of the prefix so read. Tokens are emitted as soon as all positions of the state have them in
common, so the lookahead is bounded by the longest token. States and transitions are made when first met.
"""

from __future__ import annotations

import base64
import itertools
import math
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Bounds of what a Python worker remembers; past them the older half is forgotten and made again when met.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 1 << 18, 1 << 17, 1 << 16
START = -1
BYTES = [bytes((i,)) for i in range(256)]
#: Bytes after which tokens are emitted, in pieces longer than that.
EMIT = 256


def _runs(data: bytes) -> int:
    """The state of the UTF-8 machine after these bytes."""
    state = CLEAN
    for byte in data:
        state = MACHINE[state][byte]
        if state == WRONG:
            break
    return state


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(self.rank.values()) >= 1 << 20:
            raise ValueError("ids must be below 2**20")
        self.token: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for t, i in self.rank.items():
            self.token[i] = t
        self.size = [len(t) for t in self.token]
        #: whether a token is other than whole UTF-8 sequences
        self.ends = [_runs(t) != CLEAN for t in self.token]
        self.stems = {t[:n] for t in self.rank for n in range(1, len(t))}
        #: the two tokens that a token's last merge joins, as far as looked up; 0 for those not yet, -1 for none, else left + 1
        self._left, self._right = array("i", bytes(4 * len(self.token))), array("i", bytes(4 * len(self.token)))

    def merged(self, data: bytes) -> list[int]:
        """By the definition: the pair of lowest rank merges first, the leftmost of equal ones."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            ranked = [(self.rank.get(a + b), i) for i, (a, b) in enumerate(itertools.pairwise(parts))]
            best = min((x for x in ranked if x[0] is not None), default=None)
            if best is None:
                return [self.rank[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def edges(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; the token twice for a single byte.

        Ranks serve as times, so there are none for a token whose merges don't come by rising rank, or that isn't its
        own encoding.
        """
        left = self._left[token]
        if left == 0:
            a, b = self._last_merge(token)
            self._left[token], self._right[token] = left, _ = a + 1 or -1, b
        return (left - 1, self._right[token]) if left > 0 else None

    def _last_merge(self, token: int) -> tuple[int, int]:
        data, rank = self.token[token], self.rank
        parts, now = [data[i : i + 1] for i in range(len(data))], -1
        if len(parts) == 1:
            return token, token
        while True:
            due, i = min(((rank[x + y], i) for i, (x, y) in enumerate(itertools.pairwise(parts)) if x + y in rank), default=(-1, 0))
            if due < now or due < 0:
                return -2, -2
            if len(parts) == 2:
                return rank[parts[0]], rank[parts[1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            now = due

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge joins tokens a and b, that is, whether they are what their bytes encode to.

        Until a merge crosses their border, both merge as they would alone. So the last part of a meets the first part of
        b for the time both last, and they join if their pair's rank is due before either ends; at one rank what is
        further left goes first. The parts are followed back in time: of the two, what was made later is taken apart.
        """
        if self.edges(a) is None or self.edges(b) is None:
            return self.merged(self.token[a] + self.token[b]) == [a, b]
        rank, token, size, x, y = self.rank, self.token, self.size, a, b
        x_ends = y_ends = math.inf
        while True:
            due = rank.get(token[x] + token[y])
            if due is not None and due < x_ends and due <= y_ends:
                return False
            if size[x] > 1 and (size[y] == 1 or x > y):
                x_ends, x = x, self.edges(x)[1]
            elif size[y] > 1:
                y_ends, y = y, self.edges(y)[0]
            else:
                return True


class Cache:
    """A bounded map: two generations, of which the older goes when the newer is full."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value):
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Transducer:
    """Encodes one piece of text at a time; pieces never merge with each other."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pairs = Cache(MAX_PAIRS)
        #: by a state's number: the bytes since the farthest live position, then of each, the farthest first, how many
        #: bytes it is back and the token that ends there; and the numbers by these
        self.states: dict[int, tuple] = {0: (b"", 0, START)}
        self.number = {self.states[0]: 0}
        #: from where << 8 | byte to the next where; a where is state << 20 | last token, 0 at the start only
        self.next: dict[int, int] = {}
        self.older, self.made = ({}, {}, {}), 1

    def _age(self, state: int) -> None:
        """What wasn't used since the last time is forgotten, but for the start and this state."""
        self.older = self.states, self.number, self.next
        self.states = {s: self.states[s] for s in (0, state)}
        self.number, self.next = {key: s for s, key in self.states.items()}, {}

    def _recall(self, at: int) -> int | None:
        """A transition of the older half, which moves to the newer with the state it leads to."""
        states, _, after = self.older
        found = after.get(at)
        if found is not None:
            self.next[at] = found
            to = found >> 20
            if to not in self.states:
                self.states[to] = key = states[to]
                self.number[key] = to
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether tokens a, b are what their bytes encode to; a may be START."""
        known = self.pairs.get(a << 20 | b)
        if known is None:
            v = self.vocabulary
            known = v.stay_apart(a, b) if a >= 0 else v.edges(b) is not None or v.merged(v.token[b]) == [b]
            self.pairs.put(a << 20 | b, known)
        return known

    def step(self, where: int, byte: int) -> int:
        found = self._recall(where << 8 | byte)
        if found is not None:
            return found
        live = self.states[where >> 20]
        tail = live[0] + BYTES[byte]
        rank, stems, known = self.vocabulary.rank, self.vocabulary.stems, self.pairs.new
        size, on, last, far = len(tail), [], START, 0
        for i in range(1, len(live), 2):
            back = live[i] + 1
            piece = tail[size - back :]
            if last == START:
                t = rank.get(piece)
                if t is not None:
                    token = live[i + 1]
                    ok = known.get(token << 20 | t)
                    if self.follows(token, t) if ok is None else ok:
                        last = t
            if piece in stems:
                far = far or back
                on += (back, live[i + 1])
        key = (tail[size - far :] if far else b"", *on, 0, last)
        to = self.number.get(key)
        if to is None:
            to = self.older[1].get(key)
            if to is None:
                to, self.made = self.made, self.made + 1
            self.number[key] = to
            self.states[to] = key
        self.next[where << 8 | byte] = found = to << 20 | last
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.rank.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES // 2:
            self._age(0)
        out: list[int] = []
        where, seen = 0, []
        for at in range(0, len(piece), EMIT):
            known, step, note = self.next.get, self.step, seen.append
            for byte in piece[at : at + EMIT]:
                where = known(where << 8 | byte) or step(where, byte)
                note(where)
            if at + EMIT < len(piece):
                seen = self._emit(seen, where >> 20, out)
                if len(self.states) > MAX_STATES // 2:
                    self._age(where >> 20)
        return out + self._path(seen, len(seen))

    def _path(self, seen: list[int], at: int) -> list[int]:
        """The tokens of the prefix of so many bytes; seen: where each byte led."""
        path, size = [], self.vocabulary.size
        while at > 0:
            token = seen[at - 1] & 0xFFFFF
            path.append(token)
            at -= size[token]
        path.reverse()
        return path

    def _emit(self, seen: list[int], state: int, out: list[int]) -> list[int]:
        """Emits what all live positions share; what is seen of the bytes after that."""
        paths = [self._path(seen, len(seen) - back) for back in self.states[state][1::2]]
        shared = 0
        for tokens in zip(*paths, strict=False):
            if len(set(tokens)) > 1:
                break
            shared += 1
        out += paths[0][:shared]
        return seen[sum(self.vocabulary.size[t] for t in paths[0][:shared]) :]


def _spaces(pattern: str) -> str:
    """White space as Unicode has it, as the public tokenizer's own regular expressions do."""
    return pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Encoder:
    """Whole texts to ids, by pieces; what a short piece encodes to is remembered, as packed 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.transducer = Transducer(vocabulary)
        self.pieces = regex.compile(_spaces(pattern)).findall
        self.known = Cache(MAX_PIECES)

    def _piece(self, text: str) -> bytes:
        ids = self.known.get(text)
        if ids is None:
            ids = array("i", self.transducer.encode(text.encode())).tobytes()
            if len(text) < 64:
                self.known.put(text, ids)
        return ids

    def packed(self, text: str) -> bytes:
        cache, piece = self.known, self._piece
        return b"".join([cache.new.get(p) or piece(p) for p in self.pieces(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


#: States of the UTF-8 machine: between sequences; one, two, three bytes to come; the second byte after E0, ED, F0, F4.
CLEAN, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, WRONG = range(9)


def _machine() -> list[bytes]:
    """For each state, the next state by the byte: well-formed UTF-8 as the Unicode standard has it (table 3-7)."""
    table = [bytearray([WRONG]) * 256 for _ in range(8)]
    table[CLEAN][0x00:0x80] = bytes([CLEAN]) * 0x80
    table[CLEAN][0xC2:0xE0] = bytes([ONE]) * 0x1E
    table[CLEAN][0xE0:0xF0] = bytes([TWO]) * 0x10
    table[CLEAN][0xF0:0xF5] = bytes([THREE]) * 5
    for first, state in ((0xE0, AFTER_E0), (0xED, AFTER_ED), (0xF0, AFTER_F0), (0xF4, AFTER_F4)):
        table[CLEAN][first] = state
    for state, low, high, to in ((ONE, 0x80, 0xC0, CLEAN), (TWO, 0x80, 0xC0, ONE), (THREE, 0x80, 0xC0, TWO), (AFTER_E0, 0xA0, 0xC0, ONE), (AFTER_ED, 0x80, 0xA0, ONE), (AFTER_F0, 0x90, 0xC0, TWO), (AFTER_F4, 0x80, 0x90, TWO)):
        table[state][low:high] = bytes([to]) * (high - low)
    return [bytes(row) for row in table]


MACHINE = _machine()
REPLACEMENT = "\ufffd".encode()


class StreamingDecoder:
    """Ids to bytes in any portions, which end with a whole sequence. The state is that of the UTF-8 machine and the bytes of
    the open sequence. Bytes that aren't UTF-8 pass as they are, or, where asked, become U+FFFD, one for each longest
    beginning of a sequence, as decoders mostly do."""

    def __init__(self, vocabulary: Vocabulary, replace: bool = False):
        self.token, self.ends = vocabulary.token, vocabulary.ends
        self.replace = replace
        self.state, self.open = CLEAN, b""

    def feed(self, ids) -> bytes:
        if self.state == CLEAN and not any(map(self.ends.__getitem__, ids)):
            return b"".join(map(self.token.__getitem__, ids))  # tokens of whole sequences only
        out = []
        for i in ids:
            if self.state == CLEAN and not self.ends[i]:
                out.append(self.token[i])
                continue
            self._read(self.token[i], out)
        return b"".join(out)

    def _read(self, data: bytes, out: list[bytes]) -> None:
        """One token, byte by byte."""
        state, whole = self.state, bytearray(self.open)
        done = 0  # bytes of whole that are given
        for byte in data:
            to = MACHINE[state][byte]
            if to == WRONG and state != CLEAN:  # what is open ends here, and the byte begins anew
                if self.replace:
                    whole[done:] = REPLACEMENT
                done = len(whole)
                to = MACHINE[CLEAN][byte]
            if to == WRONG:
                whole += REPLACEMENT if self.replace else bytes((byte,))
                to = CLEAN
            else:
                whole.append(byte)
            state = to
            if state == CLEAN:
                done = len(whole)
        out.append(bytes(whole[:done]))
        self.state, self.open = state, bytes(whole[done:])

    def finish(self) -> bytes:
        rest = REPLACEMENT if self.replace and self.open else self.open
        self.state, self.open = CLEAN, b""
        return rest


_OPEN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One of each per Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def encoder(path: str, pattern: str) -> Encoder:
    """A new one for each task: workers outlive their tasks, and what it remembers would stay with every one that ever encoded."""
    return Encoder(vocabulary(path), pattern)


def _decoded(vocabulary: Vocabulary, ids: np.ndarray | list[int], portion: int, replace: bool = False) -> bytes:
    decoder, ids = StreamingDecoder(vocabulary, replace), np.asarray(ids, np.int32)
    return b"".join([*(decoder.feed(ids[i : i + portion].tolist()) for i in range(0, len(ids), portion)), decoder.finish()])


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False, portion: int = 4096, text: bool = True) -> DataFrame:
    """docs with ids array<int>: the whole text's tokens, without special tokens. path: ranks, readable on every worker.

    decoded: also a column decoded binary, the ids turned back to bytes in portions, in the same pass. text: whether the texts
    themselves are passed on. Null and empty texts have
    no tokens (an empty array, no bytes). Bytes of a text that aren't UTF-8 are read as U+FFFD. Rows are encoded one by one, so ties and repeated rows give equal results and
    an empty table an empty one. Columns ids and decoded of docs are replaced; all others pass.
    """
    docs = docs.drop("ids", *["decoded"] * decoded).withColumn("text", F.col("text").cast("string"))
    names = [n for n in docs.columns if text or n != "text"]

    def run(batches):
        to_ids = encoder(path, pattern)
        for batch in batches:
            for rows, _, _ in tb.text_chunks(batch):
                raw = rows.column(rows.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                got = [to_ids.packed((t or b"").decode("utf-8", "replace")) for t in raw]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in got])))
                flat = np.frombuffer(b"".join(got), np.int32)
                out = {n: rows.column(rows.schema.get_field_index(n)) for n in names}
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                if decoded:
                    out["decoded"] = pa.array([_decoded(to_ids.transducer.vocabulary, np.frombuffer(x, np.int32), portion) for x in got], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    more = {"ids": F.lit(None).cast("array<int>")} | ({"decoded": F.lit(None).cast("binary")} if decoded else {})
    return docs.mapInArrow(run, docs.select(*(f"`{n}`" for n in names)).withColumns(more).schema)


def decode(tokens: DataFrame, path: str, pattern: str, portion: int = 4096) -> DataFrame:
    """tokens with decoded string, from ids array<int>, streamed in portions. Null ids give null, no ids an empty text; bytes
    that aren't UTF-8 become U+FFFD. A column decoded is replaced; all others pass."""
    tokens = tokens.drop("decoded")
    names = tokens.columns

    def run(batches):
        known = vocabulary(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            out = [_decoded(known, x.values.to_numpy(zero_copy_only=False), portion, True).decode() if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_pydict({n: batch.column(batch.schema.get_field_index(n)) for n in names} | {"decoded": pa.array(out, pa.string())})

    return tokens.mapInArrow(run, tokens.select("*", F.lit(None).cast("string").alias("decoded")).schema)
