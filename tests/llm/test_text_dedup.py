import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from test_near_dup import FOUR, twins  # noqa: E402

from ledgerspark.llm import bloom, line_dedup, substring_dedup  # noqa: E402
from ledgerspark.llm import textbytes as tb  # noqa: E402
from ledgerspark.llm.storage import Scratch  # noqa: E402


def line_key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))


def brute_lines(docs):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(line_key(line)) >= 40:
                holders[line_key(line)].add(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(line_key(x), i) == i and (i is not None or line_key(x) not in keeper)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_corpus():
    rnd = random.Random(4)
    shared = ["This line is shared by many of them, number %d é中" % i for i in range(12)]
    docs = []
    for i in range(80):
        lines = [rnd.choice(["  ", "", "\t"]) + rnd.choice([x, x.upper(), x.title()]) + rnd.choice(["", " \r", "\x0b"]) for x in rnd.sample(shared, rnd.randint(0, 6))]
        lines += ["own line %d of document that is long enough to count %d" % (k, i) for k in range(rnd.randint(0, 3))] + [""] * rnd.randint(0, 2) + ["short"] * 2
        rnd.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    forty, less = "é" * 40, "é" * 39
    docs += [(100 + i, f"{forty}\n{less}\n{forty}") for i in range(5)] + [(200 + i, "x" * 41) for i in range(4)]
    return docs + [(300, None), (301, ""), (302, "\n\n"), (None, forty), (100, forty + "\nmore"), (None, None)]


@pytest.mark.parametrize("max_keys", [0, 1 << 19])
def test_lines_equal_brute_force(spark, max_keys):
    docs = lines_corpus()
    rows = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, n_lines int, __drop int, other string")
    got = line_dedup.drop_repeated_lines(rows, max_keys=max_keys)
    assert got.columns == ["doc_id", "text", "__drop", "other", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute_lines(docs)


@pytest.mark.parametrize("max_keys", [0, 1 << 19])
def test_lines_that_linear_hashes_confuse(spark, max_keys):
    x, y = twins()
    docs = [(i, f"{x}\n{y}" if i == 3 else x) for i in range(7)] + [(9, y.upper()), (None, f"{y}\n{x}")]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), max_keys=max_keys)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute_lines(docs)


def test_keys_that_share_half_a_digest():
    rows = np.array([[1, 5, 70], [1, 2, 71], [3, 1, 72]], np.int64)
    keepers = line_dedup.Keepers([rows[:2].tobytes(), rows[2:].tobytes()])
    found, keeper = keepers.keeper(np.array([[1, 2], [1, 5], [1, 9], [2, 2], [3, 1], [4, 1]], np.int64).view(np.uint64))
    assert found.tolist() == [True, True, False, False, True, False] and keeper[found].tolist() == [71, 70, 72]


@pytest.mark.parametrize("max_keys", [0, 1 << 19])
def test_lines_with_saturated_filters(spark, max_keys):
    docs = lines_corpus()
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), max_filter_bits=1 << 10, max_keys=max_keys)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute_lines(docs)


def test_lines_of_an_empty_table_and_of_a_long_text(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "\n".join("line number %09d of a very long text, repeated" % (i % 50_000) for i in range(100_000))
    got = line_dedup.drop_repeated_lines(spark.createDataFrame([(i, long) for i in range(5)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in got} == {(i, 100_000, 100_000) for i in range(4)} | {(4, 100_000, 0)}


def brute_repeats(docs, window):
    found, texts = defaultdict(list), [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    place = lambda i: float("inf") if i is None else i  # noqa: E731 - rows without an id come last
    for i, w in texts:
        for s in range(len(w) - window + 1):
            found[tuple(w[s : s + window])].append((place(i), s))
    earliest = {k: min(v) for k, v in found.items()}
    out = []
    for i, w in texts:
        covered = {s + k for s in range(len(w) - window + 1) if (place(i), s) > earliest[tuple(w[s : s + window])] for k in range(window)}
        out.append((i, len(w), len(covered), " ".join(x for k, x in enumerate(w) if k not in covered)))
    return sorted(out, key=str)


def passages(seed, window=20):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "A", "é", "中文", "word", "the", "of"] + [f"v{i}" for i in range(60)]
    shared = [rnd.choices(vocabulary, k=rnd.randint(window - 2, 3 * window)) for _ in range(6)] + [["a"] * (2 * window), ["a", "b"] * window, ["the"] * window]
    docs = []
    for i in range(60):
        w = rnd.choices(vocabulary, k=rnd.randint(0, 50))
        for p in rnd.sample(shared, rnd.randint(0, 3)):
            w += p[rnd.randint(0, 3) : len(p) - rnd.randint(0, 3)] + rnd.choices(vocabulary, k=rnd.randint(0, 5))
        docs.append((rnd.randint(-5, 40), rnd.choice([" ", "\n", "  "]).join(w)))
    return docs + [(50, None), (51, ""), (None, " ".join(shared[0])), (None, " ".join(shared[0])), (52, " \n")]


@pytest.mark.parametrize("seed", range(4))
def test_passages_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(tb, "CHUNK_BYTES", 3000)  # several chunks in a task
    docs = passages(seed)
    rows = spark.createDataFrame([(i, t, b"x") for i, t in docs], "doc_id long, text string, data binary").repartition(3)
    got = substring_dedup.remove_repeats(rows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_repeats(docs, 20)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 20, 50])
def test_other_windows(spark, window):
    docs = [(i, t) for i, (_, t) in enumerate(passages(9, window))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_repeats(docs, window)


def chunk_of(texts, window):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    return substring_dedup.Chunk(offsets, np.frombuffer(b"".join(raw), np.uint8), window, tb.Digests())


def test_windows_around_a_frequent_phrase_spread_over_shards():
    rnd = random.Random(3)
    phrase = " ".join(f"p{k}" for k in range(8))
    chunk = chunk_of([" ".join(f"w{rnd.random()}" for _ in range(6)) + f" {phrase} " + " ".join(f"w{rnd.random()}" for _ in range(6)) for _ in range(3000)], 20)
    most = np.bincount(substring_dedup._shard(chunk.keys(), 64), minlength=64).max()
    assert len(chunk.at) == 3000 and most < 2 * len(chunk.at) / 64


def test_passages_of_an_empty_table_and_of_long_texts(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rnd = random.Random(1)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(300_000))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame([(2, long), (1, "start " + long), (3, "z " * 100_000)], "doc_id long, text string")).collect()}
    assert got == {1: (300_001, 0), 2: (300_000, 300_000), 3: (100_000, 99_999)}


@pytest.mark.parametrize("window", [2, 8, 20, 33, 50])
def test_interiors_and_keys_are_decided_by_a_windows_own_words(window):
    rnd = random.Random(window)
    for kinds in (1, 2, 3, 1000):
        bodies = [" ".join(str(rnd.randrange(kinds)) for _ in range(window)) for _ in range(20)]
        around = lambda: " ".join(str(rnd.randrange(kinds)) for _ in range(rnd.randint(0, 30)))
        chunk = chunk_of([f"{around()} {rnd.choice(bodies)} {around()}" for _ in range(200)], window)
        deepest = chunk.held[1].copy()
        for _ in range(substring_dedup.rounds_for(window)):
            chunk.compress()
            assert (chunk.hi >= chunk.lo).all()
        words, key = list(map(tuple, chunk.words.tolist())), list(map(tuple, chunk.keys().tolist()))
        own = {}
        for at, k in zip(chunk.at.tolist(), key, strict=True):
            own.setdefault(tuple(words[at : at + window]), set()).add(k)
        assert all(len(k) == 1 for k in own.values()) and len({k for v in own.values() for k in v}) == len(own)
        assert kinds < 1000 or window < 20 or (chunk.held[1] < deepest).mean() > 0.9  # interiors have grown into fewer symbols


def test_a_round_names_runs_then_pairs():
    names = np.repeat(np.array([[7, 8], [9, 10], [7, 8], [5, 1]], np.uint64), [3, 1, 3, 1], axis=0)
    level = substring_dedup.Level(names, np.arange(8), np.array([0, 4, 8]))
    runs = level.runs()
    assert runs.at.tolist() == [0, 3, 4, 7] and runs.first.tolist() == [0, 2, 4] and level.number.tolist() == [0, 0, 0, 1, 2, 2, 2, 3]
    assert (runs.names[0] == runs.names[2]).all() and (runs.names[1] == [9, 10]).all() and (runs.names[0] != [7, 8]).any()
    pairs = runs.pairs(np.array([False, True, True, True]))
    assert pairs.at.tolist() == [0, 4, 7] and pairs.first.tolist() == [0, 1, 3]
    assert runs.pairs(np.array([True, False, True, False])).at.tolist() == [0, 3, 4, 7]  # not across texts


def test_words_whose_digests_differ_alike(spark):
    a, b, c, d = FOUR
    rest = [f"w{i}" for i in range(18)]
    docs = [(81 + k, " ".join([*rest[:at], x, y, *rest[at:], f"own{k}"])) for k, (x, y, at) in enumerate([(a, b, 7), (c, d, 7), (a, d, 7), (c, d, 2), (a, b, 2), (c, b, 7), (a, b, 7)])]
    for key in (tb.KEY, b"another"):
        got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), key=key).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_repeats(docs, 20)


def test_equal_names_remove_nothing(monkeypatch):
    """Even where all symbols share a name, windows are equal only where their words are."""
    monkeypatch.setattr(tb, "join", lambda a, b: np.zeros_like(a))
    texts = ["a b c d e f", "a b c d e g", "x a b c d e f"]
    chunk = chunk_of(texts, 5)
    for _ in range(2):
        chunk.compress()
    records = np.zeros(len(chunk.at), substring_dedup.RECORD)
    records["h1"], records["h2"] = chunk.digests().T
    records["doc"] = np.searchsorted(chunk.first, chunk.at, "right") - 1
    records["start"] = chunk.at - chunk.first[records["doc"]]
    late = records[substring_dedup._later(records)[1]]
    assert sorted(zip(late["doc"].tolist(), late["start"].tolist(), strict=True)) == [(1, 0), (2, 1), (2, 2)]


def test_a_shard_is_folded_and_records_are_combined(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COMBINE_RECORDS", 50)
    monkeypatch.setattr(substring_dedup, "FOLD_BYTES", 400)
    docs = passages(4)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = substring_dedup.remove_repeats(rows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_repeats(docs, 20)


def test_passages_with_words_that_linear_hashes_confuse(spark):
    x, y = twins()
    rest = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"z {x} {rest}"), (4, f"{y} " * 20), (5, f"{x} " * 20)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_repeats(docs, 20)


def test_rows_that_share_a_doc_id_lose_only_their_own_windows(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = [(1, a), (7, f"x {a}"), (7, f"x {b}"), (None, b), (None, f"y {a}"), (2**63 - 1, b), (7, f"x {b}")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(1, 30, 0), (7, 31, 30), (7, 31, 0), (7, 31, 0), (None, 30, 30), (None, 31, 30), (2**63 - 1, 30, 30)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=str) == sorted(want, key=str)


def test_filters_hold_what_was_put_in(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63, 30_000)
    frame = spark.createDataFrame([(int(k), False) for k in keys[:20_000]] + [(int(k), False) for k in keys[:5_000]] + [(int(k), True) for k in keys[5_000:6_000]], "key long, again boolean")
    for bits in (1 << 24, 1 << 16):
        held = bloom.Filter(*bloom.filter_of(frame, 20_000, bits))
        assert held.holds(keys[:20_000].view(np.uint64)).all()
        twice = bloom.Filter(*bloom.twice_seen(frame, 20_000, bits))
        assert twice.holds(keys[:6_000].view(np.uint64)).all()
    sharp = bloom.Filter(*bloom.twice_seen(frame, 20_000, 1 << 24))
    assert sharp.holds(keys[6_000:].view(np.uint64)).mean() < 0.05


def test_scratch_goes(spark):
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(3))
    done = scratch.finish(kept.where("id > 0"))
    assert done.count() == 2 and scratch.paths == []
