import random
import re

import numpy as np
import pytest

from ledgerspark.llm import near_dup
from ledgerspark.llm import textbytes as tb
from ledgerspark.llm.components import as_edges, converge, labels
from ledgerspark.llm.storage import Scratch


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    w = words(text)
    return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]) and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeé中", k=rnd.randint(1, 7))) for _ in range(400)]
    docs = [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 4, 5, 6, 20, 80, 200]))) for _ in range(n // 2)]
    while len(docs) < n:
        w = rnd.choice(docs).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8, 16])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append(rnd.choice([" ", "\n", " \t"]).join(x.upper() if x.isascii() and rnd.random() < 0.3 else x for x in w))
    rnd.shuffle(docs)
    return list(enumerate(docs))


def run(spark, docs, schema="doc_id long, text string", **more):
    return near_dup.near_duplicates(spark.createDataFrame(docs, schema), **more).collect()


def test_equals_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    got = run(spark, docs)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(docs[r.doc_id][1])) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Edits of one text, many of them below the threshold to most others; tiles of several blocks."""
    monkeypatch.setattr(near_dup, "TILE", 16)
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(250):
        w = list(base)
        for at in rnd.sample(range(120), rnd.choice([0, 1, 2, 3, 4, 5, 6, 7])):
            w[at] = f"x{i}_{at}"
        docs.append((1000 - i, " ".join(w)))
    assert {r.doc_id: r.component_id for r in run(spark, docs)} == brute(docs)


def twins(size=1024):
    """Words that sums of byte values times powers can't tell apart."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_that_linear_hashes_confuse(spark):
    x, y = twins()
    rest = " one two three four five six seven eight"
    docs = [(1, x), (2, y), (3, x + rest), (4, y + rest.replace(" ", f" {x}") * 2), (5, y + rest.replace(" ", f" {y}") * 2), (6, x.upper())]
    assert {r.doc_id: r.component_id for r in run(spark, docs)} == brute(docs) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}


def test_shingles_are_equal_by_their_words_alone(monkeypatch):
    """Even where all digests are the same."""
    monkeypatch.setattr(tb.Phrases, "digests", lambda self, first, last, key: np.zeros((len(first), 2), np.uint64))
    texts = [b"a b c d e", b"a b c d f", b"A b c d e", b"a b", b"b a", b"a b"]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    sets = near_dup.Compared(offsets, np.frombuffer(b"".join(texts), np.uint8), tb.KEY)
    same = {(i, j) for i in range(6) for j in range(6) if sets.similar(i, j, 75)}
    assert same == {(i, i) for i in range(6)} | {(0, 2), (2, 0), (3, 5), (5, 3)}


#: Two pairs of printable words; of each pair the digests have equal second halves and one difference of first halves.
FOUR = ("35KWciPWptR0qPp", "dvPzExwfAnM7fu4", "ZMEkuzhzo_(G!^(", "'/QN{|YL\\#[*Vhl")


def test_words_whose_digests_differ_alike(spark):
    a, b, c, d = FOUR
    rest = "one two three"
    docs = [(1, f"{a} {b} {rest}"), (2, f"{c} {d} {rest}"), (3, f"{a} {d} {rest}"), (4, f"{rest} {c} {b}"), (5, f"{rest} {a} {b}"), (6, f"{a} {b}"), (7, f"{c} {d}"), (8, f"{a} {b} {rest}".upper())]
    for key in (tb.KEY, b"another"):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, docs, key=key)} == {i: (1, c) for i, c in brute(docs).items()}


def test_joins_depend_on_every_half():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, (1000, 2)).astype(np.uint64) for _ in "ab")
    base = tb.join(a, b)
    for x, y in ((b, a), (a[:, ::-1], b), (a, b[:, ::-1]), (np.stack((b[:, 0], a[:, 1]), 1), np.stack((a[:, 0], b[:, 1]), 1)), (np.stack((a[:, 0], b[:, 1]), 1), np.stack((b[:, 0], a[:, 1]), 1)), (a ^ np.uint64(8), b ^ np.uint64(8)), (a, a)):
        assert not (tb.join(x, y) == base).any()
    words = np.frombuffer("".join(FOUR).encode(), np.uint8)
    one = tb.Digests().of(words, np.arange(0, 60, 15), np.arange(15, 75, 15), False)
    assert not (tb.join(one[[0]], one[[1]]) == tb.join(one[[2]], one[[3]])).any()


@pytest.mark.parametrize("lower", [False, True])
def test_phrases_are_named_by_their_words(lower):
    texts = ["a  b\nC é", "", "a b", "\t a b", "ab", "a", "b C", " "]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = tb.words(offsets, data)
    own = [t.split() for t in texts]
    runs = [(int(first[t]) + i, int(first[t]) + j, " ".join(w[i : j + 1])) for t, w in enumerate(own) for i in range(len(w)) for j in range(i, len(w))]
    got = tb.Phrases(data, starts, ends, lower).digests(np.array([r[0] for r in runs]), np.array([r[1] for r in runs]), b"k")
    want = [tb.digest((t.lower() if lower else t).encode(), b"k") for _, _, t in runs]
    assert [x.tobytes() for x in got] == want


def test_nulls_repeats_and_blank_texts(spark):
    text = "one two three four five six seven eight"
    docs = [(3, text, "x"), (3, text, "y"), (5, text.upper(), None), (None, text, None), (7, None, None), (8, "", None), (9, " \n\t\x0b", None), (10, "a b", None), (11, "A\nb", None), (12, "a", None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, docs, "doc_id long, text string, regs string")), key=str)
    want = [(3, 4, 3, True), (3, 4, 3, True), (5, 4, 3, False), (None, 4, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_very_long_text(spark):
    rnd = random.Random(2)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(400_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, [(1, long), (2, long + " tail"), (3, "a" * 3_000_000)])}
    assert got[1][1] == got[2][1] == 1 and got[1][0] == len(shingles(long)) and got[3] == (1, 3)


def test_registers_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]  # similarity 1500 / 2500
    sets = np.concatenate((np.sort(a), np.sort(b)))
    regs = near_dup.registers(sets, np.array([0, 2000, 4000]))
    assert abs((regs[0] == regs[1]).mean() - 0.6) < 0.12
    union = near_dup.registers(np.unique(np.concatenate((a, b))), np.array([0, 2500]))
    assert (union[0] == np.maximum(regs[0], regs[1])).all()  # mergeable


def test_word_digests_depend_on_content_only(monkeypatch):
    texts = ["", "ab  c\nab", "x" * 300_005 + " ab", "", "c\x0bab"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = tb.words(offsets, data)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)] and first.tolist() == [0, 0, 3, 5, 5, 7]
    got = list(map(tuple, tb.Digests().of(data, starts, ends, False).tolist()))
    assert len(set(zip(found, got, strict=True))) == len(set(found)) == len(set(got))
    monkeypatch.setattr(tb, "PART_WORDS", 2)
    assert list(map(tuple, tb.Digests().of(data, starts, ends, False).tolist())) == got


def test_digests_of_words_of_all_sizes():
    words = sorted({w for n in range(1, 40) for w in ("a" * n, "a" * (n - 1) + "b", "é" * n, "A" * n, "a" * (n - 1) + "\0")})
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    starts = ends - [len(r) for r in raw]
    data = np.frombuffer(b"".join(raw), np.uint8)
    got = list(map(tuple, tb.Digests().of(data, starts, ends, False).tolist()))
    assert len(set(got)) == len(words)
    lowered = list(map(tuple, tb.Digests().of(data, starts, ends, True).tolist()))
    assert len(set(lowered)) == len({w.lower() for w in words}) and all(a == b for w, a, b in zip(words, got, lowered, strict=True) if w == w.lower())
    assert not set(got) & set(map(tuple, tb.Digests(b"another key").of(data, starts, ends, False).tolist()))


@pytest.mark.parametrize("n", [2, 40])
def test_components_of_chains_and_stars(spark, n):
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5, 5), (None, 1)]
    scratch = Scratch(spark)
    got = {r.node: r.component for r in labels(converge(scratch.keep(as_edges(spark.createDataFrame(links, "a long, b long"))), scratch)).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, n)}
