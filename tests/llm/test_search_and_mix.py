import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import chat, mixing, topk


def brute_top(rows, k=5):
    """From the contract: every row but the query's own is a candidate."""
    whole = lambda x: math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x)
    vectors = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, a) in enumerate(vectors):
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for r, (c, b) in enumerate(vectors) if r != q)
            out += [(i, rank, c, min(2**63 - 1, max(-(2**63), -s))) for rank, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)]  # ties
    return rows + [(1001, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1101, [float("inf")] * 8), (None, [1.0] * 8), (1102, [0.5] * 3), (1150, []), (3, rows[3][1]), (50, rows[50][1]), (100, [0.1] * 8)]


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "FAN", 4)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(5)
    got = topk.top_k(frame).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows)


@pytest.mark.parametrize("copies", [2, 6, 20])
def test_rows_of_one_id_are_candidates_each(spark, copies):
    rows = [(0, [1.0]), (50, [1.0]), (50, [2.0]), (50, [2.0])] + [(7, [9.0 + i]) for i in range(copies)] + [(i, [float(i)]) for i in range(1, 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows)


@pytest.mark.parametrize("block", [2, 4096])
def test_components_of_any_size(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    sizes = [0.0, 1.0, -1.5, 2.0**20, -(2.0**30), 2.0**45, 2.0**46, -(2.0**46), 1e150, -1e150, 1e300, -1e300, 1.7e308, -1.7e308]
    rows = [(50 * (i % 3) + i % 2, [x, sizes[(5 * i + 3) % len(sizes)], 1.0]) for i, x in enumerate(sizes * 2)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=9).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 9)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).collect() == []
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (2, [-0.001])], schema)).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, -256), (0, 2, 1, -131072)]


def test_scores_beyond_a_long_keep_their_order(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 0.0]), (2, [1e9, 1.0]), (3, [3e38, 0.0]), (4, [-1e9, 0.0]), (5, [-3e38, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 2, 1, 4, 5]
    keys = [topk.more_than_long(s) for s in (-(2**90), -(2**80), -(2**63), 2**63 - 1, 2**64, 2**90)]
    assert keys[:3] == sorted(keys[:3]) and keys[3:] == sorted(keys[3:]) and topk.more_than_long(2**63 - 2) is None


def water(budget, children):
    """children {name: (weight, capacity)} -> budgets, by the rule stated in the module."""
    left, out = dict(sorted(((n, x) for n, x in children.items() if x[0]), key=lambda c: (c[1][1] / c[1][0], c[0]))), {}
    while left:
        name, (w, cap) = next(iter(left.items()))
        total = sum(x[0] for x in left.values())
        if cap * total > budget * w:
            return out | {n: budget * x[0] // total for n, x in left.items()}
        out[name], budget = cap, budget - cap
        del left[name]
    return out


def test_budgets_equal_a_direct_filling(spark):
    rnd = random.Random(2)
    weights = {"domain": {"web": 5, "books": 3, "code": 2, "none": 0}, "lang": {"en": 6, "de": 2}, "source": {"s1": 3, "s9": 0}}
    leaves = {(d, g, s): rnd.choice([0, 1, 10, 500, 5000]) for d in ("web", "books", "code", "none", "new") for g in ("en", "de", "xx") for s in ("s1", "s2", "s9")}
    for percent, epochs in ((10, 1), (60, 4), (150, 2), (1000, 3)):
        w = lambda level, name: weights[level].get(name, 1)
        cap = {k: v * epochs for k, v in leaves.items() if w("domain", k[0]) and w("lang", k[1]) and w("source", k[2])}
        total = lambda *head: sum(v for k, v in cap.items() if k[: len(head)] == head)
        budget = min(sum(leaves.values()) * percent // 100, total())
        want = {}
        for d, b in water(budget, {d: (w("domain", d), total(d)) for d in {k[0] for k in cap}}).items():
            for g, c in water(b, {g: (w("lang", g), total(d, g)) for g in {k[1] for k in cap if k[0] == d}}).items():
                for s, x in water(c, {k[2]: (w("source", k[2]), v) for k, v in cap.items() if k[:2] == (d, g)}).items():
                    want[d, g, s] = x
        frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, available long")
        named = [(level, name, x) for level, names in weights.items() for name, x in names.items()]
        table = spark.createDataFrame(named + [("lang", "en", 4), ("lang", "xx", None), ("other", "de", 9)], "level string, name string, weight int")
        for given in (weights, table):
            got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(frame, given, percent, epochs).collect()}
            assert got == {k: want.get(k, 0) for k in leaves}


def test_budgets_of_large_weights_and_corpora(spark):
    leaves = {f"s{i}": (99_991 + i, 10**13 + 7 * i) for i in range(40)} | {"small": (10**9, 5)}
    frame = spark.createDataFrame([("web", "en", s, n) for s, (_, n) in leaves.items()], "domain string, lang string, source string, available long")
    got = {r.source: r.budget for r in mixing.budgets(frame, {"source": {s: w for s, (w, _) in leaves.items()}}, 60, 4).collect()}
    assert got == water(sum(n for _, n in leaves.values()) * 60 // 100, {s: (w, 4 * n) for s, (w, n) in leaves.items()})


def test_other_levels(spark):
    docs = [(i, "w " * (i % 5), f"h{i % 4}", "en") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, host string, lang string")
    weights = spark.createDataFrame([("host", "h1", 3), ("tld", None, 2)], "level string, name string, weight long")
    one = mixing.mix_sources(frame, weights, percent=50, levels={"host": F.col("host")}).collect()
    assert one[0].__fields__ == ["doc_id", "host", "n_tokens", "whole_epochs", "prefix_tokens"] and len(one) == 200
    cap = {h: 4 * sum(r.n_tokens for r in one if r.host == h) for h in {r.host for r in one}}
    want = water(sum(r.n_tokens for r in one) // 2, {h: (3 if h == "h1" else 1, c) for h, c in cap.items()})
    assert {h: sum(r.n_tokens * r.whole_epochs + r.prefix_tokens for r in one if r.host == h) for h in cap} == want
    four = {"tld": F.lit(None), "host": F.col("host"), "lang": F.col("lang"), "odd": F.col("doc_id") % 2}
    rows = mixing.mix_sources(frame, weights, percent=50, levels=four, steps=1).collect()
    assert {h: sum(r.n_tokens * r.whole_epochs + r.prefix_tokens for r in rows if r.host == h) for h in cap} == want


def test_the_least_budget_gives_each_leaf_an_epoch(spark):
    rnd = random.Random(5)
    for hot in ("src0", "src1", "src2"):
        leaves = {(d, g, s): rnd.randint(0, 900) for d, s in (("web", "src0"), ("books", "src1"), ("code", "src2"), ("web", "src3")) for g in ("en", "de", "xx")}
        leaves |= {k: v + 3000 for k, v in leaves.items() if k[2] == hot}
        frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, available long")
        got = mixing.budgets(frame, mixing.WEIGHTS, None, 4).collect()
        assert len(got) == len(leaves) and all(r.available <= r.budget <= 4 * r.available for r in got)
        total = sum(r.budget for r in got)
        less = mixing.budgets(frame, mixing.WEIGHTS, 100 * total // sum(leaves.values()) - 2, 4).collect()
        assert any(r.budget < r.available for r in less)


def test_prefixes_take_exactly_the_budget_in_hash_order(spark):
    rnd = random.Random(3)
    docs = [(i, " w" * rnd.choice([0, 1, 3, 10]), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "odd", None]), 9) for i in range(500)] + [(7, "a b", "en", "src0", 1), (None, "a b c", "en", "src0", 1), (8, None, "en", "src0", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_tokens int")
    for buckets, steps in ((1, 1), (1, 3), (3, 2), (2, 0)):
        rows = mixing.mix_sources(frame, percent=60, buckets=buckets, steps=steps).collect()
        assert len(rows) == len(docs)
        by = defaultdict(list)
        for r in rows:
            by[r.domain, r.lang, r.source].append(r)
        for leaf in by.values():
            order = sorted(leaf, key=lambda r: (hashlib.md5(f"42:{r.whole_epochs}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), -1 if r.doc_id is None else r.doc_id, r.n_tokens))
            rest = sum(r.prefix_tokens for r in leaf)
            for r in order:
                take = min(r.n_tokens, rest)
                assert r.prefix_tokens == take
                rest -= take
        total = sum(r.n_tokens for r in rows)
        used = sum(r.n_tokens * r.whole_epochs + r.prefix_tokens for r in rows)
        assert total * 60 // 100 - 40 <= used <= total * 60 // 100


def test_mixing_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
    blank = spark.createDataFrame([(1, "", "en", "src0"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.n_tokens, r.whole_epochs, r.prefix_tokens) for r in mixing.mix_sources(blank).collect()] == [(0, 0, 0)] * 2


def test_rotation(spark):
    turns = [
        (1, 0, "system", "be kind", 1), (1, 1, "ann", "hi <|im_end|>", 1), (1, 2, "bob", "é!", 1), (1, 3, "ann", None, 1), (1, 2, "bob", "é!", 2),
        (2, 0, "system", "alone", 1), (3, None, None, "x", 1), (3, 1, "cy", "y", 1), (None, 1, "cy", "z", 1),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part int")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(frame).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown"), (3, "cy"), (None, "cy")}
    r = got[1, "bob"]
    assert r.rendered == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\né!<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    )
    assert [r.rendered[s["from"] : s["to"]] for s in r.spans] == ["é!<|im_end|>"] and r.n_turns == 4
    r = got[1, "ann"]
    assert [r.rendered[s["from"] : s["to"]] for s in r.spans] == ["hi < |im_end|><|im_end|>", "<|im_end|>"] and r.n_target_chars == sum(s["to"] - s["from"] for s in r.spans)
    assert got[3, "unknown"].rendered.startswith("<|im_start|>assistant\nx<|im_end|>")


def test_long_dialogues_are_whole_and_may_come_in_parts(spark):
    n = 1300
    who = F.when(F.col("id") % 7 == 0, "a").when(F.col("id") == 1, "system").when(F.col("id") > 1200, "late").otherwise("bob")
    frame = spark.range(n).select(F.lit(1).alias("conv_id"), F.when(F.col("id") > 3, F.col("id")).alias("turn"), who.alias("role"), F.col("id").cast("string").alias("text"))
    whole = {r.perspective: r for r in chat.rotate(frame).collect()}
    assert set(whole) == {"a", "bob", "late"} and all(r.n_turns == n and r.rendered.count("<|im_start|>") == n for r in whole.values())
    assert [whole["a"].rendered[s["from"] : s["to"]] for s in whole["a"].spans] == [f"{i}<|im_end|>" for i in range(0, n, 7)]
    parts = chat.rotate(frame, part=100).orderBy("part").collect()
    for p, w in whole.items():
        own = [r for r in parts if r.perspective == p]
        assert [r.part for r in own] == list(range(13)) and "".join(r.rendered for r in own) == w.rendered
        assert [r.before for r in own] == [sum(len(x.rendered) for x in own[:i]) for i in range(13)]
        assert [(r.before + s["from"], r.before + s["to"]) for r in own for s in r.spans] == [tuple(s) for s in w.spans]
    assert chat.rotate(frame.limit(0)).collect() == [] and chat.rotate(frame.limit(0), part=10).collect() == []


def test_turns_without_a_dialogue_stand_alone(spark):
    turns = [(None, 1, "a", "x"), (None, 1, "a", "x"), (None, None, "a", "y"), (None, 1, "system", "z"), (2, 1, "a", "x")]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.rendered[-13:-11]) for r in got) == [("2", 1, "\nx"), ("None", 1, "\nx"), ("None", 1, "\ny")]
