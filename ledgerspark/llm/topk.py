"""Exact top-k search by tiles: blocks of queries times blocks of candidates, the best of each tile, then a tree of merges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

K, SCALE, DIVISOR = 5, 256, 50
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Tiles whose lists meet in one step of the merge tree.
FAN = 64
#: Tiles in a task, and tasks, at most.
TASK_TILES, TASKS = 64, 16_384


#: A score that a long can't hold is given as the nearest long; `more` then orders such scores, as text.
LEAST, MOST = -(2**63), 2**63 - 1


def more_than_long(score: int) -> str | None:
    """None for what a long holds with room to spare; else text that sorts as the scores do."""
    if LEAST < score < MOST:
        return None
    digits = f"{abs(score):x}"
    key = f"{len(digits):04x}{digits}"
    return key if score > 0 else key.translate(str.maketrans("0123456789abcdef", "fedcba9876543210"))


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v array<double>) of the vectors that take part: not null, with finite components only."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    real = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(real).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def _blocks(size: int):
    """Rows (row, vec_id, v) as blocks: rows, ids, dimension, values, in ascending order of ids."""

    def pack(rows):
        keys, ids = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        wide = max(r[2].shape[1] for r in rows)
        values = np.concatenate([np.pad(r[2], ((0, 0), (0, wide - r[2].shape[1]))) for r in rows])
        order = np.lexsort((keys, ids))
        for at in range(0, len(ids), size):
            part = order[at : at + size]
            out = {n: pa.array([x[part].tobytes()], pa.binary()) for n, x in (("rows", keys), ("ids", ids), ("data", values))}
            yield pa.RecordBatch.from_pydict({"rows": out["rows"], "ids": out["ids"], "wide": pa.array([wide], pa.int64()), "data": out["data"]})

    def run(batches):
        rows, have = [], 0
        for batch in batches:
            keys, ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            wide = int(sizes.max(initial=0))
            values = np.zeros((len(ids), wide), np.float64)
            values[np.arange(wide) < sizes[:, None]] = flat
            rows.append((keys, ids, values))
            have += len(ids)
            if have >= size:
                yield from pack(rows)
                rows, have = [], 0
        if have:
            yield from pack(rows)

    return run


def products(a: np.ndarray, b: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of the rows of a and b, of floor(scale * x), exactly: in doubles or longs where these hold every
    partial sum, in integers without bound for the rows that need it."""
    with np.errstate(over="ignore"):
        a_, b_ = np.floor(a * scale), np.floor(b * scale)
        top_a, top_b = (np.abs(x).max(axis=1, initial=0) for x in (a_, b_))
        wide = max(1, a.shape[1])
        if wide * top_a.max(initial=0) * top_b.max(initial=0) < 2.0**53:
            return (a_ @ b_.T).astype(np.int64)
        out = np.empty((len(a), len(b)), object)
        for limit, kind in ((2.0**53, np.float64), (2.0**62, np.int64), (np.inf, object)):
            # of each query those candidates that fit now and didn't before
            for r in range(len(a)):
                need = wide * top_a[r] * top_b
                go = np.flatnonzero((need < limit) if kind is np.float64 else (need >= 2.0**53) & (need < limit) if kind is np.int64 else ~(need < 2.0**62))
                if not len(go):
                    continue
                if kind is object:
                    exact = lambda x: np.array([_whole(e, scale) for e in x.ravel().tolist()], object).reshape(x.shape)
                    out[r, go] = exact(b[go]) @ exact(a[r]) if a.shape[1] else 0
                else:
                    out[r, go] = [int(x) for x in (b_[go].astype(kind) @ a_[r].astype(kind)).tolist()]
    return out


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) for any finite double, of the product as a double where it is finite."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def _tile(k: int, scale: int):
    def unpack(rows, ids, wide, data):
        ids = np.frombuffer(ids, np.int64)
        return np.frombuffer(rows, np.int64), ids, np.frombuffer(data, np.float64).reshape(len(ids), wide)

    def best(scores: np.ndarray, cand: np.ndarray, own: np.ndarray):
        """Places of the k highest of each row, without the query's own row; ties to the smaller id, as candidates ascend."""
        for r in range(len(own)):
            use = np.flatnonzero(cand != own[r])
            s = scores[r][use]
            if len(use) > k and s.dtype != object:
                least = np.partition(s, len(use) - k)[len(use) - k]
                above = np.flatnonzero(s > least)
                at = np.concatenate((above, np.flatnonzero(s == least)[: k - len(above)]))
            else:
                at = np.array(sorted(range(len(use)), key=lambda i: (-s[i], i))[:k], np.int64)
            yield from ((r, int(c), int(x)) for c, x in zip(use[at], s[at], strict=True))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tile, *q = (batch.column(i)[at].as_py() for i in range(5))
                c = [batch.column(i)[at].as_py() for i in range(5, 9)]
                (own, q_ids, a), (cand, c_ids, b) = unpack(*q), unpack(*c)
                wide = min(a.shape[1], b.shape[1])
                out = list(best(products(a[:, :wide], b[:, :wide], scale), cand, own))
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array([own[r] for r, _, _ in out], pa.int64()),
                    "query_id": pa.array([q_ids[r] for r, _, _ in out], pa.int64()),
                    "tile": pa.array([tile] * len(out), pa.int64()),
                    "row": pa.array([cand[i] for _, i, _ in out], pa.int64()),
                    "vec_id": pa.array([c_ids[i] for _, i, _ in out], pa.int64()),
                    "score": pa.array([min(MOST, max(LEAST, s)) for _, _, s in out], pa.int64()),
                    "more": pa.array([more_than_long(s) for _, _, s in out], pa.string()),
                })

    return run


def grid(queries: int, candidates: int) -> tuple[int, int]:
    """(groups of candidate blocks, slots of query blocks) so that a task has a bounded number of tiles.

    Query blocks are copied to each group and candidate blocks to each slot; for a number of tasks, their copies are
    fewest where groups to slots is as candidates to queries.
    """
    tiles = max(1, queries * candidates)
    tasks = min(TASKS, tiles, max(64, tiles // TASK_TILES))
    slots = min(max(1, queries), max(1, round((tasks * queries / max(1, candidates)) ** 0.5)))
    return max(1, min(max(8, candidates), tasks // slots)), slots


def top_k(vectors: DataFrame, divisor: int = DIVISOR, k: int = K, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank (from 1), vec_id, score: the k best candidates of each query.

    Queries are the rows whose vec_id is divisible by divisor; candidates are every row but the query's own. The score is the
    integer inner product of the components as floor(scale * x), exact at any size, ties to the smaller vec_id; one that
    a long can't hold is ranked exactly and given as the nearest long. Vectors that are null or hold a null or non-finite
    component take no part; a shorter vector counts as filled up with zeros. Rows that repeat a vec_id are candidates
    each, and queries each: such queries give as many lists of one query_id. With fewer candidates all are
    returned; an empty table gives an empty result. Other columns don't matter.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.keep(usable(vectors))
    schema = "rows binary, ids binary, wide long, data binary"
    # Candidates stay where they are: a block is made of rows of one task.
    cand = rows.mapInArrow(_blocks(CANDIDATE_BLOCK), schema)
    cand = scratch.keep(cand.select(F.monotonically_increasing_id().alias("tile"), "*"))
    query = rows.where(F.col("vec_id") % divisor == 0).repartition("row").mapInArrow(_blocks(QUERY_BLOCK), schema)
    query = scratch.keep(query.select(F.monotonically_increasing_id().alias("q_tile"), *(F.col(c).alias(f"q_{c}") for c in query.columns)))
    tiles = cand.count()
    groups, slots = grid(query.count(), tiles)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    query = query.withColumn("slot", F.pmod(F.xxhash64("q_tile"), F.lit(slots))).withColumn("group", every(groups))
    held = cand.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups))).withColumn("slot", every(slots))
    pairs = query.join(held, ["group", "slot"]).select("tile", "q_rows", "q_ids", "q_wide", "q_data", "rows", "ids", "wide", "data")
    lists = scratch.keep(pairs.mapInArrow(_tile(k, scale), "query long, query_id long, tile long, row long, vec_id long, score long, more string"))

    order = [F.desc("score"), F.desc("more"), F.asc("vec_id"), F.asc("row")]
    lists = lists.withColumn("tile", F.pmod(F.xxhash64("tile"), F.lit(max(1, tiles))))
    while tiles > 1:
        tiles = -(-tiles // FAN)
        rank = F.row_number().over(Window.partitionBy("query", "tile").orderBy(*order))
        lists = lists.withColumn("tile", F.pmod("tile", F.lit(tiles))).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return scratch.finish(ranked.select("query_id", "rank", "vec_id", "score"))
