"""How filters of a corpus interact: what each removes, at every place of every order in which they can be applied.

Conditions are evaluated once per document and packed into a mask; documents are counted by part and mask, so that
at most 2**k cells of a part are left for k filters. The orders are walked by single swaps of neighbours
(Steinhaus-Johnson-Trotter): a swap changes what the two steps remove and nothing else, so only these are summed
anew from the cells. Shapley sums grow along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders grow as the factorial of the filters; each part has that many rows times the filters.
MAX_FILTERS = 8
SPACE = " \t\n\x0b\x0c\r"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words(text: Column) -> Column:
    """Maximal runs `[^\\x20\\x09-\\x0D]+` as an array; null where there are none."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner != "", F.split(inner, "[\\x20\\x09-\\x0D]+"))


def standard(text: Column) -> dict[str, Column]:
    """Failure conditions by filter: few words, few distinct words, many capitals, symbols."""
    found = words(text)
    n, distinct = F.coalesce(F.size(found), F.lit(0)).cast("long"), F.coalesce(F.size(F.array_distinct(found)), F.lit(0)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": F.when(found.isNull(), True).otherwise(n < 100),
        "B": F.when(found.isNull(), False).otherwise(100 * distinct < 80 * n),
        "C": 100 * capitals > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None, part: Column) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, of these those of good
    quality and the toxic ones. Bit i of the mask is filter i; that of `copies` is the last."""
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask")]
    slim = docs.select(*columns, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marks = marks.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = slim.join(marks.hint("merge"), slim["doc_id"] == F.col("_id"), "left")
    marked = marked.select("part", "mask", "digest", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), F.struct("doc_id").alias("place"))
    by = ["part", "mask", "good", "toxic"]
    if copies is None:
        counted = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    else:
        # Rows of one document, then one row for each text in a part: its rows, and those at its smallest doc_id.
        rows = marked.groupBy(*by, "digest", "place").agg(F.count(F.lit(1)).alias("n"))
        ided = F.when(F.col("place.doc_id").isNotNull(), F.struct("place.doc_id", "n"))
        texts = rows.groupBy(*by, "digest").agg(F.sum("n").alias("n"), F.min(ided).alias("first"), F.sum(F.when(F.col("place.doc_id").isNull(), F.col("n")).otherwise(0)).alias("lone"))
        texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
        passes = F.col("lone") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
        two = F.array(F.struct(F.col("mask").alias("mask"), passes.alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - passes).alias("n")))
        counted = texts.select("part", "good", "toxic", F.explode(two).alias("x")).select("part", "good", "toxic", "x.*")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def orders(k: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of 0 to k - 1, each by one swap of neighbours from the one before, with the place of that swap."""
    order, left = list(range(k)), [True] * k
    yield order, None
    while True:
        for x in reversed(range(k)):  # the largest that can move towards a smaller one
            at = order.index(x)
            to = at - 1 if left[x] else at + 1
            if 0 <= to < k and order[to] < x:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        left[x + 1 :] = [not way for way in left[x + 1 :]]
        yield order, min(at, to)


def walk(names: str, masks: np.ndarray, counts: np.ndarray) -> dict[str, list]:
    """Rows of one part from its cells: masks, and counts (n, good, toxic) of each."""
    k = len(names)
    total = counts.sum(axis=0)
    fails = [counts[(masks >> f) & 1 == 1, 0].sum() for f in range(k)]
    alone = [counts[masks == 1 << f, 0].sum() for f in range(k)]
    gone = np.zeros((k, 3), np.int64)  # by step
    shapley = np.zeros(k, np.int64)
    out = {c.split(" ")[0]: [] for c in OUT.split(", ")[1:]}
    for order, swap in orders(k):
        for i in range(k) if swap is None else (swap, swap + 1):
            before = sum(1 << f for f in order[:i])
            gone[i] = counts[masks & (before | 1 << order[i]) == 1 << order[i]].sum(axis=0)
        shapley[order] += gone[:, 0]
        kept = total[0] - np.cumsum(gone[:, 0])
        out["filter_order"] += ["".join(names[f] for f in order)] * k
        out["step"] += range(1, k + 1)
        out["kept"] += kept.tolist()
        out["removed"] += gone[:, 0].tolist()
        out["redundant"] += [fails[f] - gone[i, 0] for i, f in enumerate(order)]
        out["unique_fails"] += [alone[f] for f in order]
        out["good_lost"] += gone[:, 1].tolist()
        out["toxic_lost"] += gone[:, 2].tolist()
        out["shapley"] += order
    out["shapley"] = shapley[out["shapley"]].tolist()
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", part: Column | None = None) -> DataFrame:
    """docs (doc_id, text, lang, ...), labels (doc_id, quality, toxic) -> one row for each part, order and step.

    filters gives conditions on which a document fails, by a name of one character (by default those of standard());
    a null condition doesn't fail. copies names a last filter, failed by documents with the text of any smaller
    doc_id of the whole table; None leaves it out. part is lang by default; null counts as an empty string.

    part, filter_order, step from 1, and of the part: kept after the step, removed by it, redundant (failing its
    filter, removed before), unique_fails (failing no other filter), good_lost and toxic_lost (of the removed ones, those
    with any label quality = 1, toxic = 1), shapley (removed by its filter, summed over all orders). Zeros are given too.

    A null text counts as empty. Each repeated row counts as a document; rows of the smallest doc_id of a text aren't
    copies of each other, and rows without a doc_id are copies of none and have no labels. Labels may be repeated or
    null. An empty table gives no rows. Other columns don't matter.
    """
    filters = standard(F.coalesce(F.col("text").cast("string"), F.lit(""))) if filters is None else filters
    names = "".join(filters) + (copies or "")
    if not names or len(names) != len(filters) + bool(copies) or len(set(names)) != len(names) or len(names) > MAX_FILTERS:
        raise ValueError(f"filters need 1 to {MAX_FILTERS} different names of one character: {names!r}")

    def walked(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:  # 2**k rows at most
        return pd.DataFrame({"part": key[0]} | walk(names, cell["mask"].to_numpy(), cell[["n", "good", "toxic"]].to_numpy()))

    return cells(docs, labels, filters, copies, F.col("lang") if part is None else part).groupBy("part").applyInPandas(walked, OUT)
