"""Mixing sources to target weights: budgets down a tree (of domains, languages and sources, or any levels), prefixes of seeded epochs.

Budgets are filled by integer arithmetic over aggregated leaves. A node's budget goes to its children by weight; a
child that can't use its share (its documents repeated max_epochs times) gives the rest to its siblings, and only what
a whole node can't use goes to the node's own siblings, because a node never gets more than its subtree can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Weights of the registered query. Whatever isn't named has weight 1.
WEIGHTS = {
    "domain": {"web": 5, "books": 3, "code": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 8},
}
BUDGET_PERCENT, MAX_EPOCHS, SEED = 60, 4, 42
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """The domain of a source named src<number>, by the number modulo 3; other for any other name."""
    number = F.regexp_extract(source, "^src([0-9]{1,9})$", 1).try_cast("int")
    return F.when(source.rlike("^src[0-9]{1,9}$"), F.element_at(F.array(*map(F.lit, ("web", "books", "code"))), number % 3 + 1)).otherwise("other")


def default_levels() -> dict[str, Column]:
    """The registered query's tree: domain (by the source's name), lang, source."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"domain": domain_of(source), "lang": F.col("lang"), "source": source}


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a whole text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; what stands before and between words stays."""
    pieces = F.split(text, "(?<=[^ \\t-\\r])(?=[ \\t-\\r])")
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def _weighted(leaves: DataFrame, weights: dict | DataFrame, levels: list[str]) -> DataFrame:
    """leaves with w_<level>, the weight of each level's name: of a dict by level and name, or of a table (level, name, weight).

    What isn't named, or has no weight, has weight 1; of a name that is there twice the larger weight counts.
    """
    if isinstance(weights, dict):
        for level in levels:
            out = F.lit(1)
            for name, w in weights.get(level, {}).items():
                out = F.when(F.col(level) == name, w).otherwise(out)
            leaves = leaves.withColumn(f"w_{level}", out.cast("long"))
        return leaves
    known = weights.groupBy("level", F.coalesce("name", F.lit("")).alias("name")).agg(F.max("weight").cast("long").alias("weight"))
    for level in levels:
        own = known.where(F.col("level") == level).select(F.col("name").alias(level), F.col("weight").alias(f"w_{level}"))
        leaves = leaves.join(own, level, "left").withColumn(f"w_{level}", F.coalesce(f"w_{level}", F.lit(1).cast("long")))
    return leaves


def _fill(children: DataFrame, keys: list[str], name: str) -> DataFrame:
    """children (keys, name, weight, capacity, budget of the parent) with allotted: each its capacity or its share of what is left.

    In the order of capacity per weight, a child is full if its share of what the ones before leave covers its
    capacity; from the first that isn't, all share by weight, rounded down.
    """
    by = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.col("capacity") / F.col("weight"), name)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = children.where("weight > 0").withColumns({"_left": left, "_weights": weights, "_at": F.row_number().over(by)})
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two longs
    full = wide("capacity") * wide("_weights") <= wide("_left") * wide("weight")
    first = F.min(F.when(~full, F.struct("_at", "_left", "_weights"))).over(Window.partitionBy(*(keys or [F.lit(1)])))
    rows = rows.withColumns({"_full": full, "_first": first})
    share = F.expr("(cast(_first._left as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(_first._weights as decimal(19,0))")
    return rows.withColumn("allotted", F.when(F.col("_full"), F.col("capacity")).otherwise(share)).drop("_left", "_weights", "_at", "_full", "_first")


def _least_budget(usable: DataFrame, levels: list[str]) -> DataFrame:
    """One row (wanted): the least budget that gives each leaf one epoch.

    From the leaves up: where children share by weight, the one with the highest need per weight sets the level, and the
    others get as much a weight, up to their capacity. Levels are whole numbers, so that no share is rounded.
    """
    rows = usable.withColumn("need", F.col("available"))
    for depth in reversed(range(len(levels))):
        above = levels[:depth]
        rows = rows.withColumn("weight", F.col(f"w_{levels[depth]}"))
        level = F.max(F.expr("(need + weight - 1) div weight")).over(Window.partitionBy(*(above or [F.lit(1)])))
        need = F.sum(F.least("capacity", F.col("_level") * F.col("weight")))
        rows = rows.withColumn("_level", level).groupBy(*above, *(f"w_{x}" for x in above)).agg(need.alias("need"), F.sum("capacity").alias("capacity"))
    return rows.select(F.col("need").cast("long").alias("wanted"))


def budgets(leaves: DataFrame, weights: dict | DataFrame, percent: int | None, max_epochs: int, levels: list[str] = LEAF) -> DataFrame:
    """leaves (levels, available) with budget in tokens, of percent of all available tokens; without percent, of the least
    that gives each usable leaf one epoch."""
    leaves = _weighted(leaves, weights, levels).withColumn("capacity", F.col("available") * max_epochs)
    usable = leaves.where(" and ".join(f"w_{level} > 0" for level in levels))
    nodes = [usable]  # of each depth, the leaves' last
    for depth in reversed(range(1, len(levels))):
        up = levels[:depth]
        nodes.insert(0, nodes[0].groupBy(*up, *(f"w_{x}" for x in up)).agg(F.sum("capacity").alias("capacity")))
    total = _least_budget(usable, levels) if percent is None else leaves.agg(F.expr(f"(sum(available) * {percent}) div 100").cast("long").alias("wanted"))
    filled = total.join(nodes[0].agg(F.sum("capacity").alias("capacity"))).select(F.least("wanted", "capacity").alias("budget"))
    for depth, level in enumerate(levels):
        above = levels[:depth]
        children = nodes[depth].withColumn("weight", F.col(f"w_{level}"))
        children = children.join(filled, above) if above else children.join(filled)
        filled = _fill(children, above, level).select(*above, level, F.col("allotted").alias("budget"))
    return leaves.select(*levels, "available").join(filled, levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def mix_sources(
    docs: DataFrame,
    weights: dict | DataFrame = WEIGHTS,
    percent: int | None = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    levels: dict[str, Column] | None = None,
    buckets: int = 3,
    steps: int = 2,
    carry: list[str] | None = None,
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, the levels (domain, lang, source), n_tokens, whole_epochs, prefix_tokens, one row each.

    The tree's levels are expressions over docs from the root down, default_levels() unless given; tokens are words.
    Weights are a dict by level and name, or a table (level, name, weight). The budget is percent of all tokens, at most
    what max_epochs epochs of the usable leaves hold; without percent, the least that gives each usable leaf one epoch.
    A leaf's epochs are its documents in the order of md5(seed:epoch:doc_id), then doc_id; it takes whole_epochs of them and,
    of the next, the first tokens up to its budget: prefix_tokens of the row, less than n_tokens where the budget ends
    inside it. A leaf's rows so give exactly its budget. Rounding leaves at most one token per child unused. Null names (lang,
    source) are the empty name; null and empty texts have no tokens and are taken with whole epochs only; rows that share a
    doc_id are told apart by n_tokens, and equal ones share the prefix in any order; a null doc_id sorts as an empty one.
    Nodes of weight 0 get nothing. carry: columns of docs to pass on, unchanged, as the struct carried. An empty table gives
    an empty result.

    A leaf's prefix is found without sorting the leaf: sums over 16**buckets ranges of the hash find the range in which the
    budget ends, the next step looks only into that range, and after the last the rows of one range of 16**(buckets * steps)
    are put in order.
    """
    scratch = Scratch(docs.sparkSession)
    tree = default_levels() if levels is None else levels
    levels = list(tree)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.coalesce(value.cast("string"), F.lit("")).alias(name) for name, value in tree.items()),
        word_count(F.col("text").cast("string")).alias("n_tokens"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    rows = scratch.keep(rows)
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("available"))
    plan = budgets(leaves, weights, percent, max_epochs, levels)
    some = F.col("available") > 0
    plan = plan.select(
        *levels,
        F.when(some, F.expr("budget div nullif(available, 0)")).otherwise(0).cast("long").alias("whole_epochs"),
        F.when(some, F.expr("budget % nullif(available, 0)")).otherwise(0).cast("long").alias("rest"),
    )
    plan = scratch.keep(plan)
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = rows.join(plan, levels).withColumn("_key", hashed)
    if not carry:  # texts aren't written again
        dealt = scratch.keep(dealt)

    ends = scratch.keep(plan.where("rest > 0").select(*levels, F.lit("").alias("_end"), F.lit(0).cast("long").alias("_before")))
    for step in range(1, steps + 1):
        inside = F.expr(f"substring(_key, 1, {buckets * (step - 1)})") == F.col("_end")
        part = dealt.join(ends, levels).where(inside).withColumn("_range", F.substring("_key", 1, buckets * step))
        sums = part.groupBy(*levels, "_range", "rest", "_before").agg(F.sum("n_tokens").alias("n"))
        sooner = Window.partitionBy(*levels).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.col("_before") + F.coalesce(F.sum("n").over(sooner), F.lit(0)))
        ends = scratch.keep(sums.where("_before < rest and _before + n >= rest").select(*levels, F.col("_range").alias("_end"), "_before"))
    placed = dealt.withColumn("_range", F.substring("_key", 1, buckets * steps)).join(ends, levels, "left")
    inside = F.col("_range") == F.col("_end")
    clear = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("prefix_tokens", F.when(F.col("_range") < F.col("_end"), F.col("n_tokens")).otherwise(0))
    order = Window.partitionBy(*levels).orderBy("_key", F.col("doc_id").asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    cut = placed.where(inside).withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - at)))
    columns = ["doc_id", *levels, "n_tokens", "whole_epochs", F.col("prefix_tokens").cast("long").alias("prefix_tokens"), *(["carried"] if carry else [])]
    out = clear.select(*columns).unionByName(cut.select(*columns))
    return scratch.leave(out) if carry else scratch.finish(out)
