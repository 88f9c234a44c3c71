"""Quality rules: statistics of whole texts, and a decision list of threshold conjunctions learned from labels.

The list is grown by sequential covering: a rule takes up the condition of the highest information gain until it covers
no good text, is pruned on texts it hasn't seen, and what it covers is set aside before the next rule. The rules are
emitted as one ordered conditional expression; statistics and verdict are built-in expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Labelled rows that are read at most for learning; rules and conditions in a rule at most; a rule's least precision on unseen rows.
TRAIN_ROWS, MAX_RULES, MAX_CONDITIONS, LEAST_PRECISION = 20_000, 12, 4, 0.9
#: What rules may compare, made of the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_text_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}

_WORDS = "array_remove(split(__text, '[ \\\\t-\\\\r]+'), '')"
_LINES = "filter(split(__text, '\\\\n'), l -> l rlike '[^ \\\\t-\\\\r]')"
_WINDOWS = f"if(n_words > {WINDOW}, transform(sequence(1, n_words - {WINDOW - 1}), i -> xxhash64(slice(__words, cast(i as int), {WINDOW}))), array())"
#: Where no two windows share a hash, none repeat. Else windows by their words, sorted with their places; the places of those with an
#: equal neighbour; how many words these cover.
_REPEATS = f"""
case when size(array_distinct(__windows)) = size(__windows) then 0L else
  transform(array(sort_array(transform(__windows, (x, i) -> struct(array_join(slice(__words, i + 1, {WINDOW}), ' ') as h, i as i)))), s ->
    aggregate(
      sort_array(filter(transform(s, (x, k) -> if((k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(s) and s[least(k + 1, size(s) - 1)].h = x.h), x.i, -1)), p -> p >= 0)),
      named_struct('n', 0L, 'last', -{WINDOW}),
      (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p),
      a -> a.n))[0] end
"""


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_text_lines, n_upper, n_marks; all long.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text. word_chars: code points in words; n_symbols: characters of `[#*$%&|<>]`;
    n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in 8-word windows that occur twice or more
    in the text; n_text_lines: lines with a word; n_upper: A-Z; n_marks: `!` and `?`. Null and empty texts have zeros.
    Columns of docs by these names are replaced, those named __text, __words, __lines and __windows go.
    """
    out = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumns({"__words": F.expr(_WORDS), "__lines": F.expr(_LINES)})
    out = out.withColumn("n_words", F.size("__words").cast("long")).withColumn("__windows", F.expr(_WINDOWS))
    count = lambda c: F.length(F.regexp_replace("__text", f"[^{c}]+", "")).cast("long")
    out = out.withColumns({
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": count("#*$%&|<>"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr(_REPEATS).cast("long"),
        "n_text_lines": F.size("__lines").cast("long"),
        "n_upper": count("A-Z"),
        "n_marks": count("!?"),
    })
    return out.drop("__text", "__words", "__lines", "__windows")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Conditions of the highest gain p1 * (log2(p1 / t1) - log2(p0 / t0)) until no good row is covered."""
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any() and (inside & bad).any():
        p0, t0 = (inside & bad).sum(), inside.sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            v = values[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 129)))
            order = np.argsort(v, kind="stable")
            below_all = np.searchsorted(v[order], cuts, "left")
            below_bad = np.concatenate(([0], np.cumsum(bad[inside][order])))[below_all]
            for above in (True, False):
                p = p0 - below_bad if above else below_bad
                t = t0 - below_all if above else below_all
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / t) - np.log2(p0 / t0)), -np.inf)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), g[k]
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The head of the rule with the highest (p - n) / (p + n) on unseen rows; its precision there and cover."""
    best, worth, out = rule, -2.0, (0.0, 0)
    for k in range(len(rule), 0, -1):
        inside = covers(rule[:k], x)
        p, t = int((inside & bad).sum()), int(inside.sum())
        got = (2 * p - t) / t if t else -1.0
        if got > worth:
            best, worth, out = rule[:k], got, (p / t if t else 0.0, t)
    return best, *out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = MAX_RULES, least: float = LEAST_PRECISION) -> list[Rule]:
    """An ordered list of rules for bad rows; two thirds of the rows grow them and one third prunes."""
    part = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & bad & ~part).any():
        grow, test = left & ~part, left & part
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], MAX_CONDITIONS)
        if not rule:
            break
        rule, precision, cover = _prune(rule, {k: v[test] for k, v in x.items()}, bad[test])
        if not cover or precision < least:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from at most `rows` labelled documents (those of the smallest hash whose crc32 of the id mod 3 is not 1).

    Conflicting labels of one doc_id count as their largest; of rows that share one, the smallest text counts. Without
    labels, or without bad ones, the list is empty."""
    usable = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    known = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("_quality"))
    picked = F.broadcast(known.orderBy(F.xxhash64(F.lit(13), "_id"), "_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(picked, "_id")
    texts = texts.groupBy("_id", "_quality").agg(F.min(F.struct("text"))["text"].alias("text"))
    values = {name: F.expr(text) for name, text in FEATURES.items()}
    got = statistics(texts).select(F.xxhash64(F.lit(17), "_id").alias("h"), "_quality", *(v.alias(k) for k, v in values.items())).collect()
    got.sort()
    x = {name: np.array([r[name] for r in got], float) for name in FEATURES}
    return learn(x, np.array([r["_quality"] == 0 for r in got], bool))


def verdict(rules: list[Rule]) -> Column:
    """False by the first rule that holds, else true; over the columns of statistics()."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the statistics, base_failed and kept.

    base_failed: fewer than 20 words, or 100 * n_repeat_words > 30 * n_words; kept is false then, else the list's
    verdict. Null and empty texts fail. Rows are judged one by one, so ties and repeated rows get equal verdicts.
    """
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
