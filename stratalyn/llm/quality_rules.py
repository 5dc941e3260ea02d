"""Quality rules: a learned decision list over text statistics. DataFrame functions only.

Statistics of a text are computed inside its row, without a shuffle. The list is learned by sequential covering: a
conjunction of thresholds is grown on two thirds of the labelled sample by information gain over the rejected class,
pruned on the rest, kept if it stays precise, and what it covers is removed before the next one is grown. The list
becomes one ordered CASE expression.

The labelled sample is bounded (``LABELLED`` rows, the smallest hashes of doc_id outside the held-out fifth; of a doc_id
that is repeated, one text).

Defined results: null and empty texts have no words and fail the base rule; very long texts are read whole; of several
labels of a doc_id the highest counts; other columns pass through, but those named like an output are replaced; repeated
rows get equal verdicts; without labels the list is empty and the base rule alone decides; an empty table gives an empty
one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalyn.llm.common import beside, held_out, let, one_text_each, words_of

LABELLED = 6000
MAX_RULES, MAX_TESTS, PRECISION, LEAST = 8, 3, 0.95, 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
FEATURES = ["n_words", "word_len", "symbols", "dup_lines", "repeats", "upper", "bangs", "digits", "word_share"]


def _repeat_words(words: Column, index_bits: int = 31) -> Column:
    """Words that lie in a window of three that occurs at least twice.

    A window becomes one whole number, the upper bits of its hash and its place in the lower ``index_bits``. These are
    sorted, and places whose neighbours have the same bits are kept; each is held against the words of the next. Only
    where two of them differ, a collision, are the windows sorted by their words. Places are sorted; three words each,
    less what overlaps.
    """
    window = lambda i: [F.get(words, i + k) for k in range(3)]
    places = F.sequence(F.lit(0), F.size(words) - 3)
    bits = lambda x: F.shiftright(x, index_bits)
    place = lambda x: x.bitwiseAND(F.lit((1 << index_bits) - 1)).cast("int")
    total = lambda p: F.aggregate(F.sort_array(p), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    either = lambda s, same: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)))
    numbers = F.transform(places, lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(-1 << index_bits)).bitwiseOR(i.cast("long")))

    def compared(c: Column) -> Column:
        """``c``: numbers whose upper bits are those of a neighbour."""
        differ = lambda x, y: ~reduce(and_, (u == v for u, v in zip(window(place(x)), window(place(y)))))
        collisions = F.filter(c, lambda x, k: F.coalesce((bits(x) == bits(F.get(c, k + 1))) & differ(x, F.get(c, k + 1)), F.lit(False)))
        by_words = let(F.sort_array(F.transform(c, lambda x: F.struct(F.struct(*(w.alias(f"w{k}") for k, w in enumerate(window(place(x))))).alias("w"), place(x).alias("i")))), lambda s: total(F.transform(either(s, lambda a, b: a["w"] == b["w"]), lambda x: x["i"])))
        return F.when(F.size(c) < 2, F.lit(0)).when(F.size(collisions) > 0, by_words).otherwise(total(F.transform(c, place)))

    found = let(F.sort_array(numbers), lambda s: let(either(s, lambda a, b: bits(a) == bits(b)), compared))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(found)


def statistics(docs: DataFrame, features: str = "features") -> DataFrame:
    """``docs`` with the base statistics and the features of the list; columns of these names are replaced."""
    docs = docs.drop(*STATISTICS, features)
    text, w, n = F.coalesce(F.col("text"), F.lit("")), beside(docs, "words_of_text"), beside(docs, "counts_of_text")
    words = docs.withColumn(w, words_of(F.col("text")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = lambda charset: F.length(F.regexp_replace(text, charset, ""))
    signs = let(F.regexp_replace(text, "[^A-Z!0-9]+", ""), lambda x: F.struct(F.length(F.regexp_replace(x, "[^A-Z]+", "")).alias("upper"), F.length(F.regexp_replace(x, "[^!]+", "")).alias("bangs"), F.length(F.regexp_replace(x, "[^0-9]+", "")).alias("digits"), F.length(text).alias("chars")))
    base = words.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        kept("[^#*$%&|<>]+").cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col(w), lambda x: _repeat_words(x)).cast("long").alias("n_repeat_words"), signs.alias(n),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    found = [F.col("n_words").cast("double"), per("word_chars", "n_words"), per("n_symbols", "word_chars"), per("n_dup_lines", "n_words"), per("n_repeat_words", "n_words"), per(f"{n}.upper", "word_chars"), per(f"{n}.bangs", "word_chars"), per(f"{n}.digits", "word_chars"), per("word_chars", f"{n}.chars")]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.withColumn(features, F.array(*found)).withColumn("base_failed", failed).drop(n)


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which every test (feature, above?, threshold) holds."""

    tests: tuple[tuple[int, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.tests:
            out &= x[:, f] > t if above else x[:, f] <= t
        return out

    def expression(self, features: str) -> Column:
        out = F.lit(True)
        for f, above, t in self.tests:
            v = F.get(F.col(features), F.lit(f))
            out = out & (v > t if above else v <= t)
        return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule = Rule(())
    for _ in range(MAX_TESTS):
        inside = rule.covers(x)
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not n or not p:
            break
        best, gain = None, 0.0
        for f in range(x.shape[1]):
            v = x[inside, f]
            steps = np.unique(np.quantile(v, np.linspace(0.005, 0.995, 100)))
            for t in ((steps[:-1] + steps[1:]) / 2).tolist():  # half-way: no threshold sits on a value that clean texts have
                for above in (True, False):
                    hit = v > t if above else v <= t
                    q, m = int((bad[inside] & hit).sum()), int(hit.sum())
                    if q >= LEAST and (g := q * (np.log2(q / m) - np.log2(p / (p + n)))) > gain:
                        best, gain = (f, above, float(t)), g
        if best is None:
            break
        rule = Rule((*rule.tests, best))
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = rule.covers(x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / max(p + n, 1)


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Sequential covering; row order must carry no information."""
    rules: list[Rule] = []
    hold = np.arange(len(x)) % 3 == 0
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (bad & left & ~hold).sum() >= LEAST:
        rule = _grow(x[left & ~hold], bad[left & ~hold])
        while len(rule.tests) > 1 and _worth(Rule(rule.tests[:-1]), x[left & hold], bad[left & hold]) >= _worth(rule, x[left & hold], bad[left & hold]):
            rule = Rule(rule.tests[:-1])
        hit = rule.covers(x) & left
        if not rule.tests or not hit[hold].any() or bad[hit & hold].mean() < PRECISION or bad[hit & ~hold].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> list[Rule]:
    """The decision list; only the numbers of at most ``bound`` labelled texts, one a doc_id, reach the driver."""
    sample = one_text_each(docs, _ids(labels, bound))
    # not filtered here: a filter on the statistics would move below the join and compute them for every document
    found = statistics(sample).select(F.xxhash64("doc_id").alias("h"), "features", "label", "base_failed").collect()
    rows = sorted((r for r in found if not r.base_failed), key=lambda r: (r.h, r.features))
    if not rows:
        return []
    return learn(np.array([r.features for r in rows]), np.array([r.label == 0 for r in rows]))


def _ids(labels: DataFrame, bound: int) -> DataFrame:
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return chosen.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def verdict(rules: list[Rule], features: str = "features") -> Column:
    """Ordered: base rule, then each learned rule rejects; what none covers is kept."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        out = out.when(rule.expression(features), False)
    return out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    features = beside(docs, "features")
    return statistics(docs, features).withColumn("kept", verdict(rules, features)).drop(features)
