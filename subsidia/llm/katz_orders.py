"""Katz backoff of any order, by one table of n-grams an order.

katz.py is the compact form for order two, within the disk budget of the registered query; this one takes the order as a
parameter and keeps its model in tables of the shared folder, dealt by gram. Each order reads the texts once and counts
its n-grams per run of text before the shuffle. An n-gram's row has its count, its history and its back, the n-gram
without its first word. The recursion goes by tables: probabilities of order n are the discounted counts of order n, and
for n-grams that training texts lack the backoff weight of the history times the probability of the back, which the
table of order n - 1 has. So every distinct n-gram is evaluated once, and texts look up their highest order alone; a
table that the next order has taken in is deleted.

Words, grams and histories go by 64-bit hashes. Every join has one row a key on its right side, whose number of tokens
is known: rows of so many tokens that at most HOT of them can exist are broadcast, the others are joined by key, so no
key of the shuffled join has more than one in HOT of all tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, discard, gram_hashes, materialise, text_chunks, tidy
from .katz import BASE_ADDED, DISCOUNTED, _tokens, good_turing
from .language_id import held_out

#: The most rows of a table that a join broadcasts.
HOT = 1 << 17
#: What precedes a text, order - 1 times; hashes of words are greater.
_BEGIN = np.uint64(1)
#: Less than this is nothing left.
_NONE = 1e-12


class _Line:
    """The tokens of some texts, with begins before each text."""

    def __init__(self, buf: np.ndarray, cuts: np.ndarray, order: int):
        h, at = _tokens(buf, cuts)
        self.sizes = np.diff(at)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(h)) + (order - 1) * (self.text + 1)
        self.items = np.full(len(h) + (order - 1) * len(self.sizes), _BEGIN)
        self.items[self.place] = h

    def grams(self, n: int, before: int = 0) -> np.ndarray:
        """For each token the n-gram that ends so many items before it; the empty one is 0."""
        if not n:
            return np.zeros(len(self.place), dtype=np.int64)
        return gram_hashes(self.items, n)[self.place - before - n + 1].view(np.int64)


def ngram_counts(docs: DataFrame, n: int, order: int) -> DataFrame:
    """(gram, history, back, n, c) of all n-grams of docs (text, train): tokens in all texts, and in the training ones."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = np.array(batch.column("train").to_pylist(), dtype=float)
            for lo, hi, buf, cuts in text_chunks(batch, "text"):
                line = _Line(buf, cuts, order)
                gram, first, own = np.unique(line.grams(n), return_index=True, return_inverse=True)
                taught = np.bincount(own, weights=train[lo:hi][line.text], minlength=len(gram)).astype(np.int64)
                columns = gram, line.grams(n - 1, 1)[first], line.grams(n - 1)[first], np.bincount(own, minlength=len(gram)), taught
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["gram", "history", "back", "n", "c"])

    found = docs.select("text", "train").mapInArrow(count, "gram long, history long, back long, n long, c long")
    return found.groupBy("gram").agg(F.min("history").alias("history"), F.min("back").alias("back"), F.sum("n").alias("n"), F.sum("c").alias("c"))


def _joined(left: DataFrame, right: DataFrame, key: str, least: int) -> DataFrame:
    """left with the columns of right, which has each key of left once, and n; both are read twice."""
    hot = F.broadcast(right.where(F.col("n") >= least).drop("n"))
    cold = right.where(F.col("n") < least).drop("n")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(cold, key))


def _discounts(counts: DataFrame) -> np.ndarray:
    row = counts.agg(*(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, DISCOUNTED + 2))).first()
    return good_turing(np.array([0, *row], dtype=float))


def _discounted(d: np.ndarray) -> Column:
    """A count c less its discount."""
    c = F.col("c")
    out = c.cast("double")
    for r in range(1, DISCOUNTED + 1):
        out = F.when(c == r, F.lit(float(d[r] * r))).otherwise(out)
    return out


def _words(counts: DataFrame, total: int) -> DataFrame:
    """Order one: unseen words share a class with what the discounts leave."""
    mass = _discounted(_discounts(counts))
    held = counts.where("c > 0").agg(F.coalesce(F.sum(mass / total), F.lit(0.0))).first()[0] if total else 0.0
    left, scale = 1 - held, 1.0
    if left <= _NONE:
        left = 1 / (total + 1)
        scale = (1 - left) / held
    logp = F.when(F.col("c") > 0, F.log10(mass * (scale / max(total, 1)))).otherwise(F.log10(F.lit(left)))
    return counts.select("gram", "n", logp.alias("logp"), F.col("c").alias("word"))


def _next_order(counts: DataFrame, lower: DataFrame, least: int, n: int) -> DataFrame:
    """Probabilities of order n by those of order n - 1, both in tables; those that went before are deleted."""
    mass = _discounted(_discounts(counts))
    backs = lower.select(F.col("gram").alias("back"), "n", F.col("logp").alias("lower"), "word")
    grams = materialise(_joined(counts, backs, "back", least).drop("back"), f"katz-{n}-grams")
    seen = F.col("c") > 0
    sums = grams.groupBy("history").agg(
        F.sum("n").alias("n"), F.sum("c").alias("total"), F.sum(F.when(seen, mass).otherwise(0.0)).alias("mass"),
        F.sum(F.when(seen, F.pow(F.lit(10.0), "lower")).otherwise(0.0)).alias("covered"),
    )
    total, held, unseen = F.col("total"), F.col("mass") / F.col("total"), 1 - F.col("covered")
    scale = F.when(unseen <= _NONE, 1 / held).when(1 - held <= _NONE, total / (total + 1) / held).otherwise(1.0)
    alpha = F.when((total == 0) | (unseen <= _NONE), 1.0).otherwise((1 - held * F.col("scale")) / unseen)
    weights = sums.withColumn("scale", F.when(total > 0, scale)).select("history", "n", F.log10(alpha).alias("alpha"), (F.log10("scale") - F.log10(total)).alias("seen"))
    weights = materialise(weights, f"katz-{n}-histories")
    found = _joined(grams, weights, "history", least)
    found = materialise(found.select("gram", "n", F.when(seen, F.log10(mass) + F.col("seen")).otherwise(F.col("alpha") + F.col("lower")).alias("logp"), "word"), f"katz-{n}")
    discard(counts, lower, grams, weights)
    return found


def ngram_scores(docs: DataFrame, order: int = 3, folds: int = 10, fold: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text, for an order from 1.

    Tokens, the fold, null keys, null and empty texts, repeated rows, empty tables and other columns are as in
    katz.katz_scores(), whose scores are those of order 2. A text is preceded by order - 1 begins, which are never
    predicted. Without training texts every token has probability 1. A history whose seen words have all but 1e-12 of the
    lower order's distribution gives unseen ones what that order gives them.
    """
    if order < 1:
        raise ValueError("the order is 1 at least")
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = held_out(F.col(key), folds, fold)
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), out.alias("out"), (~out & F.col(key).isNotNull()).alias("train"))

    counts = materialise(ngram_counts(docs, 1, order), "katz-1-counts")
    total, distinct, tokens = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = tokens // HOT + 1
    model = materialise(_words(counts, total), "katz-1")
    discard(counts)
    for n in range(2, order + 1):
        model = _next_order(materialise(ngram_counts(docs, n, order), f"katz-{n}-counts"), model, least, n)

    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, cuts in text_chunks(batch, "text"):
                line = _Line(buf, cuts, order)
                gram = line.grams(order)
                by = np.lexsort((gram, line.text))
                row, gram = line.text[by], gram[by]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])
                tf = np.diff(np.r_[first, len(row)])
                rows = pa.array(row[first] + lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(rows) for x in ("row", "key", "out")), pa.array(gram[first]), pa.array(tf)], ["row", "key", "out", "gram", "tf"])

    asked = docs.select(F.monotonically_increasing_id().alias("row"), "key", "out", "text").mapInArrow(ask, f"row long, key {kind}, out boolean, gram long, tf long")
    found = _joined(materialise(asked, "katz-texts"), model, "gram", least)
    tf, base = F.col("tf"), F.log10((F.col("word") + BASE_ADDED) / (total + BASE_ADDED * (distinct + 1)))
    scores = found.groupBy("row", "key", "out").agg(
        F.sum("tf").alias("n_tokens"), F.sum(F.when(F.col("word") > 0, tf).otherwise(0)).alias("n_known"),
        F.sum(tf * base).alias("base_score"), F.sum(tf * F.col("logp")).alias("score"),
    )
    return scores.select(F.col("key").alias(key), F.col("out").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
