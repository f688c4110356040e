"""Runs of repeated word sequences, by the runs theorem.

A run is a maximal stretch of words with a smallest period q that it holds several times. Every run has, under the order
of the words or under its reverse, the longest Lyndon word at some of its positions as its root. Those words end before
the next smaller (reverse: greater) value of the inverse suffix array. Each root is extended to both sides by longest
common extensions: least values of the LCP array between two suffixes, from a sparse table, for the words and for the
words backwards. All of it is per text and linear but for sorting; a text's arrays are the only state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, tidy

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: ASCII white space as a class of a regular expression of Java.
_SPACE = r"[\x20\x09-\x0D]+"


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of some ids and its inverse, by doubling; only suffixes that aren't told apart are sorted on."""
    n = len(words)
    sa = np.argsort(words, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    new = np.r_[True, words[sa[1:]] != words[sa[:-1]]]
    # the rank of a suffix is where its group of equal ones begins
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while True:
        alone = new & np.r_[new[1:], True]
        at = np.flatnonzero(~alone)
        if not len(at):
            return sa, rank
        own = sa[at]
        later = own + k
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[at] = own
        differs = np.r_[True, key[1:] != key[:-1]]
        new[at] = differs
        rank[own] = np.maximum.accumulate(np.where(differs, at, 0))
        k *= 2


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the length."""
    out, stack = [len(values)] * len(values), []
    for i, x in enumerate(values):
        while stack and values[stack[-1]] > x:
            out[stack.pop()] = i
        stack.append(i)
    return out


class Extensions:
    """Longest common extensions of suffixes of some ids, by a sparse table over the LCP array."""

    def __init__(self, words: np.ndarray, arrays: tuple[np.ndarray, np.ndarray] | None = None):
        sa, self.inverse = arrays or suffix_array(words)
        n = self.n = len(words)
        lcp, held = np.zeros(n, dtype=np.int32), 0
        ids, rank, at = words.tolist(), self.inverse.tolist(), sa.tolist()
        for i in range(n):  # Kasai: the next suffix shares at most one word less with its neighbour
            if not rank[i]:
                held = 0
                continue
            j = at[rank[i] - 1]
            end = n - max(i, j)
            while held < end and ids[i + held] == ids[j + held]:
                held += 1
            lcp[rank[i]] = held
            held = max(0, held - 1)
        self.table = [lcp]
        while 2 << len(self.table) - 1 <= n:
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j share (i and j differ; n is the empty suffix)."""
        out = np.zeros(len(i), dtype=np.int64)
        inner = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.inverse[i[inner]], self.inverse[j[inner]]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            row = self.table[k]
            out[inner[own]] = np.minimum(row[a[own]], row[b[own] - (1 << k)])
        return out


def find_runs(words: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least so many words and periods (two at least), by start, then period."""
    n = len(words)
    if n < max(least, periods):
        return []
    arrays = suffix_array(words)
    values = arrays[1].tolist()
    at, roots = np.arange(n), []
    for order, ends in enumerate((next_smaller(values), next_smaller([-x for x in values]))):
        ends = np.array(ends)
        period = ends - at
        # so many words of a run lie from its leftmost root on; where no greater value follows, the word reaches the end,
        # and the runs there are found under the other order
        need = np.maximum(least, periods * period) - period + 1
        here = np.flatnonzero((at + need <= n) & ((ends < n) | (order == 0)))
        for share in (0, 2, 1):  # a word of theirs at the front, the end, the middle
            i = here + (need[here] - 1 - period[here]) * share // 2
            here = here[words[i] == words[i + period[here]]]
        roots.append(np.stack([here, ends[here] - here], axis=1))
    found = np.concatenate(roots)
    if not len(found):
        return []
    i, p = found[:, 0], found[:, 1]
    forward = Extensions(words, arrays).common(i, i + p)
    enough = forward + 2 * p > np.maximum(least, periods * p)  # less than a period lies before the leftmost root
    i, p, forward = i[enough], p[enough], forward[enough]
    if not len(i):
        return []
    back = Extensions(words[::-1].copy()).common(n - i, n - i - p)
    start, length = i - back, back + p + forward
    keep = (length >= periods * p) & (length >= least)
    return sorted(set(zip(start[keep].tolist(), length[keep].tolist(), p[keep].tolist(), strict=True)))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, runs array of (start, length, period), collapsed text) of every row.

    Words are what lies between ASCII white space, numbered from 0 and compared byte by byte. runs are in the order of
    start, then period; collapsed holds the words that stay, joined by single spaces. A null, empty or blank text has no
    words, no runs and an empty collapsed text. Rows are judged each for itself, so repeated rows, repeated keys and null
    keys give a row each; an empty table gives an empty table, and other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept, done = [], [], [], 0
            for i, value in enumerate(batch.column("text")):
                words = (value.as_py() or "").encode().split()
                ids: dict[bytes, int] = {}
                own = find_runs(np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64), least, periods)
                if own:
                    stays = collapse(len(words), own).tolist()
                    kept.append(b" ".join([w for w, stay in zip(words, stays, strict=True) if stay]))
                else:
                    kept.append(b" ".join(words))
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                if i + 1 == batch.num_rows or sum(map(len, kept)) > 4 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(done, i + 1 - done), pa.array(sizes, pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])
                    sizes, runs, kept, done = [], [], [], i + 1

    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"key {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return found.withColumnRenamed("key", key)


def with_periods(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) of every row, with a periodic tail in the texts whose key asks for it.

    With h the crc32 of the key's decimal digits, a tenth of the keys (h % 10 = 0) have the words from a on replaced by
    repeats of the p words that stand there, where g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8). Null keys
    and texts without words stay as they are.
    """
    h = F.crc32(F.col("key").cast("string").cast("binary"))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    drawn = rows.withColumn("w", F.when(h % 10 == 0, words)).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("w"))
    drawn = drawn.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    drawn = drawn.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    head = F.slice("w", F.lit(1), F.col("a").cast("int"))
    return drawn.select(F.col("key").alias(key), F.when(F.col("n") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of periodic_runs() and, of each text, the run with the most periods (ties: least start, then period)."""
    better = lambda a, b: F.when((b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    most = F.aggregate(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), better)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.withColumn("most", most)
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period", F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
