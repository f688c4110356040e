"""Language ID by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of hashed n-grams of its letters, damped, weighted by inverse document frequencies over all
training texts and normalised. Each language has several centroids, found by spherical k-means on a bounded sample of
its training texts. A text gets the language of the centroid of greatest cosine, and counts as rejected where it lies
too far even from that one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, text_chunks, tidy

#: Buckets of hashed n-grams (of three and of two bytes).
BUCKETS = 4096
CENTROIDS = 4
#: The fit looks at so many training texts of a language at most (those of least key hash).
SAMPLE = 500
ROUNDS = 12
#: A text whose best cosine is under this belongs to no learned language. Texts of fewer than ENOUGH distinct n-grams
#: can't come as near to a centroid, so their limit is lower in proportion. Long ones come nearer, noise among them too:
#: the limit rises by ABOVE with the logarithm of the number of n-grams between these two.
REJECT, ENOUGH, ABOVE, LONG = 0.1, 64, 0.2, (256, 1024)
UNKNOWN = "und"

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def vectors(buf: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Damped n-gram counts, a row for each text."""
    n = len(cuts) - 1
    if not len(buf):
        return np.zeros((n, BUCKETS), dtype=np.float32)
    # a space goes between texts, runs of other characters count as one
    doc = np.repeat(np.arange(n), np.diff(cuts))
    b = _FOLD[buf]
    first = np.zeros(len(b), dtype=bool)
    first[cuts[:-1][cuts[:-1] < len(b)]] = True
    keep = (b != 32) | np.r_[True, b[:-1] != 32] | first
    b, doc = b[keep], doc[keep]
    out = np.zeros(n * BUCKETS, dtype=np.int64)
    for size, salt in ((3, 1), (2, 2)):
        if len(b) < size:
            continue
        m = len(b) - size + 1
        x = np.full(m, salt, dtype=np.uint32)
        for j in range(size):
            x = x * np.uint32(0x01000193) ^ b[j : j + m]
        x = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        same = doc[:m] == doc[size - 1 :]
        out += np.bincount((doc[:m] * BUCKETS + x)[same], minlength=n * BUCKETS)
    return np.log1p(out.reshape(n, BUCKETS).astype(np.float32))


def weighted(v: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = v * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; the first is nearest the mean, the next ones lie farthest from those before."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(axis=1))))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _some(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Vectors of a few hundred texts at a time."""
    for a, b, buf, cuts in text_chunks(batch, "text", 1 << 20):
        for lo in range(a, b, 256):
            hi = min(b, lo + 256)
            part = cuts[lo - a : hi - a + 1]
            yield lo, hi, vectors(buf[part[0] : part[-1]], part - part[0])


def fit(train: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Inverse document frequencies, languages of the centroids and the centroids, from train(key, text, lang).

    Every value of lang is learnt; the driver holds centroids of BUCKETS floats for each.
    """
    bounded_batches(train.sparkSession)
    train = train.where("lang is not null and text is not null")

    @tidy
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for lo, hi, v in _some(batch):
                df += (v > 0).sum(axis=0)
                n += hi - lo
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.r_[n, df])], ["bucket", "n"])

    found = {r["bucket"]: r["n"] for r in train.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    df = np.array([found.get(i, 0) for i in range(BUCKETS)], dtype=np.float64)
    idf = np.log((1 + found.get(-1, 0)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    # rows by the hash of key and text together: a key of many texts, or a text of many keys, has as many hashes
    hashed = train.select("lang", F.xxhash64("key", "text").alias("h"), F.xxhash64("text").alias("k"))
    counted = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("count"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "k")
    # the sample's hashes are the least ones: rows that lie far above them needn't meet in a task, nor do repeated rows
    near = F.pmod("h", F.lit(1 << 30)).cast("double") * F.col("count") <= float(4 * sample << 30)
    rows_of = hashed.join(F.broadcast(counted), "lang").where(near).select("lang", "h", "k").distinct()
    chosen = rows_of.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample)
    chosen = F.broadcast(chosen.select("lang", "h", "k"))
    texts = train.select("lang", "text", F.xxhash64("key", "text").alias("h"), F.xxhash64("text").alias("k")).join(chosen, ["lang", "h", "k"], "left_semi")
    texts = texts.dropDuplicates(["lang", "h", "k"]).select("lang", "text")

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, v in _some(batch):
                w = weighted(v, idf)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([x.tobytes() for x in w], pa.binary())], ["lang", "vector"])

    def cluster(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v, dtype=np.float32) for v in sorted(set(table.column("vector").to_pylist()))])
        c = k_means(x, centroids)
        return pa.table({"lang": [table.column("lang")[0].as_py()] * len(c), "vector": pa.array([y.tobytes() for y in c], pa.binary())})

    kept = texts.mapInArrow(rows, "lang string, vector binary").groupBy("lang").applyInArrow(cluster, "lang string, vector binary").collect()
    kept.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    matrix = np.stack([np.frombuffer(r["vector"], dtype=np.float32) for r in kept]) if kept else np.zeros((0, BUCKETS), dtype=np.float32)
    return idf, [r["lang"] for r in kept], matrix


def limits(n: np.ndarray, reject: float) -> np.ndarray:
    """The least cosine that texts of n distinct n-grams need; without a limit none, at any length."""
    more = np.clip(np.log(np.maximum(n, 1) / LONG[0]) / math.log(LONG[1] / LONG[0]), 0, 1)
    return reject * (np.minimum(1, n / ENOUGH) + ABOVE / REJECT * more)


def _judged(model: tuple[np.ndarray, list[str], np.ndarray], texts: pa.Array, reject: float) -> tuple[list[str], list[float], list[bool]]:
    """Language, cosine and rejection of each text."""
    idf, names, matrix = model
    turned = np.ascontiguousarray(matrix.T)
    lang: list[str] = []
    score: list[float] = []
    far: list[bool] = []
    for lo, hi, v in _some(pa.RecordBatch.from_arrays([texts], ["text"])):
        cosine = weighted(v, idf) @ turned if len(names) else np.zeros((hi - lo, 1), dtype=np.float32)
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(hi - lo), best], 0, 1)
        limit = limits((v > 0).sum(axis=1), reject)
        for i in range(hi - lo):
            letters = any(c.isalpha() for c in texts[lo + i].as_py() or "")
            known = letters and bool(names)
            lang.append(names[best[i]] if known else UNKNOWN)
            score.append(float(top[i]) if known else 0.0)
            far.append(bool(top[i] < limit[i]) if known else not letters)
    return lang, score, far


def predict(docs: DataFrame, model: tuple[np.ndarray, list[str], np.ndarray], reject: float = REJECT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row's whole text.

    A null, empty or letterless text is "und" with score 0 and rejected. Under a model without languages every text is
    "und" with score 0, but texts with letters aren't rejected. Equal cosines go to the first language by name. Null keys
    and repeated rows stay, an empty table gives an empty table, and other columns of docs are not looked at.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, far = _judged(shared.value, batch.column("text"), reject)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], [key, "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: tuple[np.ndarray, list[str], np.ndarray], reject: float = REJECT, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that predict() doesn't reject."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = _judged(shared.value, batch.column(text), reject)[2]
            yield batch.filter(pa.array([not x for x in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Is crc32(key as text) mod folds this fold? A null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, folds: int = 4, fold: int = 2, reject: float = REJECT, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, rejected): learnt from the rows outside the fold, predicted for all.

    Rows with a null key, text or language teach nothing; see predict() for the rest.
    """
    train = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("key").isNotNull() & ~held_out(F.col("key"), folds, fold))
    found = predict(docs, fit(train), reject, text, key)
    return found.select(key, held_out(F.col(key), folds, fold).alias("held_out"), "lang_pred", "score", "rejected")
