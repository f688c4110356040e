"""Benchmark decontamination by latent semantic retrieval.

Texts become words (letters, digits and non-ASCII characters, case folded), words become hashed features, and windows of
two blocks of BLOCK words become TF-IDF passages; document frequencies count all blocks of all documents. A distributed
randomised SVD of the benchmark's passages gives the latent space: partitions of the benchmark send sums of
A^T (A W) for a random W, later of (A Q)^T (A Q), never passages. Every window of a document that has a word of the
benchmark is projected and compared with all passages by cosine; what else stands in a window has no coordinates there,
so filler can't hide a passage. Of the near pairs those go at once whose item has too few words around the window, by a
count that hash collisions can only raise.
Candidates are verified by the longest common subsequence with the item, by the weight of the words that are there, and
for paraphrases by the item's answer (its last sentence).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, hash_words, mixed, text_chunks, tidy, word_table
from .license_scan import DELIMITERS

#: Words of a block; a passage is two blocks.
BLOCK = 12
FEATURES = 1 << 18
#: Dimensions of the latent space, and those that the randomised range finder has besides.
RANK, EXTRA = 128, 8
#: A window is a candidate for a passage from this cosine on.
COSINE = 0.5
#: Slots of the sets of hashed words around a window, and the most words put into such sets at once.
SLOTS, AROUND = 4096, 1 << 21
#: Shares of an item's words that must stand in order in a document: without more, and with the answer's words there too.
ALONE, WITH_ANSWER = 0.65, 0.5
#: Share of the answer's words that must stand in order.
ANSWER = 0.8
#: Share of an item's squared weight that the words there must have: common words alone make no paraphrase.
WEIGHT = 0.5
#: Items of fewer words must be there in full.
SHORT = 8
#: Words of the benchmark that are searched in one pass; a larger benchmark is searched part by part.
PART_WORDS = 2_000_000

_INSIDE = word_table(bytes(b for b in DELIMITERS if not 65 <= b <= 90))
_SENTENCE = re.compile(r"[.!?]+\s+")


def folded(buf: np.ndarray) -> np.ndarray:
    """UTF-8 with the capitals of Latin-1 in lower case (A-Z are folded by the hash)."""
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
    if len(at):
        buf = buf.copy()
        buf[at] += 0x20
    return buf


def text_words(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    raw = [t.encode() for t in texts]
    cuts = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    s, _, h = hash_words(folded(np.frombuffer(b"".join(raw), dtype=np.uint8)), cuts, _INSIDE)
    at = np.searchsorted(s, cuts)
    return [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        if x in masks:
            u = row & masks[x]
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _blocks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each block, from the first words of the texts (and the end)."""
    n = -(-np.diff(at) // BLOCK)
    text = np.repeat(np.arange(len(n)), n)
    return at[:-1][text] + BLOCK * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), text


def document_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each feature over all blocks of docs(text)."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for _, _, buf, cuts in text_chunks(batch, "text", 1 << 20):
                s, _, h = hash_words(folded(buf), cuts, _INSIDE)
                first, _ = _blocks(np.searchsorted(s, cuts))
                if not len(first):
                    continue
                block = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(s)]))
                key = np.sort(block * FEATURES + features(h))
                found += np.bincount(key[np.r_[True, key[1:] != key[:-1]]] % FEATURES, minlength=FEATURES)
                total += len(first)
        if total:
            for i in range(0, FEATURES, 4096):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total], pa.int64()), pa.array([found[i : i + 4096].tobytes()], pa.binary())], ["first", "total", "counts"])

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, first = np.zeros(4096, dtype=np.int64), 0, None
        for batch in batches:
            for f, t, c in zip(*(batch.column(x).to_pylist() for x in ("first", "total", "counts")), strict=True):
                first, total, counts = f, total + t, counts + np.frombuffer(c, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["first", "total", "counts"])

    kind = "first int, total long, counts binary"
    df, total = np.zeros(FEATURES), 0
    for r in docs.select("text").mapInArrow(count, kind).groupBy("first").applyInArrow(add, kind).collect():
        df[r["first"] : r["first"] + 4096], total = np.frombuffer(bytes(r["counts"]), dtype=np.int64), r["total"]
    return np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(1e-3)


def passages(words: np.ndarray) -> list[tuple[int, int]]:
    """Where an item's passages begin and end."""
    n = len(words)
    return [(0, n)] if n <= 2 * BLOCK else [(i, min(n, i + 2 * BLOCK)) for i in range(0, n - BLOCK, BLOCK)]


def _rows(texts: list[str], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and unit TF-IDF weights of each passage."""
    for h in text_words(texts):
        for a, b in passages(h) if len(h) else ():
            f, tf = np.unique(features(h[a:b]), return_counts=True)
            w = tf * idf[f]
            yield f, w / max(np.linalg.norm(w), 1e-12)


def _noise(f: np.ndarray, width: int) -> np.ndarray:
    """Rows of a fixed random matrix of +-1, found by hashing."""
    x = mixed(f.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(-(-width // 64), dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
    bits = np.unpackbits(x.view(np.uint8), axis=1)[:, :width]
    return bits.astype(np.float64) * 2 - 1


def latent_space(benchmark: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """The features of benchmark(text) and their rows of the leading right singular vectors of its TF-IDF passages."""
    width = rank + extra

    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, w in _rows(batch.column("text").fill_null("").to_pylist(), idf):
                y = w @ _noise(f, width)
                for i, x in zip(f.tolist(), w.tolist(), strict=True):
                    sums[i] = sums.get(i, 0) + x * y
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["feature", "sums"])

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("feature").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["feature", "sums"])

    kind = "feature long, sums binary"
    parts = benchmark.select("text").mapInArrow(sketch, kind).groupBy((F.col("feature") % 64).alias("part")).applyInArrow(add, kind).collect()
    parts.sort(key=lambda r: r["feature"])
    used = np.array([r["feature"] for r in parts], dtype=np.int64)
    if not len(used):
        return used, np.zeros((0, 1))
    q = np.linalg.qr(np.stack([np.frombuffer(bytes(r["sums"])) for r in parts]))[0]
    place = np.zeros(FEATURES, dtype=np.int64)
    place[used] = np.arange(len(used))

    shared = benchmark.sparkSession.sparkContext.broadcast((q, place))

    @tidy
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, place = shared.value
        g = np.zeros((q.shape[1], q.shape[1]))
        for batch in batches:
            for f, w in _rows(batch.column("text").fill_null("").to_pylist(), idf):
                y = w @ q[place[f]]
                g += np.outer(y, y)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(g)), pa.int32()), pa.array(g.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    rows = benchmark.select("text").mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((q.shape[1], q.shape[1]))
    for r in rows:
        g[r["i"], r["j"]] = r["x"]
    value, vector = np.linalg.eigh(g)
    keep = np.argsort(-value)[:rank]
    return used, (q @ vector[:, keep[value[keep] > 1e-9]]).astype(np.float32)


class Index:
    """A part of the benchmark: latent passages, the items' words and answers."""

    def __init__(self, items: list[tuple[object, str]], idf: np.ndarray, used: np.ndarray, basis: np.ndarray):
        self.idf, self.row = idf, np.full(FEATURES, len(used), dtype=np.int32)
        self.row[used] = np.arange(len(used))
        self.known = self.row < len(used)
        self.vector = np.concatenate([basis * idf[used][:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        self.ids, self.words, self.weights, self.answers = [], [], [], []
        latent, self.item = [], []
        for (i, text), h in zip(items, text_words([t for _, t in items]), strict=True):
            if not len(h):
                continue
            self.ids.append(i)
            self.words.append(h.tolist())
            self.weights.append((idf[features(h)].astype(np.float64) ** 2).tolist())
            self.answers.append(text_words([_SENTENCE.split(text.strip())[-1]])[0].tolist())
            for a, b in passages(h):
                latent.append(self.vector[self.row[features(h[a:b])]].sum(axis=0))
                self.item.append(len(self.ids) - 1)
        x = np.array(latent, dtype=np.float32).reshape(len(latent), self.vector.shape[1])
        self.latent = np.ascontiguousarray((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T)
        self.item = np.array(self.item, dtype=np.int64)
        self.length = np.array([len(x) for x in self.words], dtype=np.int64)
        self.slots = np.array([w % SLOTS for x in self.words for w in x], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length

    def _possible(self, h: np.ndarray, lo: np.ndarray, start: np.ndarray, end: np.ndarray, hi: np.ndarray, window: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs may have enough of the item's words around the window; lo .. hi is the window's text.

        Items of like lengths share a set of words around a window, as wide as the longest of them needs.
        """
        slot, out = (h % np.uint64(SLOTS)).astype(np.int64), np.zeros(len(window), dtype=bool)
        kind = np.ceil(np.log2(np.maximum(self.length[item], 1))).astype(np.int64)
        for k in np.unique(kind):
            own = np.flatnonzero(kind == k)
            reach = int(self.length[item[own]].max())
            step = max(1, min(2048, AROUND // (2 * reach + 2 * BLOCK)))
            wins, back = np.unique(window[own], return_inverse=True)
            for a in range(0, len(wins), step):
                w = wins[a : a + step]
                begin = np.maximum(lo[w], start[w] - reach)
                size = np.minimum(hi[w], end[w] + reach) - begin
                there = np.zeros((len(w), SLOTS), dtype=bool)
                there[np.repeat(np.arange(len(w)), size), slot[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
                pair = own[(back >= a) & (back < a + step)]
                n = self.length[item[pair]]
                at = np.cumsum(n) - n
                words = self.slots[np.repeat(self.first[item[pair]] - at, n) + np.arange(n.sum())]
                place = np.searchsorted(w, window[pair])
                out[pair] = np.add.reduceat(there[np.repeat(place, n), words], at, dtype=np.int64) >= min(WITH_ANSWER, ALONE) * n
        return out

    def search(self, buf: np.ndarray, cuts: np.ndarray) -> dict[tuple[int, int], tuple[float, float, bool, int, int]]:
        """By (text, item number): cosine, share of words in order, is the answer there, first and end word of the span."""
        s, _, h = hash_words(folded(buf), cuts, _INSIDE)
        at = np.searchsorted(s, cuts)
        first, text = _blocks(at)
        if not len(first) or not len(self.item):
            return {}
        f = features(h)
        two = np.r_[text[1:] == text[:-1], False]
        some = np.logical_or.reduceat(self.known[f], first)
        near = np.flatnonzero(some | np.r_[two[:-1] & some[1:], False])
        if not len(near):
            return {}
        # sums of the blocks that those windows have, each block once; row -1 of the vectors is zero
        need = np.unique(np.r_[near, near[two[near]] + 1])
        word = first[need][:, None] + np.arange(BLOCK)
        word = np.where(word < np.r_[first[1:], len(h)][need][:, None], self.row[f[np.minimum(word, len(h) - 1)]], len(self.vector) - 1)
        sums = np.concatenate([self.vector[word[k : k + 4000]].sum(axis=1) for k in range(0, len(word), 4000)])
        at_block = np.searchsorted(need, near)
        found: dict[tuple[int, int], tuple[float, float, bool, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        start, end = first[near], np.minimum(first[near] + 2 * BLOCK, at[text[near] + 1])
        for k in range(0, len(near), 4000):
            w = near[k : k + 4000]
            x = sums[at_block[k : k + 4000]] + np.where(two[w][:, None], sums[np.minimum(at_block[k : k + 4000] + 1, len(sums) - 1)], 0)
            length_of, along = np.linalg.norm(x, axis=1), x @ self.latent
            pairs = np.argwhere((along >= COSINE * length_of[:, None]) & (along > 0))
            pairs = pairs[self._possible(h, at[text[w]], start[k : k + 4000], end[k : k + 4000], at[text[w] + 1], pairs[:, 0], self.item[pairs[:, 1]])]
            regions: dict[tuple[int, int], tuple[list[int], set[int]]] = {}
            for i, p in pairs.tolist():
                doc, item = int(text[w[i]]), int(self.item[p])
                if (doc, item) in found or (doc, item, i + k) in tried:
                    continue
                tried.add((doc, item, i + k))
                length = len(self.words[item])
                lo, hi = max(int(at[doc]), int(start[i + k]) - length), min(int(at[doc + 1]), int(end[i + k]) + length)
                if (lo, hi) not in regions:
                    region = h[lo:hi].tolist()
                    regions[lo, hi] = region, set(region)
                region, there = regions[lo, hi]
                # no more words can stand in order than are there at all
                if sum(map(there.__contains__, self.words[item])) < min(WITH_ANSWER, ALONE) * length:
                    continue
                share = common_length(self.words[item], region) / length
                answer = bool(self.answers[item]) and common_length(self.answers[item], region) >= ANSWER * len(self.answers[item])
                if share >= (1 if length < SHORT else ALONE) or (length >= SHORT and share >= WITH_ANSWER and answer):
                    weights = self.weights[item]
                    if sum(x for w, x in zip(self.words[item], weights, strict=True) if w in there) < WEIGHT * sum(weights):
                        continue
                    found[doc, item] = float(along[i, p] / length_of[i]), share, answer, int(start[i + k] - at[doc]), int(end[i + k] - at[doc])
        return found


def _indexes(docs: DataFrame, benchmark: DataFrame, text: str, item: str) -> Iterator:
    """Broadcast parts of the benchmark, each of a bounded number of words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("item is not null")
    idf = document_weights(docs.select(F.col(text).cast("string").alias("text")))
    used, basis = latent_space(items, idf)
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = -(-words // PART_WORDS) or 1
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else items
        yield spark.sparkContext.broadcast(Index([(r[0], r[1] or "") for r in own.orderBy("item", "text").collect()], idf, used, basis))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, cosine, share, answer, first_word, end_word): a row for each document and benchmark item it holds.

    share is the part of the item's words that stand in order around the window first_word .. end_word. Items and
    documents that are null, empty or without words are held by nothing and hold nothing; items with a null id are left
    out, a null key stays null, and repeated rows give repeated results. An empty table on either side gives an empty
    result, and other columns are not looked at.
    """
    kind = benchmark.schema[item].dataType
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {kind.simpleString()}, cosine double, share double, answer boolean, first_word long, end_word long"
    arrow, rows, out = to_arrow_type(kind), docs.select(F.col(key), F.col(text).cast("string").alias("text")), None
    for index in _indexes(docs, benchmark, text, item):

        @tidy
        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, buf, cuts in text_chunks(batch, "text", 1 << 20):
                    hits = sorted(index.value.search(buf, cuts).items())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([lo + d for (d, _), _ in hits], pa.int64())), pa.array([index.value.ids[i] for (_, i), _ in hits], arrow), *(pa.array([x[j] for _, x in hits], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())))],
                        [key, item, "cosine", "share", "answer", "first_word", "end_word"],
                    )

        found = rows.mapInArrow(search, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark by leaks()."""
    out = docs
    for index in _indexes(docs, benchmark, text, item):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, _, buf, cuts in text_chunks(batch, text, 1 << 20):
                    keep[[lo + d for d, _ in index.value.search(buf, cuts)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
