"""Language-model scoring with Katz backoff over words.

Unigram counts of all training words lie in a table partitioned by word hash. Every training word has its own bigrams.
The words frequent enough to be among the VOCABULARY most frequent ones get short ids, which are broadcast; the others
go by their 64-bit hashes. Bigrams of two ids lie in parts by history; a history so frequent that it would fill a part
is spread over all parts by its next word. Loose bigrams, of which a word has no id, lie with the unigram count of the
next word, or of the history where only that has no id. Each part receives the bigrams of all texts, counts those of the
training texts, and evaluates every text's bigrams against its counts: seen ones by their Good-Turing discounted count,
the others by the backoff weight of the history times the unigram probability. The backoff weights need sums over a
history's seen words, which the parts send, at most one row a history and part; they make every history's distribution
sum to one. Those of ids are summed for the driver, those of hashes in a table, which is joined with the bigrams of the
texts. Texts get back one partial sum a part.

Where the caller asks for a vocabulary, the words outside share one class, inside which a word's probability follows
from its own exact count; unseen words share it in both cases.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE_BYTES, bounded_batches, hash_words, materialise, text_chunks, tidy, word_table
from .language_id import held_out

#: Words with ids, which are broadcast.
VOCABULARY = 1 << 17
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Added to the counts of words of the rare class, unseen ones being one more word; and to those of the base model.
RARE_ADDED, BASE_ADDED = 0.5, 0.1
#: Bytes of text to a part, bigrams that a task gathers before it sends them, and the most of them in a message: larger
#: values fragment the heap.
PART_BYTES, GATHERED, MESSAGE = 8 << 20, 2_000_000, 1 << 15
#: Under so many words a history may have seen them all.
SMALL = 4096
#: Ids are smaller, hashes of words greater.
_LOW = 1 << 20
_END = np.uint64(_LOW)
_SPACES = word_table(SPACE_BYTES)
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value."""
    parts = []
    for x in arrays:
        raw = np.ascontiguousarray(x).tobytes()
        code = x.dtype.str.encode().ljust(8)
        squeezed = _ZSTD.compress(raw, asbytes=True) if raw else b""
        parts.append(struct.pack("<8sqq", code, len(raw), len(squeezed)) + squeezed)
    return b"".join(parts)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        code, size, squeezed = struct.unpack_from("<8sqq", raw, at)
        at += 24
        data = _ZSTD.decompress(raw[at : at + squeezed], decompressed_size=size, asbytes=True) if size else b""
        out.append(np.frombuffer(data, dtype=code.decode().strip()))
        at += squeezed
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in keys])])


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _tokens(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each followed by an end, and where each text begins (and the end)."""
    s, _, h = hash_words(buf, cuts, _SPACES)
    h[h <= _END] += np.uint64(2 * _LOW)
    at = np.searchsorted(s, cuts)
    return np.insert(h, at[1:], _END), at + np.arange(len(at))


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0 .. DISCOUNTED from n[r], the number of n-grams with count r, r up to DISCOUNTED + 1.

    Katz's formula; where it gives none in (0, 1), (r - 0.5) / r.
    """
    out = np.ones(DISCOUNTED + 1)
    top = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """What is broadcast of the unigram counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n: int, v: int, ones: np.ndarray, parts: int, starts: int, classed: bool):
        self.keys, self.counts, self.n, self.v, self.parts, self.classed = keys, counts, n, v, parts, classed
        self.rare, self.begin = len(keys), len(keys) + 1
        self.rare_n, self.rare_v = n - int(counts.sum()), v - len(keys)
        self.d = np.r_[good_turing(ones), 1.0]
        r = np.arange(1, DISCOUNTED + 1)
        self.factor = 1.0
        p = self.known(counts)
        total = p.sum() if classed else (n - ((1 - self.d[r]) * r * ones[r]).sum()) / max(n, 1)
        left = 1 - total
        if left <= 1e-12:
            left = 1 / (n + 1)
            self.factor = (1 - left) / total
        #: Probabilities of the words with ids, and of the rare class or an unseen word.
        self.p = np.r_[p * self.factor, left]
        #: How often each id is a history.
        self.history = np.r_[counts, self.rare_n if classed else 0, starts].astype(np.float64)
        self.hot = np.flatnonzero(self.history * parts > max(n, 1))

    def known(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of training words."""
        return self.factor * self.d[np.minimum(counts, DISCOUNTED + 1)] * counts / max(self.n, 1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + BASE_ADDED) / (self.n + BASE_ADDED * (self.v + 1)))

    def inside(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of a rare word among the rare ones."""
        return np.log10((counts + RARE_ADDED) / (self.rare_n + RARE_ADDED * (self.rare_v + 1)))

    def part_of(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        spread = np.zeros(len(self.history), dtype=bool)
        spread[self.hot] = True
        mix = (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
        return np.where(spread[h], mix % np.uint64(self.parts), h.astype(np.uint64) % np.uint64(self.parts)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of up to MESSAGE rows of each part."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        for lo in range(edges[p], edges[p + 1], MESSAGE):
            yield p, order[lo : min(lo + MESSAGE, edges[p + 1])]


def unigram_table(docs: DataFrame, parts: int) -> DataFrame:
    """(part, words): hashes and counts of the tokens of docs(text, train) that train, a row for each part."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            k, c = _summed(np.concatenate(keys), np.concatenate(counts))
            for p, rows in _by_part((k >> np.uint64(32)).astype(np.int64) % parts, parts):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([pack(k[rows], c[rows])], pa.binary())], ["part", "words"])

        for batch in batches:
            train = np.array(batch.column("train").to_pylist(), dtype=bool)
            for lo, hi, buf, cuts in text_chunks(batch, "text"):
                h, at = _tokens(buf, cuts)
                h = h[np.repeat(train[lo:hi], np.diff(at))]
                if len(h):
                    k, c = np.unique(h, return_counts=True)
                    keys.append(k)
                    counts.append(c)
                    held += len(k)
                if held > GATHERED:
                    yield from packed()
                    keys, counts, held = [], [], 0
        if keys:
            yield from packed()

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, c = None, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        for batch in batches:
            found = [unpack(x) for x in batch.column("words").to_pylist()]
            part = batch.column("part")[0].as_py()
            k, c = _summed(np.concatenate([k, *(x[0] for x in found)]), np.concatenate([c, *(x[1] for x in found)]))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pack(k, c)], pa.binary())], ["part", "words"])

    kind = "part long, words binary"
    return materialise(docs.select("text", "train").mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind), "unigrams")


def frequent_words(table: DataFrame, vocabulary: int, parts: int, starts: int, classed: bool) -> Unigrams:
    """The words of the greatest counts, as many as fit (all of a count or none), and totals."""
    #: Counts over 1024 are told apart by their first seven binary digits only.
    low = np.unique(np.r_[np.arange(1, 1025), [(64 + i) << e for e in range(4, 56) for i in range(64)]])
    low = low[low > 0]

    @tidy
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, total = np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=np.int64)
        for batch in batches:
            for x in batch.column("words").to_pylist():
                c = unpack(x)[1]
                at = np.searchsorted(low, c, "right") - 1
                many += np.bincount(at, minlength=len(low))
                total += np.bincount(at, weights=c, minlength=len(low)).astype(np.int64)
        on = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (on, many[on], total[on])], ["bin", "many", "total"])

    many, total = np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=np.int64)
    for r in table.mapInArrow(tell, "bin long, many long, total long").groupBy("bin").agg(F.sum("many").alias("many"), F.sum("total").alias("total")).collect():
        many[r["bin"]], total[r["bin"]] = r["many"], r["total"]
    above = np.cumsum(many[::-1])[::-1]
    fits = np.flatnonzero(above <= vocabulary)
    least = int(low[fits[0]]) if len(fits) else 1 << 62

    @tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("words").to_pylist():
                k, c = unpack(x)
                if (c >= least).any():
                    yield pa.RecordBatch.from_arrays([pa.array([pack(k[c >= least], c[c >= least])], pa.binary())], ["words"])

    found = [unpack(bytes(r["words"])) for r in table.mapInArrow(pick, "words binary").collect()]
    keys = np.concatenate([np.empty(0, dtype=np.uint64), *(x[0] for x in found)])
    counts = np.concatenate([np.empty(0, dtype=np.int64), *(x[1] for x in found)])
    order = np.argsort(keys)
    return Unigrams(keys[order], counts[order], int(total.sum()), int(many.sum()), np.r_[0, many[: DISCOUNTED + 1]], parts, starts, classed)


_KINDS = "t long, part long, kind string, body binary, ids array<{}>"


def _row(arrow: pa.DataType, t: int, part: int, kind: str, body: bytes, ids: pa.Array | None = None) -> pa.RecordBatch:
    lists = pa.array([None], pa.list_(arrow)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([part], pa.int64()), pa.array([kind]), pa.array([body], pa.binary()), lists], ["t", "part", "kind", "body", "ids"])


class _Sender:
    """Gathers the ids of texts and sends bigrams and rare words, or loose bigrams, to their parts."""

    def __init__(self, model: Unigrams, arrow: pa.DataType):
        self.model, self.arrow, self.t = model, arrow, TaskContext.get().partitionId() << 24
        self._clear()

    def _clear(self) -> None:
        self.docs, self.ids, self.flags, self.stats, self.pairs, self.rare, self.loose, self.held = 0, [], [], [], [], [], [], 0

    def add(self, ids: pa.Array, train: np.ndarray, out: np.ndarray, buf: np.ndarray, cuts: np.ndarray) -> None:
        m = self.model
        h, at = _tokens(buf, cuts)
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        place, known = _lookup(m.keys, h)
        w = np.where(known, place, m.rare)
        before = np.r_[m.begin, w[:-1]]
        before[at[:-1]] = m.begin
        base = np.zeros(len(h))
        base[known] = m.base(m.counts[place[known]])
        self.stats.append(np.stack([n, np.add.reduceat(known.astype(np.float64), at[:-1]), np.add.reduceat(base, at[:-1])]))
        self.ids.append(ids)
        self.flags.append(np.stack([out, train]))
        whole = (doc + self.docs).astype(np.uint64)
        pairs = before.astype(np.uint64) << np.uint64(44) | w.astype(np.uint64) << np.uint64(24) | whole
        if m.classed:
            self.rare.append((h[~known], whole[~known].astype(np.uint32)))
        else:
            loose = (before == m.rare) | ~known
            at = np.flatnonzero(loose)
            own = np.where(before[at] == m.rare, h[at - 1], before[at].astype(np.uint64))
            self.loose.append((own, np.where(known[at], w[at].astype(np.uint64), h[at]), whole[at].astype(np.uint32)))
            pairs = pairs[~loose]
        self.pairs.append(pairs)
        self.docs += len(n)
        self.held += len(h)

    def full(self) -> bool:
        return self.held > GATHERED or self.docs > 1 << 22

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        m, flags = self.model, np.concatenate(self.flags, axis=1)
        yield _row(self.arrow, self.t, self.t % m.parts, "text", pack(flags[0], *np.concatenate(self.stats, axis=1)), pa.concat_arrays(self.ids))
        train = flags[1].astype(bool)
        yield from self._send_rare() if m.classed else self._send_loose(train)
        pairs, self.pairs = np.concatenate(self.pairs), []
        pairs.sort()
        first = _starts(pairs)
        tf, pairs = np.diff(np.r_[first, len(pairs)]).astype(np.uint32), pairs[first]
        del first
        doc, key = (pairs & np.uint64((1 << 24) - 1)).astype(np.uint32), pairs >> np.uint64(24)
        del pairs
        part = m.part_of((key >> np.uint64(20)).astype(np.int64), (key & np.uint64((1 << 20) - 1)).astype(np.int64))
        for p, rows in _by_part(part, m.parts):
            k = key[rows]
            yield _row(self.arrow, self.t, p, "pairs", pack(np.diff(k, prepend=np.uint64(0)), doc[rows], tf[rows], train[doc[rows]]))
        self.t += 1
        self._clear()

    def _send_rare(self) -> Iterator[pa.RecordBatch]:
        m = self.model
        words, docs = np.concatenate([x for x, _ in self.rare]), np.concatenate([x for _, x in self.rare])
        for p, rows in _by_part((words >> np.uint64(32)).astype(np.int64) % m.parts, m.parts):
            yield _row(self.arrow, self.t, p, "rare", pack(words[rows], docs[rows]))

    def _send_loose(self, train: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = self.model
        h, w, doc = (np.concatenate(x) for x in zip(*self.loose, strict=True))
        self.loose = []
        order = np.lexsort((doc, h, w))
        h, w, doc = h[order], w[order], doc[order]
        first = _starts(h, w, doc)
        tf = np.diff(np.r_[first, len(h)]).astype(np.uint32)
        h, w, doc = h[first], w[first], doc[first]
        for p, rows in _by_part((np.where(w < _LOW, h, w) >> np.uint64(32)).astype(np.int64) % m.parts, m.parts):
            yield _row(self.arrow, self.t, p, "loose", pack(h[rows], w[rows], doc[rows], tf[rows], train[doc[rows]]))


def _counts(table: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> np.ndarray:
    at, there = _lookup(table[0], words)
    return np.where(there, table[1][at], 0) if len(table[0]) else np.zeros(len(words), dtype=np.int64)


def _sums(h: np.ndarray, counts: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """By history, from its seen bigrams in order: how many have each low count, the sum of p and of the other counts."""
    first = _starts(h)
    sums = [np.add.reduceat((counts == r).astype(np.int64), first) for r in range(1, DISCOUNTED + 2)]
    return h[first], *sums, np.add.reduceat(p, first), np.add.reduceat(np.where(counts > DISCOUNTED, counts, 0), first)


def _evaluate_loose(model: Unigrams, arrow: pa.DataType, table: tuple[np.ndarray, np.ndarray], sent: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The loose bigrams of one part."""
    opened = [unpack(body) for _, body in sent]
    h, w, doc, tf, train = (np.concatenate(x) for x in zip(*opened, strict=True))
    edges, tf = np.r_[0, np.cumsum([len(x[0]) for x in opened])], tf.astype(np.int64)
    del opened
    order = np.lexsort((w, h))
    first = _starts(h[order], w[order])
    c = np.add.reduceat(np.where(train, tf, 0)[order], first)
    own_h, own_w = h[order][first], w[order][first]
    named = own_w < _LOW
    word = np.zeros(len(own_w), dtype=np.int64)
    word[named], word[~named] = model.counts[own_w[named].astype(np.int64)], _counts(table, own_w[~named])
    p = np.where(word > 0, model.known(word), model.p[model.rare])
    seen = c > 0
    for kind, on in (("history", seen & (own_h < _LOW)), ("loose history", seen & (own_h >= _LOW))):
        if on.any():
            yield _row(arrow, -1, 0, kind, pack(*_sums(own_h[on], c[on], p[on])))
    back = np.empty(len(h), dtype=np.int64)
    back[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
    for i, (t, _) in enumerate(sent):
        rows = slice(edges[i], edges[i + 1])
        at, hs, ds, k = back[rows], h[rows], doc[rows], tf[rows]
        ids, old, count = hs < _LOW, seen[at], c[at]
        named_h = np.where(ids, hs, 0).astype(np.int64)
        total = np.where(ids, np.maximum(model.history[named_h], 1), 1)
        part = np.where(old, np.log10(np.maximum(count, 1) / total), np.log10(p[at])) * k
        own, place = np.unique(ds, return_inverse=True)
        add = lambda x: np.bincount(place, weights=x, minlength=len(own))
        low = [add(k * (count == r)).astype(np.uint32) for r in range(1, DISCOUNTED + 1)]
        #: A history with a low count is never scaled.
        new, over = ~old & ids, old & ids & (count > DISCOUNTED)
        yield _row(arrow, t, 0, "pairs", pack(own, add(part), *low, ds[new], named_h[new].astype(np.uint32), k[new], ds[over], named_h[over].astype(np.uint32), k[over]))
        rare, n = ~named[at], word[at]
        yield _row(arrow, t, 0, "rare", pack(own, add(k * (rare & (n > 0))), add(np.where(rare, k * model.base(n), 0)), np.zeros(len(own))))
        if not ids.all():
            turn = np.flatnonzero(~ids)
            turn = turn[np.lexsort((ds[turn], hs[turn]))]
            begin = _starts(hs[turn], ds[turn])
            yield _row(arrow, t, 0, "ask", pack(hs[turn][begin], ds[turn][begin], *(np.add.reduceat(np.where(on, k, 0)[turn], begin) for on in (~old, old))))


def _evaluate(model: Unigrams, arrow: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part: its words, and the bigrams and rare words that texts ask for."""
    table, sent = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)), {"pairs": [], "rare": [], "loose": []}
    for batch in batches:
        for i, kind in enumerate(batch.column("kind").to_pylist()):
            t, body = batch.column("t")[i].as_py(), batch.column("body")[i].as_py()
            if kind == "text":
                yield batch.slice(i, 1)
            elif kind == "words":
                table = tuple(unpack(body))
            else:
                sent[kind].append((t, body))
    if sent["loose"]:
        yield from _evaluate_loose(model, arrow, table, sent.pop("loose"))
    pairs = sent["pairs"]
    for t, body in sent["rare"]:
        word, doc = unpack(body)
        c = _counts(table, word)
        own, back = np.unique(doc, return_inverse=True)
        add = lambda x: np.bincount(back, weights=x, minlength=len(own))
        yield _row(arrow, t, 0, "rare", pack(own, add(c > 0), add(model.base(c)), add(model.inside(c))))
    if not pairs:
        return
    # counts of the training texts
    keys, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    for i in range(0, len(pairs), 64):
        some = [unpack(body) for _, body in pairs[i : i + 64]]
        keys, counts = _summed(np.concatenate([keys, *(np.cumsum(d, dtype=np.uint64)[on] for d, _, _, on in some)]), np.concatenate([counts, *(tf[on].astype(np.int64) for _, _, tf, on in some)]))
    h, w = (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64)
    # histories whose seen words may have to be scaled: spread ones, those without a low count, all of a small vocabulary
    scaled = np.full(len(model.history), len(model.keys) < SMALL)
    scaled[model.hot] = True
    scaled |= np.bincount(h, weights=counts <= DISCOUNTED, minlength=len(scaled)) == 0
    if len(keys):
        yield _row(arrow, -1, 0, "history", pack(*_sums(h, counts, model.p[w])))
    for t, body in pairs:
        delta, doc, tf, _ = unpack(body)
        key = np.cumsum(delta, dtype=np.uint64)
        at, seen = _lookup(keys, key)
        c = np.where(seen, counts[at], 0) if len(keys) else np.zeros(len(key), dtype=np.int64)
        h, w = (key >> np.uint64(20)).astype(np.int64), (key & np.uint64((1 << 20) - 1)).astype(np.int64)
        part = np.where(seen, np.log10(np.maximum(c, 1) / np.maximum(model.history[h], 1)), np.log10(model.p[w])) * tf
        own, back = np.unique(doc, return_inverse=True)
        add = lambda x: np.bincount(back, weights=x, minlength=len(own))
        low = [add(tf * (c == r)).astype(np.uint32) for r in range(1, DISCOUNTED + 1)]
        new, old = ~seen, seen & scaled[h]
        yield _row(arrow, t, 0, "pairs", pack(own, add(part), *low, doc[new], h[new].astype(np.uint32), tf[new], doc[old], h[old].astype(np.uint32), tf[old]))


_NAMES = ["h", *(f"n{r}" for r in range(1, DISCOUNTED + 2)), "p", "more"]
_HISTORY = ", ".join(f"{x} {'double' if x == 'p' else 'long'}" for x in _NAMES)


def _added() -> list[Column]:
    return [F.sum(x).alias(x) for x in _NAMES[1:]]


def _history_row(sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.float64) if x == "p" else a.astype(np.int64)) for x, a in zip(_NAMES, sums, strict=True)], _NAMES)


def _weights(n: np.ndarray, p: np.ndarray, more: np.ndarray, history: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the backoff weights of histories and of what their seen words are scaled by."""
    seen = ((d[1:] * np.arange(1, DISCOUNTED + 1)) @ n[1 : DISCOUNTED + 1] + more) / np.maximum(history, 1)
    scale, left, unseen = np.ones(len(p)), 1 - seen, 1 - p
    # nothing discounted: one count is set aside for what is new after this history
    tight = (left <= 1e-12) & (seen > 0)
    scale[tight] = history[tight] / (history[tight] + 1) / seen[tight]
    left = 1 - seen * scale
    # every word seen: nothing to back off to
    closed = unseen <= 1e-12
    scale[closed & (seen > 0)] = 1 / seen[closed & (seen > 0)]
    alpha = np.where(closed, 1.0, np.maximum(left, 1e-300) / np.where(closed, 1, unseen))
    return np.log10(alpha), np.log10(scale)


def backoff(rows: DataFrame, model: Unigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The discounts; log10 of the backoff weights of ids and of what seen words of a history are scaled by."""

    @tidy
    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, x in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist(), strict=True):
                sums = unpack(x)
                yield _history_row(sums if kind == "history" else [np.array([-1]), *(a.sum(keepdims=True) for a in sums[1:])])

    found = rows.where("kind IN ('history', 'loose history')").select("kind", "body").mapInArrow(open_rows, _HISTORY).groupBy("h").agg(*_added()).toArrow()
    size = len(model.history)
    h = found.column("h").to_numpy()
    n, p, more, on = np.zeros((DISCOUNTED + 2, size)), np.zeros(size), np.zeros(size), h >= 0
    total = np.zeros(DISCOUNTED + 2)
    for r in range(1, DISCOUNTED + 2):
        x = found.column(f"n{r}").to_numpy()
        total[r], n[r, h[on]] = x.sum(), x[on]
    p[h[on]], more[h[on]] = found.column("p").to_numpy()[on], found.column("more").to_numpy()[on]
    d = good_turing(total)
    return d, *_weights(n, p, more, model.history, d)


def _answers(rows: DataFrame, d: np.ndarray, arrow: pa.DataType, kinds: str) -> DataFrame:
    """What histories without an id add to the texts that ask."""

    @tidy
    def open_histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("body").to_pylist():
                yield _history_row(unpack(x))

    @tidy
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.stack([np.zeros(len(batch)), *(batch.column(x).to_numpy() for x in _NAMES[1 : DISCOUNTED + 2])])
            more = batch.column("more").to_numpy()
            history = np.arange(1, DISCOUNTED + 1) @ n[1 : DISCOUNTED + 1] + more
            log_alpha, log_scale = _weights(n, batch.column("p").to_numpy(), more, history, d)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(log_alpha), pa.array(log_scale - np.log10(history))], ["h", "alpha", "seen"])

    @tidy
    def open_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, x in zip(batch.column("t").to_pylist(), batch.column("body").to_pylist(), strict=True):
                h, *rest = unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.full(len(h), t)), *(pa.array(a.astype(np.int64)) for a in rest)], ["h", "t", "doc", "new", "old"])

    @tidy
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            t, doc, x = (np.concatenate(a) for a in zip(*held, strict=True))
            order = np.lexsort((doc, t))
            t, doc = t[order], doc[order]
            first = _starts(t, doc)
            t, doc, x = t[first], doc[first], np.add.reduceat(x[order], first)
            edges = np.r_[_starts(t), len(t)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield _row(arrow, int(t[a]), 0, "answer", pack(doc[a:b].astype(np.uint32), x[a:b]))

        for batch in batches:
            if not len(batch):
                continue
            held.append([batch.column(x).to_numpy() for x in ("t", "doc", "value")])
            size += len(batch)
            if size > GATHERED:
                yield from packed()
                held, size = [], 0
        if held:
            yield from packed()

    weights = rows.where("kind = 'loose history'").select("body").mapInArrow(open_histories, _HISTORY).groupBy("h").agg(*_added()).mapInArrow(weigh, "h long, alpha double, seen double")
    asked = rows.where("kind = 'ask'").select("t", "body").mapInArrow(open_asked, "h long, t long, doc long, new long, old long")
    value = F.col("new") * F.col("alpha") + F.col("old") * F.col("seen")
    return asked.join(weights, "h").select("t", "doc", value.alias("value")).mapInArrow(answer, kinds)


def katz_scores(docs: DataFrame, folds: int = 10, fold: int = 0, vocabulary: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    Tokens are what lies between ASCII white space, with A-Z in lower case, then an end; a null or empty text is an end
    alone. Rows outside the fold teach, but for those with a null key, which are neither held out nor learnt from.
    Without training texts every token has probability 1 in both models. Repeated rows count and are scored each, an
    empty table gives an empty table, and other columns of docs are not looked at. Every training word has bigrams of its
    own, unless a vocabulary is given: then only the most frequent words, as many as fit, have them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    classed = vocabulary is not None
    vocabulary = vocabulary if classed else VOCABULARY
    if vocabulary >= _LOW - 2:
        raise ValueError("ids of words have 20 bits")
    arrow, kind = to_arrow_type(docs.schema[key].dataType), docs.schema[key].dataType.simpleString()
    out = held_out(F.col(key), folds, fold)
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), out.alias("out"), (~out & F.col(key).isNotNull()).alias("train"))
    size, starts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    parts = max(8, -(-size // PART_BYTES))
    table = unigram_table(docs, parts)
    model = frequent_words(table, vocabulary, parts, starts, classed)
    shared = spark.sparkContext.broadcast(model)

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(shared.value, arrow)
        for batch in batches:
            train, out = (np.array(batch.column(c).to_pylist(), dtype=bool) for c in ("train", "out"))
            for lo, hi, buf, cuts in text_chunks(batch, "text"):
                ids = batch.column("key").slice(lo, hi - lo)
                sender.add(ids, train[lo:hi], out[lo:hi], buf, cuts)
                if sender.full():
                    yield from sender.send()
        yield from sender.send()

    @tidy
    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _evaluate(shared.value, arrow, batches)

    kinds = _KINDS.format(kind)
    words = table.select(F.lit(-1).cast("long").alias("t"), "part", F.lit("words").alias("kind"), F.col("words").alias("body"), F.lit(None).cast(f"array<{kind}>").alias("ids"))
    rows = materialise(docs.mapInArrow(send, kinds).unionByName(words).groupBy("part").applyInArrow(evaluate, kinds), "scores")
    d, *logs = backoff(rows, model)
    weights = spark.sparkContext.broadcast((np.log10(d), *logs))
    total = model.n

    @tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (log_d, log_alpha, log_scale) = shared.value, weights.value
        rest, ids, body = [], None, None
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == "text":
                    ids, body = batch.column("ids").slice(i, 1).flatten(), batch.column("body")[i].as_py()
                else:
                    rest.append((kind, batch.column("body")[i].as_py()))
        out, n, known, base = unpack(body)
        n, known, base, score = n.astype(np.int64), known.copy(), base.copy(), np.zeros(len(n))
        for kind, raw in rest:
            own, *x = unpack(raw)
            if kind == "rare":
                known[own] += x[0]
                base[own] += x[1]
                score[own] += x[2]
            elif kind == "answer":
                score[own] += x[0]
            else:
                score[own] += x[0] + sum(k * log_d[r] for r, k in enumerate(x[1 : DISCOUNTED + 1], 1))
                for logs, (doc, h, tf) in ((log_alpha, x[DISCOUNTED + 1 : DISCOUNTED + 4]), (log_scale, x[DISCOUNTED + 4 :])):
                    score += np.bincount(doc, weights=tf * logs[h], minlength=len(score))
        yield pa.RecordBatch.from_arrays([ids, pa.array(out.astype(bool)), pa.array(n), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(n), total, dtype=np.int64)), pa.array(base), pa.array(score)], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    back = rows.where("kind IN ('text', 'pairs', 'rare')")
    if not classed:
        back = back.unionByName(_answers(rows, d, arrow, kinds))
    return back.groupBy("t").applyInArrow(finish, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
