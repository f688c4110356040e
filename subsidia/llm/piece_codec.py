"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that no merge can cross: a run of word marks and what follows it. The distinct segments of a
batch lie in flat numpy arrays, one symbol after another. Each round looks up the rank of every adjacent pair, takes the
smallest rank of each segment, merges its occurrences from the left in all segments at once and compacts the arrays;
a segment leaves when no pair is left. Characters outside the vocabulary become byte pieces. A bounded cache keeps the
segments that a task has seen before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, tidy

MARK = "▁"
#: Segments that a worker remembers within a task.
CACHE_ENTRIES = 120_000
CACHED_LENGTH = 64
#: Segments of more symbols go through an agenda of pairs instead: rounds would be as many as their merges.
LONG_SEGMENT = 1000
_NONE = np.int32(2**31 - 1)
_WORKER: dict[str, "Codec"] = {}


class _Strings:
    """Byte strings in one buffer, to be put together by arrays of their numbers."""

    def __init__(self, strings: list[bytes]):
        self.buffer = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """For each run of ids, up to its end, its strings in one."""
        size = self.size[ids]
        total = np.r_[0, np.cumsum(size)]
        raw = self.buffer[np.repeat(self.start[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        cut = total[np.r_[0, ends]].tolist()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Codec:
    """Encodes and decodes as the library does, for BPE models with an identity normaliser and byte fallback."""

    def __init__(self, model: bytes, entries: int = CACHE_ENTRIES):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, an identity normaliser and a dummy prefix are handled")
        self.pieces = [p.piece for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in proto.pieces) or any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("user-defined or unused pieces, or word marks inside pieces, are not handled")
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        scores = np.array([p.score for p in proto.pieces])
        order = np.unique(-scores, return_inverse=True)[1]
        self.rank = order.astype(np.int32)
        # symbols: a piece's id, or from len(pieces) on a character that only occurs in longer pieces
        self.char = np.full(0x110000, -1, dtype=np.int32)
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, len(self.pieces) + len(symbols))
            self.char[ord(c)] = symbols[c]
        unsafe, keys, ids = set(), [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is None or b is None:
                    continue
                keys.append(a << 32 | b)
                ids.append(i)
                # a merge that makes a part of a piece of the same or better rank is done one occurrence at a time
                unsafe.update(x for x in (a, b) if x < len(self.pieces) and self.rank[i] <= self.rank[x] and len(self.pieces[x]) > 1)
        self.unsafe = np.zeros(len(self.pieces), dtype=bool)
        self.unsafe[list(unsafe)] = True
        counts = np.bincount(self.rank[list(normal.values())])
        self.unsafe |= counts[np.minimum(self.rank, len(counts) - 1)] > 1
        self._hash(np.array(keys, dtype=np.uint64), np.array(ids, dtype=np.int32))
        self.decimal = _Strings([b"%d," % i for i in range(len(self.pieces))])
        self.bytes = _Strings([bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)])
        self.entries = entries
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def _hash(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Open addressing, so that a lookup is a few gathers."""
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slot_key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.slot_id = np.full(1 << bits, -1, dtype=np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slot_id[at[left]] < 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(at[left], return_index=True)[1]] = True
            put = left[free & first]
            self.slot_key[at[put]], self.slot_id[at[put]] = keys[put], ids[put]
            left = left[~(free & first)]
            at[left] = at[left] + np.uint64(1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        out = np.full(len(a), -1, dtype=np.int32)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[ok].astype(np.uint64) << np.uint64(32) | b[ok].astype(np.uint64)
        at = self._slot(keys)
        for _ in range(self.probes):
            found = self.slot_key[at] == keys
            out[ok[found]] = self.slot_id[at[found]]
            go = ~found & (self.slot_id[at] >= 0)
            ok, keys, at = ok[go], keys[go], at[go] + np.uint64(1) & self.mask
            if not len(ok):
                break
        return out

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment (word marks included)."""
        flat, ends = self._encoded(segments)
        flat, cut = flat.tolist(), [0, *ends.tolist()]
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after another, and where each ends."""
        if any(len(s) > LONG_SEGMENT for s in segments):
            ids, ends = self._encoded([s for s in segments if len(s) <= LONG_SEGMENT])
            short = iter(np.split(ids, ends)[:-1])
            parts = [np.array(self._encode_long(s), dtype=np.int64) if len(s) > LONG_SEGMENT else next(short) for s in segments]
            return np.concatenate(parts), np.cumsum([len(x) for x in parts])
        text = "".join(segments)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        sym, seg = self.char[points], np.repeat(np.arange(len(segments)), sizes)
        at = np.arange(len(points))
        made = np.full(len(sym), -1, dtype=np.int32)
        if len(sym) > 1:
            made[:-1] = np.where(seg[:-1] == seg[1:], self._pairs(sym[:-1], sym[1:]), -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], _NONE)
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            count = np.diff(np.r_[first, len(seg)])
            least = np.minimum.reduceat(rank, first)
            if (over := least == _NONE).any():
                gone = np.repeat(over, count)
                done.append((at[gone], sym[gone]))
                stay = ~gone
                at, sym, seg, made, rank = at[stay], sym[stay], seg[stay], made[stay], rank[stay]
                if not len(sym):
                    break
                least, count = least[~over], count[~over]
                first = np.r_[0, np.cumsum(count)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(least, count))
            where = seg[hit]
            slow = self.unsafe[made[hit]]
            new_run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (where[1:] != where[:-1])]
            run = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run) % 2 == 0
            if slow.any():
                lead = np.r_[True, where[1:] != where[:-1]]
                take = np.where(slow, lead, take)
            hit = hit[take]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            touched = moved[hit]
            at, sym, seg, made = at[keep], sym[keep], seg[keep], made[keep]
            near = np.zeros(len(sym) + 1, dtype=bool)
            near[touched] = near[touched - 1] = True  # the place before the first is the last one, which is none
            again = np.flatnonzero(near[:-1])
            inside = again[again + 1 < len(sym)]
            made[again] = -1
            inside = inside[seg[inside] == seg[inside + 1]]
            made[inside] = self._pairs(sym[inside], sym[inside + 1])
        place = np.concatenate([x for x, _ in done]) if done else np.empty(0, dtype=np.int64)
        ids = np.concatenate([x for _, x in done]) if done else np.empty(0, dtype=np.int32)
        order = np.argsort(place, kind="stable")
        place, ids = place[order], ids[order]
        ends = np.searchsorted(place, np.cumsum(sizes))
        odd = np.flatnonzero((ids < 0) | (ids >= len(self.pieces)))
        if len(odd):
            # characters that are no pieces become their bytes
            raw = [[self.byte_id[b] for b in text[place[i]].encode()] for i in odd.tolist()]
            size = np.ones(len(ids), dtype=np.int64)
            size[odd] = [len(x) for x in raw]
            total = np.r_[0, np.cumsum(size)]
            ids, ends = np.repeat(ids, size), total[ends]
            for i, x in zip(total[odd].tolist(), raw, strict=True):
                ids[i : i + len(x)] = x
        return ids.astype(np.int64), ends

    def _encode_long(self, segment: str) -> list[int]:
        """The same merges in time n log n: the best pair, and of equals the leftmost, from a heap over a linked list."""
        import heapq

        sym = self.char[np.frombuffer(segment.encode("utf-32-le"), dtype=np.uint32)]
        n = len(sym)
        made = self._pairs(sym[:-1], sym[1:])
        sym, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(self.rank[m]), i, sym[i], sym[i + 1], m) for i, m in enumerate(made.tolist()) if m >= 0]
        heapq.heapify(heap)
        gone = bytearray(n)
        seen: dict[tuple[int, int], int] = {}

        def offer(i: int, j: int) -> None:
            if i < 0 or j >= n or sym[i] < 0 or sym[j] < 0:
                return
            if (pair := (sym[i], sym[j])) not in seen:
                seen[pair] = int(self._pairs(np.array([pair[0]]), np.array([pair[1]]))[0])
            if (m := seen[pair]) >= 0:
                heapq.heappush(heap, (int(self.rank[m]), i, *pair, m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            if gone[i] or sym[i] != a or (j := after[i]) >= n or sym[j] != b:
                continue
            sym[i], gone[j], after[i] = m, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for i in range(n) if not gone[i] for x in self._bytes(sym[i], segment[i])]

    def _bytes(self, symbol: int, char: str) -> list[int]:
        return [symbol] if 0 <= symbol < len(self.pieces) else [self.byte_id[b] for b in char.encode()]

    def surface(self, ids: list[int]) -> str:
        """The text of ids, with spaces for word marks and the first one kept."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out)

    def fill(self, keys: set[str]) -> dict[str, tuple[int, bytes, bytes]]:
        """Table that holds every key: (number of ids, ids in decimal with commas, text decoded from them).

        A key without a word mark stands behind one.
        """
        missing = list(keys.difference(self.known))
        if len(self.known) + len(missing) > self.entries:
            self.known = {}
            missing = list(keys)
        segments = [k if k[:1] == MARK else MARK + k for k in missing]
        if segments:
            ids, ends = self._encoded(segments)
            n = np.diff(np.r_[0, ends]).tolist()
            self.known.update(zip(missing, zip(n, self.decimal.joined(ids, ends), self.bytes.joined(ids, ends), strict=True), strict=True))
        return self.known

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, sha256 of its ids in decimal, sha256 of the text decoded from them."""
        cut, keys = [], set()
        for text in texts:
            if not text:
                words: list[str] = []
            elif MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
                words = [s[1:] if s[1:2] not in ("", MARK) else s for s in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
            else:
                words = text.split(" ")
            keys.update(words)
            cut.append(words)
        known, out = self.fill(keys), []
        for words in cut:
            found = [known[w] for w in words]
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            out.append((sum(n), hashlib.sha256(b"".join(ids)[:-1]).hexdigest(), hashlib.sha256(b"".join(text)[1:]).hexdigest()))
        for k in [k for k in keys if len(k) > CACHED_LENGTH]:
            del known[k]
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        segments = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return [i for ids in self.encode_segments(segments) for i in ids]

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if text[:1] == " " else text


def _codec(model: bytes) -> Codec:
    """A worker's codec of a model, told apart by the model's content: files can change under their paths."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _WORKER:
        _WORKER[name] = Codec(model)
    return _WORKER[name]


def _model(docs: DataFrame, path: str):
    bounded_batches(docs.sparkSession)
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def piece_digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row's whole text, without begin or end ids.

    A null or empty text has no ids; its digests are those of the empty string. A null key stays null, repeated rows
    stay repeated, an empty table gives an empty table, and other columns of docs are not looked at.
    """
    shared = _model(docs, model_path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts, out, lo, held = batch.column(1).fill_null("").to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held > 1_000_000 or i + 1 == len(texts):
                    out += codec.digests(texts[lo : i + 1])
                    lo, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[j] for x in out], pa.string()) for j in (1, 2))], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.known = {}

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): the ids of every row's whole text; a null text has an empty array."""
    shared = _model(docs, model_path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(rows: DataFrame, model_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text string): the text of each row's ids; null ids give the empty text."""
    shared = _model(rows, model_path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
