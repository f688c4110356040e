"""Exact top-k inner products over a bit-sliced index.

Each task packs its rows into blocks: for every bit of every quantised attribute one bitmap over the block's rows. The
score of a query is a sum of attributes times small integers, so of bitmaps with powers of two as weights; carry-save
adders on whole bitmaps turn them into the bit slices of all rows' scores at once, for a batch of queries. The best
rows are then selected from the most significant slice downward, and the rows that tie at the boundary are resolved by
id. Negative factors take complemented bitmaps, so every weight is positive. All numbers are exact.

The index stays where it is: runs of queries of bounded size are broadcast, one run at a time, and each task reads its
blocks once a run, keeps every query's best rows so far, and passes over a block for the queries whose greatest possible
score there is below what they have. Only a task's best rows are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark import TaskContext

from .common import bounded_batches, materialise, tidy

SCALE, TOP, EVERY = 64, 20, 20
#: Rows of a block of the index, queries of a packed row, and queries added up at once.
BLOCK, QUERIES, BATCH = 8192, 256, 16
#: Bytes of the queries of a run, which are broadcast.
RUN_BYTES = 32 << 20
#: Codes and scores beyond these don't fit the arithmetic: the call fails.
LARGEST, GREATEST = float(1 << 60), float(1 << 62)
_U = np.uint64


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as doubles, null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = vector.isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    whole = lambda y: F.when(F.abs(y) <= LARGEST, F.floor(y).cast("double")).otherwise(y)  # noqa: E731 - floor() ends at longs
    return F.when(good, F.transform(x, lambda v: whole(F.lit(float(scale)) * v)))


class Block:
    """The slices of some rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.lexsort((np.arange(len(ids)), ids))
        self.ids, values = ids[order], values[order].astype(np.int64)
        self.low = values.min(axis=0)
        above = values - self.low
        self.bits = np.array([int(x).bit_length() for x in above.max(axis=0)], dtype=np.int64)
        words = -(-len(ids) // 64)
        rows = [np.zeros(words * 64, dtype=np.uint8) for _ in range(int(self.bits.sum()))]
        k = 0
        for d, n in enumerate(self.bits):
            for b in range(n):
                rows[k][: len(ids)] = above[:, d] >> b & 1
                k += 1
        self.slices = np.packbits(np.array(rows, dtype=np.uint8).reshape(len(rows), words * 64), axis=1, bitorder="little").view(_U) if rows else np.zeros((0, words), dtype=_U)

    def pack(self) -> bytes:
        head = np.array([len(self.ids), len(self.low)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.ids.astype(np.int64), self.low, self.bits, np.ascontiguousarray(self.slices)))

    @classmethod
    def unpack(cls, raw: bytes) -> Block:
        n, d = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
        flat = np.frombuffer(raw, dtype=np.int64, offset=16)
        self = cls.__new__(cls)
        self.ids, self.low, self.bits = flat[:n], flat[n : n + d], flat[n + d : n + 2 * d]
        self.slices = flat[n + 2 * d :].view(_U).reshape(int(self.bits.sum()), -(-n // 64))
        return self

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (codes, padded to the index's attributes) the ids and scores of its best k rows but its own."""
        sums = self._sums(queries)
        n, words = len(self.ids), -(-len(self.ids) // 64)
        valid = np.zeros((len(queries), words * 64), dtype=np.uint8)
        valid[:, :n] = self.ids[None, :] != own[:, None]
        edge = np.packbits(valid, axis=1, bitorder="little").view(_U)
        sure = np.zeros_like(edge)
        for s in reversed(sums):
            tried = sure | edge & s
            many = np.bitwise_count(tried).sum(axis=1) > k
            sure = np.where(many[:, None], sure, tried)
            edge = np.where(many[:, None], edge & s, edge & ~s)
        negative = queries < 0
        base = queries @ self.low + (queries * negative) @ ((1 << self.bits) - 1)
        # the boundary rows have equal scores: the smaller ids fill up to k
        open_bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").astype(bool)
        sure, edge = open_bits(sure), open_bits(edge & ~sure)
        out = []
        for i in range(len(queries)):
            rows = np.flatnonzero(sure[i])
            if len(rows) < k:
                rows = np.r_[rows, np.flatnonzero(edge[i])[: k - len(rows)]]
            score = np.full(len(rows), base[i], dtype=np.int64)
            for p, s in enumerate(sums):
                score += (s[i, rows >> 6] >> (rows & 63).astype(_U) & _U(1)).astype(np.int64) << p
            out.append((self.ids[rows], score))
        return out

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """At least the greatest score that any row could have with each query; doubles, as the sum may not fit a long."""
        asks, low = queries.astype(np.float64), self.low.astype(np.float64)
        part = np.maximum(asks * low, asks * (low + 2.0**self.bits))
        return part.sum(axis=1) + 1e-9 * np.abs(part).sum(axis=1)

    def _sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * attribute or its complement), least significant first: each (queries, words)."""
        total, words = self.slices.shape
        every = np.concatenate([self.slices, ~self.slices, np.zeros((1, words), dtype=_U)])
        dim = np.repeat(np.arange(len(self.bits)), self.bits)
        bit = np.arange(total) - np.repeat(np.cumsum(self.bits) - self.bits, self.bits)
        size = np.abs(queries)
        place = np.where(queries[:, dim] < 0, np.arange(total) + total, np.arange(total))
        at: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            on = (size[:, dim] >> j & 1).astype(bool)
            for b in np.unique(bit):
                own = bit == b
                at.setdefault(int(b) + j, []).append(np.where(on[:, own], place[:, own], 2 * total))
        out, carried, p = [], [], 0
        while p <= max(at, default=-1) or carried:
            stack = carried
            if p in at:
                index = np.concatenate(at[p], axis=1)
                index = np.sort(index, axis=1)  # the zero bitmap comes last, so that columns of nothing else go
                stack = [every[index[:, : int((index < 2 * total).sum(axis=1).max(initial=0))]], *carried]
            x = np.concatenate(stack, axis=1) if stack else np.zeros((len(queries), 0, words), dtype=_U)
            carried = []
            while x.shape[1] > 1:
                m = x.shape[1] // 3
                if m:
                    a, b, c = x[:, :m], x[:, m : 2 * m], x[:, 2 * m : 3 * m]
                    ab = a ^ b
                    carried.append(a & b | ab & c)
                    x = np.concatenate([ab ^ c, x[:, 3 * m :]], axis=1)
                else:
                    carried.append(x[:, :1] & x[:, 1:])
                    x = x[:, :1] ^ x[:, 1:]
            out.append(x[:, 0] if x.shape[1] else np.zeros((len(queries), words), dtype=_U))
            p += 1
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


def top_inner_products(vectors: DataFrame, top: int = TOP, every: int = EVERY, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for each key divisible by every, its top rows by inner product of codes.

    Equal scores go to the smaller key. Vectors that are null or hold a null or a non-finite component take no part, nor
    do those with a null key; a shorter vector counts as padded with zeros. Rows that repeat a key are candidates each,
    but not for queries of that key, whose repeats with one vector count once. Where a code is beyond LARGEST, or the
    greatest norms of a query and of a row allow a score beyond GREATEST, the call fails with an OverflowError; no row is
    left out for its size. An empty table gives an empty table, and other columns are not looked at.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), scale).alias("q")).where("id is not null and q is not null")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda total, v: total + v * v))
    size = F.aggregate("q", F.lit(0.0), lambda most, v: F.greatest(most, F.abs(v)))
    measured = rows.select("id", F.size("q").alias("width"), size.alias("size"), norm.alias("norm"))
    known = measured.agg(F.count("*"), F.max("width"), F.max("size"), F.max("norm"), F.max(F.when(F.col("id") % every == 0, F.col("norm")))).first()
    n, width, largest, longest, asks = (x or 0 for x in known)
    width = width or 1
    if largest > LARGEST or longest * asks > GREATEST:
        raise OverflowError(f"scores of these vectors may not fit a long: greatest code {largest:.6g}, norms {longest:.6g} and {asks:.6g}")
    rows = rows.withColumn("q", F.transform("q", lambda v: v.cast("long")))

    @tidy
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            block = Block(np.concatenate(ids), np.concatenate(values))
            wave = min(TaskContext.get().partitionId() % waves, 1)
            return pa.RecordBatch.from_arrays([pa.array([wave], pa.int32()), pa.array([block.pack()], pa.binary())], ["wave", "rows"])

        ids, values, held = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, min(BLOCK, batch.num_rows - lo))
                if held + part.num_rows > BLOCK:
                    yield packed()
                    ids, values, held = [], [], 0
                ids.append(part.column("id").to_numpy(zero_copy_only=False))
                values.append(_matrix(part.column("q"), width))
                held += part.num_rows
        if held:
            yield packed()

    @tidy
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES):
                part = batch.slice(lo, QUERIES)
                raw = np.concatenate([part.column("id").to_numpy(zero_copy_only=False)[:, None], _matrix(part.column("q"), width)], axis=1)
                name = TaskContext.get().partitionId() << 32 | k
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([raw.astype(np.int64).tobytes()], pa.binary())], ["asked", "queries"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // BLOCK))
    rows, waves = rows.coalesce(tasks), math.isqrt(tasks)
    # a file holds blocks of one wave, so the scan of a wave leaves out the others' row groups
    blocks = materialise(rows.mapInArrow(index, "wave int, rows binary"), "index")
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "q"]).mapInArrow(asked, "asked long, queries binary")
    queries = materialise(queries.select(F.xxhash64("asked").alias("h"), F.octet_length("queries").alias("size"), "queries"), "queries")
    runs = -(-(queries.agg(F.sum("size")).first()[0] or 0) // RUN_BYTES) or 1

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def found(run: int) -> DataFrame:
        own = queries.where(F.pmod("h", F.lit(runs)) == run).select("queries").collect()
        raw = np.concatenate([np.empty((0, width + 1), dtype=np.int64), *(np.frombuffer(r[0], dtype=np.int64).reshape(-1, width + 1) for r in own)])
        asks = raw[np.argsort(raw[:, 0], kind="stable")]
        floor = np.full(len(asks), np.iinfo(np.int64).min)
        first = searched(0, asks, floor)
        # a number for each query of the run
        for query, score in first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top).select("query_id", "score").collect():
            floor[slice(*np.searchsorted(asks[:, 0], [query, query + 1]))] = score
        return first.unionByName(searched(1, asks, floor))

    def searched(wave: int, asks: np.ndarray, floor: np.ndarray) -> DataFrame:
        """The best rows of each task of a wave for each query, without those below the query's floor."""
        shared = spark.sparkContext.broadcast((asks, floor))

        @tidy
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks, floor = shared.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64),) * 2] * len(asks)
            least = floor.copy()
            for batch in batches:
                for packed in batch.column("rows"):
                    block = Block.unpack(packed.as_py())
                    able = np.concatenate([np.flatnonzero(block.bound(asks[lo : lo + 4096, 1:]) >= least[lo : lo + 4096]) + lo for lo in range(0, len(asks), 4096)]) if len(asks) else ()
                    for lo in range(0, len(able), BATCH):
                        these = able[lo : lo + BATCH]
                        for i, (ids, scores) in zip(these.tolist(), block.search(asks[these, 1:], asks[these, 0], top), strict=True):
                            ids, scores = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], scores])
                            by_score = np.lexsort((ids, -scores))[:top]
                            by_score = by_score[scores[by_score] >= floor[i]]
                            best[i] = ids[by_score], scores[by_score]
                            if len(by_score) == top > 0:
                                least[i] = scores[by_score[-1]]
            size = [len(x) for x, _ in best]
            for lo in range(0, len(asks), 1024):
                part = best[lo : lo + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks[lo : lo + 1024, 0], size[lo : lo + 1024])), pa.array(np.concatenate([x for x, _ in part])), pa.array(np.concatenate([x for _, x in part]))], ["query_id", "vec_id", "score"])

        try:
            return materialise(blocks.where(F.col("wave") == wave).select("rows").mapInArrow(search, "query_id long, vec_id long, score long"), "best")
        finally:
            shared.unpersist()

    # a row holds a whole block, and small files shouldn't be put together in few tasks
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        best = found(0)
        for run in range(1, runs):
            best = best.unionByName(found(run))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def top_sql() -> str:
    """DuckDB SQL of top_inner_products() over the view embeddings, with the default parameters."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}"""
