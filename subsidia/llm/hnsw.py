"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

A shard is a run of rows of one task, at most SHARD of them. Its graph has levels; level l holds the nodes whose drawn
level is l or more, each with a row of a flat array of neighbours (-1: none). Nodes go in by batches no larger than what is
there: a batch searches the graph all at once and also meets itself, then every node keeps those neighbours that are
nearer to it than to neighbours kept before, and offers itself to them. Vectors that are wholly alike are one node,
which keeps as many of their least ids as a result can need, so copies neither form islands nor fill neighbour lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, materialise, tidy

TOP, EVERY = 10, 100
#: Vectors of a shard, neighbours of a node (twice as many on the lowest level), lengths of the search's lists.
SHARD, LINKS, BUILD, SEARCH = 8192, 16, 64, 100
#: Bytes of queries that are broadcast at once, and queries that are searched at once.
RUN_BYTES, BATCH = 32 << 20, 256


def distances(x: np.ndarray, norms: np.ndarray, who: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Squared distances, less the squared norm of each asking vector, from asks[i] to the vectors who[i, :] (-1: none)."""
    found = norms[who] - 2 * np.matmul(x[who], asks[:, :, None])[:, :, 0]
    found[who < 0] = np.inf
    return found


class Graph:
    """Vectors in single precision, the level of each, and for each level the places of its nodes and their neighbours."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 7):
        self.x, self.links = np.ascontiguousarray(vectors, dtype=np.float32), links
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum(-np.log(1 - rng.random(n)) / np.log(links), 12).astype(np.int64)
        # the first node stands on every level, so a search always begins at it
        order = np.argsort(-level, kind="stable")
        self.level = level[order]
        self.x, self.norms, self.order = self.x[order], self.norms[order], order
        self.neighbours = [np.full((int((self.level >= k).sum()), links * (1 if k else 2)), -1, dtype=np.int32) for k in range(int(self.level[0]) + 1 if n else 0)]
        for k in reversed(range(len(self.neighbours))):
            self._fill(k, len(self.neighbours[k]), build)

    def _fill(self, level: int, n: int, build: int) -> None:
        """Link the nodes of a level, the first n ones: those of the levels above come first, so they guide the search."""
        done = 1
        while done < n:
            batch = np.arange(done, min(n, 2 * done, done + BATCH))
            starts = self._descend(self.x[batch], level, done)
            near, far = self._beam(self.x[batch], starts, level, build)
            own = self.x[batch] @ self.x[batch].T
            own = self.norms[batch][None, :] - 2 * own
            np.fill_diagonal(own, np.inf)
            keep = min(len(batch), build)
            mine = np.argpartition(own, keep - 1, axis=1)[:, :keep]
            who = np.concatenate([near, batch[mine].astype(np.int32)], axis=1)
            how = np.concatenate([far, np.take_along_axis(own, mine, axis=1)], axis=1)
            who[~np.isfinite(how)] = -1
            self._link(level, batch, who, how)
            done = int(batch[-1]) + 1

    def _chosen(self, asks: np.ndarray, who: np.ndarray, how: np.ndarray, most: int) -> np.ndarray:
        """Of who[i, :] at how[i, :] from asks[i] up to most, each nearer to the asking vector than to those taken before.

        Where places are left, the nearest of the others fill them.
        """
        order = np.argsort(how, axis=1, kind="stable")[:, : 4 * most]
        who, how = np.take_along_axis(who, order, axis=1), np.take_along_axis(how, order, axis=1)
        out = np.full((len(asks), most), -1, dtype=np.int32)
        to_ask = how + self.norms_of(asks)[:, None]
        points = self.x[who]
        between = self.norms[who][:, :, None] + self.norms[who][:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        taken, count = np.zeros(who.shape, dtype=bool), np.zeros(len(asks), dtype=np.int64)
        for j in range(who.shape[1]):
            clear = ~(taken & (between[:, j, :] < to_ask[:, j, None])).any(axis=1) & (who[:, j] >= 0) & (count < most)
            taken[clear, j] = True
            count += clear
        rest = np.argsort(np.where(who < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
        own = np.take_along_axis(who, rest, axis=1)
        out[:, : own.shape[1]] = own
        return out

    def norms_of(self, asks: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", asks, asks)

    def _link(self, level: int, batch: np.ndarray, who: np.ndarray, how: np.ndarray) -> None:
        table = self.neighbours[level]
        table[batch] = self._chosen(self.x[batch], who, how, table.shape[1])
        # each chosen node is offered those that chose it: old neighbours and offers are chosen from again
        a, b = np.repeat(batch, table.shape[1]).astype(np.int32), table[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        nodes, first, size = np.unique(b, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), BATCH):
            these, n = nodes[lo : lo + BATCH], size[lo : lo + BATCH]
            offers = np.full((len(these), int(n.max())), -1, dtype=np.int32)
            column = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = first[lo]
            offers[np.repeat(np.arange(len(these)), n), column] = a[at : at + int(n.sum())]
            offers[(offers[:, :, None] == table[these][:, None, :]).any(axis=2)] = -1
            both = np.concatenate([table[these], offers], axis=1)
            table[these] = self._chosen(self.x[these], both, distances(self.x, self.norms, both, self.x[these]), table.shape[1])

    def _descend(self, asks: np.ndarray, level: int, n: int) -> np.ndarray:
        """The nearest node that a greedy walk through the levels above finds for each, among the first n."""
        at = np.zeros(len(asks), dtype=np.int32)
        for k in range(len(self.neighbours) - 1, level, -1):
            if len(self.neighbours[k]) <= n:  # a whole level
                at = self._beam(asks, at, k, 1)[0][:, 0]
        return at

    def _beam(self, asks: np.ndarray, starts: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The width nearest nodes that a search of one level finds for each, and how far; all searches step together."""
        table, rows = self.neighbours[level], np.arange(len(asks))
        seen = np.zeros((len(asks), len(table) + 1), dtype=bool)  # the last column is for no node
        seen[:, -1] = True
        seen[rows, starts] = True
        who, open_ = np.full((len(asks), width), -1, dtype=np.int32), np.zeros((len(asks), width), dtype=bool)
        how = np.full((len(asks), width), np.inf, dtype=np.float32)
        who[:, 0], open_[:, 0] = starts, True
        how[:, 0] = distances(self.x, self.norms, who[:, :1], asks)[:, 0]
        live = rows
        while len(live):
            step = np.where(open_[live], how[live], np.inf).argmin(axis=1)
            open_[live, step] = False
            near = table[who[live, step]]
            near = np.where(seen[live[:, None], near], -1, near)
            seen[live[:, None], near] = True
            far = distances(self.x, self.norms, near, asks[live])
            all_who, all_how = np.concatenate([who[live], near], axis=1), np.concatenate([how[live], far], axis=1)
            all_open = np.concatenate([open_[live], near >= 0], axis=1)
            order = np.argpartition(all_how, width - 1, axis=1)[:, :width]
            who[live], how[live], open_[live] = (np.take_along_axis(v, order, axis=1) for v in (all_who, all_how, all_open))
            live = live[open_[live].any(axis=1)]
        order = np.argsort(how, axis=1, kind="stable")
        return np.take_along_axis(who, order, axis=1), np.take_along_axis(how, order, axis=1)

    def search(self, asks: np.ndarray, width: int = SEARCH) -> np.ndarray:
        """Places, in the vectors as given, of up to width near ones of each asking vector; -1 where there are none left."""
        asks = np.ascontiguousarray(asks, dtype=np.float32)
        if not len(self.x):
            return np.full((len(asks), width), -1, dtype=np.int64)
        found = self._beam(asks, self._descend(asks, 0, len(self.x)), 0, width)[0]
        return np.where(found < 0, -1, self.order[found])


def collapsed(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, where the ids of each begin, and the ids: the least ones of each vector, at most so many."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    rows = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, node = np.unique(rows, return_index=True, return_inverse=True)
    by = np.argsort(node, kind="stable")
    place = np.arange(len(by)) - np.searchsorted(node[by], node[by])
    by = by[place < most]
    return vectors[first], np.searchsorted(node[by], np.arange(len(first) + 1)), ids[by]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors in double precision, shorter ones padded with zeros; -0.0 becomes 0.0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out + 0.0


INDEX = "shard long, ids array<long>, starts array<int>, vectors binary, order array<int>, sizes array<int>, links int, neighbours array<int>"


def _packed(shard: int, ids: np.ndarray, vectors: np.ndarray, most: int, links: int, build: int) -> pa.RecordBatch:
    distinct, starts, kept = collapsed(ids, vectors, most)
    graph = Graph(distinct, links, build)
    flat = np.concatenate([t.ravel() for t in graph.neighbours])
    columns = {
        "shard": pa.array([shard], pa.int64()), "ids": pa.array([kept], pa.list_(pa.int64())), "starts": pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
        "vectors": pa.array([distinct.tobytes()], pa.binary()), "order": pa.array([graph.order.astype(np.int32)], pa.list_(pa.int32())),
        "sizes": pa.array([np.array([len(t) for t in graph.neighbours], dtype=np.int32)], pa.list_(pa.int32())), "links": pa.array([links], pa.int32()), "neighbours": pa.array([flat], pa.list_(pa.int32())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _unpacked(row: dict, width: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph, its vectors in double precision, where the ids of each begin, and the ids."""
    vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, width)
    graph, at = Graph.__new__(Graph), 0
    graph.links, graph.order, graph.neighbours = row["links"], np.array(row["order"], dtype=np.int64), []
    graph.x = np.ascontiguousarray(vectors[graph.order], dtype=np.float32)
    graph.norms = np.einsum("ij,ij->i", graph.x, graph.x)
    flat = np.array(row["neighbours"], dtype=np.int32)
    for k, n in enumerate(row["sizes"]):
        wide = row["links"] * (1 if k else 2)
        graph.neighbours.append(flat[at : at + n * wide].reshape(n, wide))
        at += n * wide
    return graph, vectors, np.array(row["starts"], dtype=np.int64), np.array(row["ids"], dtype=np.int64)


def build_index(vectors: DataFrame, width: int, most: int = TOP + 1, shard: int = SHARD, links: int = LINKS, build: int = BUILD) -> DataFrame:
    """A row of INDEX for each shard of vectors(id long, v array<double> of at most width): nothing is shuffled."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held, made, step = [], [], 0, 0, min(1024, shard)

        def packed() -> pa.RecordBatch:
            return _packed(TaskContext.get().partitionId() << 32 | made, np.concatenate(ids), np.concatenate(values), most, links, build)

        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                if held + part.num_rows > shard:
                    yield packed()
                    ids, values, held, made = [], [], 0, made + 1
                ids.append(part.column("id").to_numpy(zero_copy_only=False))
                values.append(_matrix(part.column("v"), width))
                held += part.num_rows
        if held:
            yield packed()

    return materialise(vectors.mapInArrow(run, INDEX), "graphs")


def _best(asks: tuple[np.ndarray, np.ndarray], row: dict, width: int, top: int, search: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, distance) of the nearest of a shard for batches of the asking (ids, vectors)."""
    graph, vectors, starts, ids = _unpacked(row, width)
    for lo in range(0, len(asks[0]), BATCH):
        name, q = asks[0][lo : lo + BATCH], asks[1][lo : lo + BATCH]
        found = graph.search(q, max(search, top + 1))
        who, node = np.nonzero(found >= 0)
        node = found[who, node]
        score = np.sqrt(((vectors[node] - q[who]) ** 2).sum(axis=1))
        n = starts[node + 1] - starts[node]
        who, score = np.repeat(who, n), np.repeat(score, n)
        one = ids[np.repeat(starts[node] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        other = one != name[who]
        who, one, score = who[other], one[other], score[other]
        order = np.lexsort((one, score, who))
        who, one, score = who[order], one[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < top
        yield who[keep] + lo, one[keep], score[keep]


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, vector: str = "embedding", key: str = "vec_id", shard: int = SHARD, links: int = LINKS, build: int = BUILD, search: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each key divisible by every, the top nearest rows found, by Euclidean distance.

    Scores are computed in double precision from the original vectors; equal ones go to the smaller key. Vectors that are
    null, zero or hold a null or a non-finite component take no part, nor do those with a null key; a shorter vector
    counts as padded with zeros. Rows that repeat a key are candidates each, but not for queries of that key, whose
    repeats with one vector count once. An empty table gives an empty table, and other columns are not looked at.
    Queries are broadcast in runs of a bounded size, each of which meets every shard; a task sends the best of its shards.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    width, n = (x or 1 for x in rows.agg(F.max(F.size("v")), F.count("*")).first())
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in own}
    parts = -(-n // shard)
    index = build_index(rows.coalesce(max(parts, spark.sparkContext.defaultParallelism)), width, top + 1, shard, links, build)
    queries = materialise(rows.where(F.col("id") % every == 0).distinct(), "queries")
    runs = -(-queries.count() * (width + 1) * 8 // RUN_BYTES) or 1

    def found(run: int) -> DataFrame:
        asked = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(runs)) == run).toArrow()
        names = asked.column("id").to_numpy()
        shared = spark.sparkContext.broadcast((names, _matrix(asked.column("v").combine_chunks(), width)))

        @tidy
        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks, held = shared.value, None
            for batch in batches:
                for row in batch.to_pylist():
                    best = [np.concatenate(x) for x in zip(*_best(asks, row, width, top, search), strict=True)]
                    if not best:
                        continue
                    if held:
                        best = [np.concatenate(x) for x in zip(held, best, strict=True)]
                        order = np.lexsort((best[1], best[2], best[0]))
                        best = [x[order] for x in best]
                        keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < top
                        best = [x[keep] for x in best]
                    held = best
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(asks[0][held[0]]), pa.array(held[0], pa.int64()), pa.array(held[1]), pa.array(held[2])], ["query_id", "ask", "vec_id", "score"])

        try:
            return materialise(index.mapInArrow(meet, "query_id long, ask long, vec_id long, score double"), "nearest")
        finally:
            shared.unpersist()

    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        best = [found(run).withColumn("run", F.lit(run)) for run in range(runs)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    every_run = best[0]
    for one in best[1:]:
        every_run = every_run.unionByName(one)
    order = Window.partitionBy("query_id", "run", "ask").orderBy("score", "vec_id")
    return every_run.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
