"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are merged first. The sets that are left get signatures of BANDS x ROWS minimum
hashes; those that agree on a band share a bucket. Each bucket links its members to its least one, then once more, where
several components are left in it, to one picked by a hash: both rounds give as many pairs as a bucket has members. A
pair's signatures are compared a batch of hashes at a time, and the pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls under MISS. What survives is verified on full sets.

The last round loses no link of a bucket. Sets that can't have one are peeled off first, again and again, since each that
goes leaves others with less in common: two sets of a and b shingles need PERCENT / (100 + PERCENT) of a + b in common,
and a set meets no other in more than those of its shingles that another set of the round holds too. b is at least the
least size that a set of another component has in the set's buckets within the threshold's reach. Then the members of a
bucket outside its largest component ask all members, in blocks of a bounded number of shingles. A block emits links,
never pairs; rows are read once for each block of the other side.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import SPACE_BYTES, bounded_batches, gram_hashes, hash_words, materialise, text_chunks, tidy, word_table
from .components import BROADCAST_IDS, components

WORDS = 5
#: Similarity as a fraction: links have PERCENT * union <= 100 * intersection.
PERCENT = 75
#: A pair at the threshold misses every band with probability (1 - 0.75 ** ROWS) ** BANDS, here 2e-5.
BANDS, ROWS = 40, 5
#: Hashes compared at a time, and the posterior probability under which a pair is dropped.
BATCH, MISS = 40, 1e-8
#: Shingles that a block of the last round holds, on average, on each side.
BLOCK_SHINGLES = 100_000
#: Sizes of sets are told apart in steps of this factor; while a bucket needs several blocks, sets are peeled off as long
#: as a share of 1 / PEEL of them goes.
SIZE_STEP, PEEL = 1.02, 8
_SPACES = word_table(SPACE_BYTES)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(buf: np.ndarray, cuts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; fewer words than a shingle count as one."""
    s, _, h = hash_words(buf, cuts, _SPACES)
    at = np.searchsorted(s, cuts)
    all_grams = gram_hashes(h, words)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(all_grams[lo : hi - words + 1]))
        else:
            out.append(gram_hashes(h[lo:hi], hi - lo) if hi > lo else np.empty(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minimum hashes of each of some non-empty sets."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.r_[0, np.cumsum([len(x) for x in sets])[:-1]]
    a, b = _coefficients(n)
    out, held = np.empty((n, len(sets)), dtype=np.uint32), np.empty_like(flat)
    for i in range(n):
        np.multiply(flat, a[i], out=held)
        np.add(held, b[i], out=held)
        out[i] = np.minimum.reduceat(held, starts)
    return out.T.copy()


@lru_cache
def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest matches among n hashes with P(similarity >= threshold | matches) >= miss, from a uniform prior."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):  # P(s >= t | m of n) = P(Binomial(n + 1, t) <= m)
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def _sketch(docs: DataFrame, words: int, n: int) -> DataFrame:
    """(key, tag, n, digest, sig) of docs(key, tag, text): the size, digest and signature of each row's set."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, cuts in text_chunks(batch, "text", 1 << 20):
                sets = shingle_sets(buf, cuts, words)
                full = [x for x in sets if len(x)]
                sig = iter(signatures(full, n)) if full else iter(())
                digest = [hashlib.blake2b(x, digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("key", "tag")), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([next(sig).tobytes() if len(x) else None for x in sets], pa.binary())],
                    ["key", "tag", "n", "digest", "sig"],
                )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "tag", "text").mapInArrow(run, f"key {kind}, tag long, n long, digest binary, sig binary")


def _buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node): a row for each band of each node."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, bands, rows)
            salt = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(33)
            for k in range(0, batch.num_rows, 500):
                part = sig[k : k + 500].astype(np.uint64)
                acc = np.broadcast_to(salt, part.shape[:2]).copy()
                for j in range(rows):
                    acc = gram_hashes(np.stack([acc.ravel(), part[:, :, j].ravel()], axis=1).ravel(), 2)[::2].reshape(acc.shape)
                ids = batch.column("node").slice(k, 500).take(pa.array(np.repeat(np.arange(len(part)), bands)))
                yield pa.RecordBatch.from_arrays([pa.array(acc.ravel().view(np.int64)), ids], ["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, node long")


def _prune(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float, batch_size: int) -> DataFrame:
    """Pairs that the sequential test keeps."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            alive, matches, seen = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), 0
            while seen < x.shape[1] and len(alive):
                cut = slice(seen, min(seen + batch_size, x.shape[1]))
                matches[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
                seen = cut.stop
                alive = alive[matches[alive] >= least_matches(seen, percent, miss)]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    sig = nodes.select("node", "sig")
    joined = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sb"}), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _near(ids: DataFrame) -> tuple[DataFrame, int]:
    """ids, to be broadcast where their number and their columns of fixed size bound them, and that number."""
    n = ids.count()
    return (F.broadcast(ids) if n <= BROADCAST_IDS and not any(kind in ("string", "binary") for _, kind in ids.dtypes) else ids), n


def _sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles binary) of the nodes in ids(node), from the row of docs(key, tag, text) that stands for each."""

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, cuts in text_chunks(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array([x.tobytes() for x in shingle_sets(buf, cuts, words)], pa.binary())], ["node", "shingles"])

    wanted = materialise(nodes.join(ids.distinct(), "node", "left_semi").select("node", F.col("rep.key").alias("k"), F.col("rep.tag").alias("t")), "wanted")
    near, n = _near(wanted)
    found = docs.join(near, docs["key"].eqNullSafe(near["k"]) & (docs["tag"] == near["t"])).select("node", "text")
    full = materialise(found.mapInArrow(sets, "node long, shingles binary"), "shingles")
    if full.count() > n:  # a whole row occurs more than once
        full = materialise(full.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    return full


def _shared(full: DataFrame) -> DataFrame:
    """(node, n, f): the size of each set and how many of its shingles another set holds too."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                own = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in part.column("shingles")]
                ids = part.column("node").take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(own))], ["node", "shingle"])

    sizes = full.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    once = full.mapInArrow(rows, "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    own = once.groupBy("node").agg(F.count("*").alias("u"))
    return sizes.join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("f"))


def _able(rest: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, root, n) of the rows of rest(bucket, node, root) whose sets can still have a link to another root of a bucket.

    full: their shingles. Each round is linear in what is left, and leaves at most 1 - 1 / PEEL of it to the next. The rows
    of the buckets get their sizes once; after that a round takes from them what has gone, and reads only what is left.
    """
    reach = math.ceil(math.log(100 / percent) / math.log(SIZE_STEP)) + 1
    near = Window.partitionBy("bucket").orderBy("c").rangeBetween(-reach, reach)
    alive, before = full.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n")), None
    rows = rest.join(alive, "node").withColumn("c", F.floor(F.log("n") / math.log(SIZE_STEP)))
    while True:
        alive = materialise(alive, "alive")
        left = alive.count()
        rows = materialise(rows if before is None else rows.join(alive.select("node"), "node", "left_semi"), "able")
        several = rows.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK_SHINGLES)
        if left == 0 or (before is not None and (PEEL * (before - left) < before or several.isEmpty())):
            return rows.select("bucket", "node", "root", "n")
        before = left
        # a row for each size of a bucket, so the window has a bounded number of rows however many sets the bucket has
        classes = rows.groupBy("bucket", "c").agg(F.min("n").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        classes = classes.select("bucket", "c", *(f(x).over(near).alias(x) for x, f in (("least", F.min), ("lo", F.min), ("hi", F.max)))).where("lo <> hi")
        partners = rows.join(classes.select("bucket", "c", "least"), ["bucket", "c"]).groupBy("node").agg(F.min("least").alias("least"))
        shared = _shared(full.join(alive.select("node"), "node", "left_semi"))
        alive = shared.join(partners, "node").where(F.expr(f"{100 + percent} * f >= {percent} * (n + least) AND 100 * f >= {percent} * n")).select("node", "n")


def _confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold. full: those of all nodes of the pairs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(full.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(full.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _across(able: DataFrame, payload: DataFrame, percent: int, miss: float, batch_size: int) -> DataFrame:
    """(a, b): for each able(bucket, node, root, n) and each other root that it links to in a bucket, such a link.

    payload: shingles and sig of each node.
    """
    by_root = able.groupBy("bucket", "root").agg(F.sum("n").alias("n"))
    sizes = by_root.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("n").alias("every"), F.max(F.struct("n", "root")).alias("main")).where("roots > 1")
    sizes = sizes.select("bucket", F.col("main")["root"].alias("main"), F.ceil(F.col("every") / BLOCK_SHINGLES).alias("ci"), F.ceil((F.col("every") - F.col("main")["n"]) / BLOCK_SHINGLES).alias("cq"))
    rows = materialise(able.join(sizes, "bucket"), "across")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).alias("own")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = rows.where("root <> main").select("bucket", "node", "root", part("cq"), each("ci").alias("i")).select("bucket", F.col("own").alias("q"), "i", "node", "root", F.lit(True).alias("asks"))
    index = rows.select("bucket", "node", "root", part("ci"), each("cq").alias("q")).select("bucket", "q", F.col("own").alias("i"), "node", "root", F.lit(False).alias("asks"))
    blocks = asked.unionByName(index).join(payload, "node")

    def run(table: pa.Table) -> pa.Table:
        node, root = table.column("node").to_pylist(), table.column("root").to_pylist()
        sig = np.stack([np.frombuffer(x, dtype=np.uint32) for x in table.column("sig").to_pylist()])
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        asks = np.array(table.column("asks").to_pylist(), dtype=bool)
        names = {r: i for i, r in enumerate(dict.fromkeys(root))}
        group = np.array([names[r] for r in root])
        questions, rows = np.flatnonzero(asks), np.flatnonzero(~asks)
        n = np.array([len(x) for x in sets])
        flat = np.concatenate([sets[j] for j in rows]) if len(rows) else np.empty(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(rows)), n[rows])[order]
        found = []
        for q in questions.tolist():
            alive = np.flatnonzero((group[rows] != group[q]) & (100 * np.minimum(n[rows], n[q]) >= percent * np.maximum(n[rows], n[q])))
            matches, seen = np.zeros(len(rows), dtype=np.int64), 0
            while seen < sig.shape[1] and len(alive):
                cut = slice(seen, min(seen + batch_size, sig.shape[1]))
                matches[alive] += (sig[rows[alive], cut] == sig[q, cut]).sum(axis=1)
                seen = cut.stop
                alive = alive[matches[alive] >= least_matches(seen, percent, miss)]
            if not len(alive):
                continue
            lo, hi = np.searchsorted(flat, sets[q], "left"), np.searchsorted(flat, sets[q], "right")
            size = hi - lo
            take = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            both = np.bincount(owner[take], minlength=len(rows))[alive]
            linked = alive[100 * both >= percent * (n[q] + n[rows[alive]] - both)]
            for j in linked[np.unique(group[rows[linked]], return_index=True)[1]].tolist():
                found.append((node[q], node[rows[j]]))
        return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return materialise(blocks.groupBy("bucket", "q", "i").applyInArrow(run, "a long, b long"), "links")


def _linked(docs: DataFrame, words: int, percent: int, bands: int, rows: int, miss: float, batch: int) -> tuple[DataFrame, DataFrame]:
    """(key, tag, n, digest) of every row of docs(key, tag, text), and (digest, rep) of every set.

    rep(late, key, tag) is the first row of a set's component: the least key, then the least tag; null keys come last.
    """
    bounded_batches(docs.sparkSession)
    sketches = materialise(_sketch(docs, words, bands * rows), "sketches")
    row = F.struct(F.col("key").isNull().alias("late"), "key", "tag")
    nodes = sketches.where("n > 0").groupBy("digest").agg(F.min(row).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        kept = materialise(_prune(pairs, nodes, percent, miss, batch), "pairs")
        full = _sets(kept.select(F.col("a").alias("node")).unionByName(kept.select(F.col("b").alias("node"))), nodes, docs, words)
        return materialise(_confirm(kept, full, percent), "links")

    def grown(roots: DataFrame, links: DataFrame) -> DataFrame:
        return roots if links.isEmpty() else components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    def split(members: DataFrame, roots: DataFrame) -> DataFrame:
        """(bucket, node, root) of the buckets that still hold several components."""
        found = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        found = materialise(found, "members")
        several = found.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        return materialise(found.join(several, "bucket", "left_semi"), "members")

    members = _buckets(nodes, bands, rows)
    heads = materialise(members.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1"), "heads")
    roots = components(verified(members.join(heads, "bucket").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()))
    # every pair with a bucket's least member is decided: pairs of its other members are left
    rest = split(members.join(heads.where("size > 2"), "bucket").where("node <> head"), roots)
    if not rest.isEmpty():
        picked = rest.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("head"), F.col("root").alias("own"))).alias("p")).select("bucket", "p.head", "p.own")
        roots = grown(roots, verified(rest.join(picked, "bucket").where("root <> own").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()))
        rest = split(rest, roots)
    if not rest.isEmpty():
        full = _sets(rest.select("node"), nodes, docs, words)
        able = _able(rest, full, percent)
        wanted = nodes.select("node", "sig").join(able.select("node").distinct(), "node", "left_semi")
        payload = materialise(full.join(wanted, "node"), "payload")
        roots = grown(roots, _across(able, payload, percent, miss, batch))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    own = materialise(roots.join(nodes.select("node", "digest", "rep"), "node").select("digest", "root", "rep"), "linked")
    first = own.groupBy("root").agg(F.min("rep").alias("rep"))
    linked = own.select("digest", "root").join(first, "root").select("digest", "rep")
    alone = nodes.select("digest", "rep").join(own.select("digest"), "digest", "left_anti")
    return sketches.select("key", "tag", "n", "digest"), linked.unionByName(alone)


def _prepared(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).select("key", F.xxhash64("text").alias("tag"), "text")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, batch: int = BATCH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Words are what lies between ASCII white space, with A-Z in lower case; a text of fewer words than a shingle is one
    shingle. A null, empty or blank text has no shingles and is linked with nothing. component_id is the least key that
    links reach, kept says whether it is the row's own. Rows with a null key link others as all rows do; where no row of
    the component has a key, component_id is null, and kept is false. Repeated rows share a component; rows that repeat a
    key with another text are linked each by its own text. An empty table gives an empty table, and other columns of
    docs are not looked at.
    """
    sketches, sets = _linked(_prepared(docs, text, key), words, percent, bands, rows, miss, batch)
    found = sketches.join(sets.select("digest", F.col("rep.key").alias("least")), "digest", "left")
    found = found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, batch: int = BATCH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, without those that are near-duplicates of a row that stays.

    Of each component the row of least key stays (null keys come last; of several texts under that key the one of least
    hash), and one row where that row is repeated. Rows without shingles stay all.
    """
    rows_of = _prepared(docs, text, key)
    sketches, sets = _linked(rows_of, words, percent, bands, rows, miss, batch)
    rows_of = materialise(sketches.where("n > 0").join(sets, "digest").select("key", "tag", (F.col("key").eqNullSafe(F.col("rep.key")) & (F.col("tag") == F.col("rep.tag"))).alias("first")), "rows")
    same = lambda ids: docs[key].eqNullSafe(ids["k"]) & (F.xxhash64(docs[text].cast("string")) == ids["t"])

    def joined(ids: DataFrame, how: str) -> DataFrame:
        ids = _near(materialise(ids, "ids"))[0]
        return docs.join(ids, same(ids), how)

    copies = rows_of.where("not first").select(F.col("key").alias("k"), F.col("tag").alias("t")).distinct()
    repeated = rows_of.where("first").groupBy(F.col("key").alias("k"), F.col("tag").alias("t")).count().where("count > 1").select("k", "t")
    if repeated.isEmpty():
        return joined(copies, "left_anti")
    others = joined(copies.unionByName(repeated), "left_anti")
    return others.unionByName(joined(repeated, "left_semi").dropDuplicates([key, text]))
