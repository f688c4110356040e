import math

import numpy as np
import pytest

from subsidia.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, top=10, every=100):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)[:top]
            out += [(i, k, j, s) for k, (s, j) in enumerate(best, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def vectors(n, width=24, seed=0):
    return np.random.default_rng(seed).normal(0, 1, (n, width)).astype(np.float32)


def recall(found, true):
    x, y = ({(q, j) for q, _, j, _ in rows} for rows in (found, true))
    return len(x & y) / len(y)


@pytest.mark.parametrize("shard", [8192, 700])
def test_recall_and_exact_scores(spark, shard):
    x = vectors(3000)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got, want = rows_of(hnsw.nearest(spark.createDataFrame(rows, SCHEMA).repartition(2), every=20, shard=shard)), brute(rows, every=20)
    assert recall(got, want) > 0.97 and len(got) == len(want)
    for q, _, j, score in got:
        assert score == pytest.approx(math.dist(x[q].astype(float), x[j].astype(float)), abs=1e-12)
    by = {}
    for q, rank, j, score in got:
        by.setdefault(q, []).append((rank, score, j))
    assert all([r[0] for r in sorted(v)] == list(range(1, 11)) and [r[1:] for r in sorted(v)] == sorted(r[1:] for r in v) for v in by.values())


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = rows_of(hnsw.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    assert recall(got, brute(rows)) >= 0.95


def test_copies_are_one_node(spark):
    x = vectors(600, seed=2)
    x[200:500] = x[200]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = rows_of(hnsw.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert [r for r in got if r[0] in (200, 300)] == [r for r in brute(rows) if r[0] in (200, 300)]
    assert recall(got, brute(rows)) > 0.95


def test_awkward_rows(spark):
    x = vectors(30, 4, 3).tolist()
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(100, x[3], 0), (100, x[3], 0), (200, None, 0), (300, [0.0] * 4, 0), (400, [math.nan, 1.0, 1.0, 1.0], 0), (500, [None, 1.0, 1.0, 1.0], 0), (600, [math.inf, 1.0, 1.0, 1.0], 0), (None, x[0], 0), (7, x[7], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(set(brute(rows)))
    got = rows_of(hnsw.nearest(df))
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    wide = df.selectExpr("*", *(f"'z' AS `{c}`" for c in ("id", "v", "ask", "score", "rank", "run", "shard", "ids", "query_id")))
    assert rows_of(hnsw.nearest(wide)) == got
    assert hnsw.nearest(df.limit(0)).count() == 0
    few = rows_of(hnsw.nearest(spark.createDataFrame([(0, [1.0, 2.0], 0), (5, [1.0], 0)], SCHEMA)))
    assert few == [(0, 1, 5, 2.0)]


def test_runs_of_queries(spark, monkeypatch):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors(400, 8))]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = rows_of(hnsw.nearest(df, every=10))
    monkeypatch.setattr(hnsw, "RUN_BYTES", 1000)
    assert rows_of(hnsw.nearest(df, every=10)) == whole


def test_every_node_can_be_found():
    x = vectors(2000, 16, 5)
    graph = hnsw.Graph(x)
    found = graph.search(x, 12)
    assert np.mean(found[:, 0] == np.arange(len(x))) > 0.995
    tables = graph.neighbours
    assert len(tables[0]) == len(x) and all(len(a) >= len(b) for a, b in zip(tables, tables[1:], strict=False))
    assert all(t.max() < len(t) and (np.arange(len(t))[:, None] != t).all() for t in tables)
    assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for t in tables for r in t)
