import math

import numpy as np
import pytest

from subsidia.llm import bit_slices


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, top=20, every=20):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:top]
            out += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bit_slices, "QUERIES", 7)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 12).round(1).tolist(), 0) for i in range(500)]
    rows += [(600, rows[0][1], 0), (601, rows[0][1], 0), (620, [0.0] * 12, 0), (640, [-1.0] * 12, 0), (660, [0.5], 0)]
    rows += [(700, None, 0), (720, [math.nan] * 12, 0), (740, [math.inf] + [0.0] * 11, 0), (None, [1.0] * 12, 0)]
    short = [(i, (v + [0.0] * 12)[:12] if v else v, x) for i, v, x in rows]
    for run_bytes, block in ((1 << 25, 8192), (1000, 40)):
        monkeypatch.setattr(bit_slices, "RUN_BYTES", run_bytes)
        monkeypatch.setattr(bit_slices, "BLOCK", block)
        got = sorted(tuple(r) for r in bit_slices.top_inner_products(frame(spark, rows)).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(short)


def test_later_tasks_send_what_reaches_the_floor(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.2, 8).tolist(), 0) for i in range(2400)]
    sent, plain = [], bit_slices.materialise

    def counted(df, name):
        out = plain(df, name)
        sent.extend([out.count()] if name == "best" else [])
        return out

    monkeypatch.setattr(bit_slices, "materialise", counted)
    monkeypatch.setattr(bit_slices, "BLOCK", 100)
    got = sorted(tuple(r) for r in bit_slices.top_inner_products(frame(spark, rows).repartition(24)).select("query_id", "rank", "vec_id", "score").collect())
    # each fourth block is searched first; the four tasks of either wave would send 20 rows a query without a floor
    assert got == brute(rows) and sent[0] == 4 * 20 * 120 and sent[1] < 0.9 * sent[0]


def test_few_rows_nulls_and_none(spark):
    rows = [(0, [1.0, -2.0], 0), (1, [1.0, 1.0], 0), (2, [None, 1.0], 0)]
    df = frame(spark, rows).selectExpr("*", "1 AS id", "2 AS q", "3 AS score", "4 AS rank")
    assert [tuple(r) for r in bit_slices.top_inner_products(df).collect()] == [(0, 1, 1, 64 * 64 - 128 * 64)]
    assert bit_slices.top_inner_products(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(0, [1.0], 0), (0, [1.0], 0), (3, [0.5], 0), (3, [0.5], 0)]
    got = [tuple(r) for r in bit_slices.top_inner_products(frame(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2048), (0, 2, 3, 2048)]


def test_block_sums_are_exact():
    rng = np.random.default_rng(3)
    v, q = rng.integers(-40, 40, (130, 9)), rng.integers(-40, 40, (5, 9))
    block = bit_slices.Block.unpack(bit_slices.Block(np.arange(130), v).pack())
    for (ids, score), want in zip(block.search(q, np.arange(5), 200), q @ v.T, strict=True):
        assert dict(zip(ids.tolist(), score.tolist(), strict=True)) == {i: s for i, s in enumerate(want.tolist()) if i not in (int(np.flatnonzero((q @ v.T == want).all(axis=1))[0]),)}


def test_bounds_hold_and_pass_over_blocks():
    rng = np.random.default_rng(4)
    q = rng.integers(-40, 40, (6, 9))
    great, small = (bit_slices.Block(np.arange(50), rng.integers(-n, n + 1, (50, 9))) for n in (900, 2))
    for block in (great, small):
        best = np.array([max(s) for _, s in block.search(q, np.full(6, -1), 50)])
        assert (block.bound(q) >= best).all()
    kth = np.array([sorted(s)[-3] for _, s in great.search(q, np.full(6, -1), 50)])
    assert (small.bound(q) < kth).all()


def test_great_components_take_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 4).round(1).tolist(), 0) for i in range(60)]
    rows += [(60, [2e6, -1.0, 0.0, 0.5], 0), (61, [-3e6, 0.5, 1.0, 2e6], 0), (62, [2.0**23, 0.0, -(2.0**22), 1.0], 0)]
    got = sorted(tuple(r) for r in bit_slices.top_inner_products(frame(spark, rows)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows) and {61, 62} <= {r[2] for r in got} and 60 in {r[0] for r in got}
    for great in (2.0**30, 1e37):
        with pytest.raises(OverflowError):
            bit_slices.top_inner_products(frame(spark, [(0, [great], 0), (1, [great], 0)]))
