import hashlib
import json
import math
import os
import struct

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from subsidia.functions import geometry
from subsidia.functions.geometry import Grid
from subsidia.operators import folds, located, release, sketches
from subsidia.sources import blocks, files, rasters, scratch
from subsidia.sources.pixels import order_pixels
from subsidia.streaming import histories


BLOCK = "pixel_id div 200 AS block_id"


def parts_of(reader, *filters):
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return reader.partitions()


@pytest.fixture(scope="module")
def block_path(spark, sf_dir):
    path = scratch.folder(spark, "blocks")
    rows = order_pixels(spark, sf_dir).selectExpr(BLOCK, "pixel_id", "obs_sin", "mask", "CASE WHEN pixel_id % 3 = 0 THEN obs_cos END AS sparse")
    blocks.write_blocks(rows, path)
    return path


def test_blocks_give_back_what_was_stored(spark, sf_dir, block_path):
    want = order_pixels(spark, sf_dir).select("pixel_id", F.when(F.col("pixel_id") % 3 == 0, F.col("obs_cos")).alias("sparse"), "mask")
    got = blocks.read_blocks(spark, block_path, "pixel_id long, sparse double, mask int")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert blocks.read_blocks(spark, block_path, "pixel_id long").count() == want.count()


def test_filters_skip_blocks(spark, sf_dir, block_path):
    schema = blocks.read_blocks(spark, block_path, "block_id long, pixel_id long").schema
    ids = sorted(r[0] for r in order_pixels(spark, sf_dir).selectExpr(BLOCK).distinct().collect())
    reader = lambda: blocks.BlockReader(block_path, schema)
    assert len(reader().partitions()) == len(ids)
    assert len(parts_of(reader(), EqualTo(("block_id",), ids[1]))) == 1
    assert len(parts_of(reader(), In(("block_id",), (ids[0], ids[2], -5)))) == 2
    assert len(parts_of(reader(), GreaterThan(("block_id",), ids[1]))) == len(ids) - 2
    assert len(parts_of(reader(), LessThanOrEqual(("pixel_id",), -1))) == 0
    rows = blocks.read_blocks(spark, block_path, schema).where(F.col("block_id") == ids[1])
    assert rows.rdd.getNumPartitions() == 1 and rows.count() > 0


def test_columns_that_are_not_asked_for_stay_unread(spark, sf_dir):
    path = scratch.folder(spark, "blocks")
    blocks.write_blocks(order_pixels(spark, sf_dir).select("block_id", "obs_sin", "obs_cos"), path)
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
        if info.base_name == "obs_cos.npy":
            fs.delete_file(info.path)
    assert blocks.read_blocks(spark, path, "obs_sin double").agg(F.count("obs_sin")).first()[0] == order_pixels(spark, sf_dir).count()


def test_blocks_with_odd_values(spark):
    rows = [(1, math.nan, True, None), (1, 2.0, None, 5), (None, math.inf, False, 7), (2, None, None, None), (2, None, None, None)]
    path = scratch.folder(spark, "blocks")
    blocks.write_blocks(spark.createDataFrame(rows, "block_id int, x double, flag boolean, n long"), path)
    read = lambda: blocks.read_blocks(spark, path, "block_id int, x double, flag boolean, n long")
    assert sorted(map(str, map(tuple, read().collect()))) == sorted(map(str, rows))
    assert read().where("x > 1e300").count() == 2 and read().where("x <= 2").count() == 1 and read().where("n IS NULL").count() == 3
    with pytest.raises(Exception, match="numbers and booleans"):
        blocks.write_blocks(spark.createDataFrame([(1, "a")], "block_id int, s string"), scratch.folder(spark, "blocks"))
    empty = scratch.folder(spark, "blocks")
    blocks.write_blocks(spark.createDataFrame([], "block_id int, x double"), empty)
    assert blocks.read_blocks(spark, empty, "x double").count() == 0


GRID = Grid(100, 70, (0.5, 0.1, 10.0, 0.2, -0.5, 50.0), "EPSG:32650")


def cells(spark):
    return spark.range(7000).selectExpr("id div 100 AS row", "id % 100 AS col", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN double('nan') ELSE id / 8.0 END AS value")


def test_raster_comes_back_and_tiles_outside_stay_unread(spark):
    path = scratch.folder(spark, "raster")
    index = rasters.write_raster(cells(spark), path, GRID, 16, 2).collect()
    assert len(index) == 12 and {(r["height"], r["width"]) for r in index} == {(32, 32), (32, 4), (6, 32), (6, 4)}
    got = {(r, c): v for r, c, v in rasters.read_raster(spark, path).collect()}
    want = {(r, c): v for r, c, v in cells(spark).where("value IS NOT NULL").collect()}
    assert got.keys() == want.keys() and all(got[k] == v or math.isnan(v) and math.isnan(got[k]) for k, v in want.items())
    # break what the window doesn't meet: other files, and the other tiles of its file
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    for r in index:
        name = f"{root}/{r['file']}"
        if (r["top"], r["left"]) != (32, 32):
            with fs.open_output_stream(name) as f:
                f.write(b"broken")
            continue
        with fs.open_input_file(name) as f:
            head = rasters.read_header(f)
            f.seek(0)
            raw = bytearray(f.read())
        for tile in range(1, 4):
            raw[head.offsets[tile] : head.offsets[tile] + head.sizes[tile]] = b"\xff" * head.sizes[tile]
        with fs.open_output_stream(name) as f:
            f.write(bytes(raw))
    window = rasters.read_raster(spark, path).where("row BETWEEN 33 AND 40 AND col > 35 AND col <= 47")
    assert {(r, c): v for r, c, v in window.where("NOT isnan(value)").collect()} == {(r, c): v for (r, c), v in want.items() if 33 <= r <= 40 and 35 < c <= 47 and not math.isnan(v)}
    reader = rasters.RasterReader(path)
    assert len(parts_of(reader, EqualTo(("row",), 40), GreaterThan(("col",), 50))) == 3
    assert len(parts_of(rasters.RasterReader(path), In(("row",), (1, 69)), LessThanOrEqual(("col",), 10))) == 3


def test_classic_tiffs_of_other_writers(spark, tmp_path):
    """A big-endian file of strips in 16-bit integers, put together by hand."""
    values = np.arange(35).reshape(5, 7) - 3
    body = values.astype(">i2").tobytes()
    texts = b"-3\0\0"
    at = 8 + len(body)
    scale, tie = struct.pack(">3d", 30, 30, 0), struct.pack(">6d", 0, 0, 0, 500, 900, 0)
    strips, sizes = struct.pack(">3I", 8, 8 + 28, 8 + 56), struct.pack(">3I", 28, 28, 14)
    extra = [scale, tie, strips, sizes]
    places = [at + sum(map(len, extra[:i])) for i in range(4)]
    tags = [(256, 3, 1, 7 << 16), (257, 3, 1, 5 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 3, places[2]), (277, 3, 1, 1 << 16), (278, 3, 1, 2 << 16), (279, 4, 3, places[3]), (339, 3, 1, 2 << 16), (33550, 12, 3, places[0]), (33922, 12, 6, places[1])]
    ifd = at + sum(map(len, extra))
    raw = b"MM" + struct.pack(">HI", 42, ifd) + body + b"".join(extra) + struct.pack(">H", len(tags) + 1) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">HHI", 42113, 2, 3) + texts + struct.pack(">I", 0)
    path = tmp_path / "other.tif"
    path.write_bytes(raw)
    got = {(r, c): v for r, c, v in rasters.read_raster(spark, f"file://{path}").collect()}
    assert got == {(r, c): float(values[r, c]) for r in range(5) for c in range(7) if values[r, c] != -3}
    found = rasters.raster_files(spark.createDataFrame([("a", f"file://{path}"), ("b", f"file://{path}.none"), ("c", None)], "product string, path string")).collect()
    assert tuple(found[0][2:]) == (hashlib.sha256(raw).hexdigest(), None, "30,0,500,0,-30,900", 5, 7, -3.0, 34, -2.0, 31.0)
    assert tuple(found[1][2:]) == tuple(found[2][2:]) == (None,) * 9
    audit = {r["product"]: r["status"] for r in release.audited_rasters(spark.createDataFrame([("a", f"file://{path}"), ("b", "/none.tif")], "product string, path string")).collect()}
    assert audit == {"a": "passed", "b": "missing"}


def test_located_tables_join_without_exchange(spark, sf_dir):
    pixels = order_pixels(spark, sf_dir)
    a, b, c = (located.store_located(pixels.select("row", "col", x), x, 4) for x in ("obs_sin", "mask", "fold_id"))
    found = located.looked_up(spark, a, b, c)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and found.count() == pixels.count()


def test_bitmaps_equal_grouping_by_pixel(spark):
    rows = [(i, None if i % 17 == 0 else i % 6, 1) for i in range(0, 90_000, 7)] + [(i, 3, 1) for i in range(0, 9000, 70)] + [(-5, 1, 1), (-5, 2, 1), (1 << 40, 4, 1), (3, 4, 0)]
    df = spark.createDataFrame(rows, "pixel_id long, fold_id long, mask int")
    columns = ["fold_id", "training_n", "validation_n", "intersection_n", "union_n"]
    for own in (df, df.where("fold_id = 2"), df.limit(0)):
        found, want = (sorted(map(tuple, f.select(*columns).collect())) for f in (folds.partition_bitmaps(own), folds.partition_audit(own, by_pixel=True)))
        assert found == want
    assert folds.partition_bitmaps(df.unionByName(df.selectExpr("CAST(NULL AS BIGINT) AS pixel_id", "fold_id", "mask"))).count() == 4


def test_bitmaps_bound_the_shuffle(spark):
    rows = spark.range(0, 300_000, 1, 4).selectExpr("id AS pixel_id", "id % 5 AS fold_id", "1 AS mask")
    plan = folds.partition_bitmaps(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(slice" in plan and "partial_bitmap_construct_agg" in plan


def test_sketches_keep_their_bound_and_merge(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.lognormal(0, 3, 4000), -rng.lognormal(1, 2, 3000), np.zeros(50)]
    rows = [(i % 7, i % 2, float(v)) for i, v in enumerate(x)] + [(0, 0, math.nan), (1, 1, math.inf), (2, 0, None)]
    df = spark.createDataFrame(rows, "block long, g long, x double").repartition(5)
    whole = sketches.sketches(df, ["g"], F.col("x"))
    merged = sketches.merged(sketches.sketches(df, ["block", "g"], F.col("x")), ["g"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))
    for q in (0.0, 0.01, 0.3, 0.5, 0.9, 0.999, 1.0):
        for r in merged.select("g", sketches.quantile(F.col("sketch"), q).alias("v")).collect():
            own = sorted(v for _, g, v in rows if g == r["g"] and v is not None and math.isfinite(v))
            exact = own[math.floor(q * (len(own) - 1))]
            assert abs(r["v"] - exact) <= sketches.ERROR * abs(exact) * (1 + 1e-9)
    assert sketches.sketches(df.limit(0), ["g"], F.col("x")).count() == 0


def test_sketch_of_a_stream(spark, sf_dir):
    """The stream's state is the bins' counts; put together they are the sketch of the whole table."""
    base = scratch.folder(spark, "stream")
    pixels = order_pixels(spark, sf_dir).select("fold_id", "obs_sin")
    pixels.repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    counts = stream.groupBy("fold_id", sketches.bin_of(F.col("obs_sin")).alias("bin")).agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("complete").format("memory").queryName("sketched").trigger(availableNow=True).start().awaitTermination()
    found = spark.table("sketched").groupBy("fold_id").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("sketch"))
    assert sorted(map(str, found.collect())) == sorted(map(str, sketches.sketches(pixels, ["fold_id"], F.col("obs_sin")).collect()))


def gate_rows(spark, parts, **more):
    base = scratch.folder(spark, "gate")
    schema = "run long, iteration long, objective double, relative_step double, gradient_rms double"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        histories.write_gates(histories.running_gate(stream, 0.5, 0.09, 0.004, **more), f"{base}/out", f"{base}/state").awaitTermination()
    return {(r["run"], r["iteration"]): r for r in histories.settled(spark.read.parquet(f"{base}/out/*")).collect()}


def test_running_gate_takes_late_and_repeated_iterations(spark):
    rng = np.random.default_rng(1)
    rows = [(run, i, float(rng.random() + 1), float(rng.random() / 10), float(rng.random() / 200)) for run in (1, 2) for i in range(40)]
    order = sorted(rows, key=lambda r: r[1] + rng.integers(0, 12))
    got = gate_rows(spark, [order[:30], order[30:60] + order[:5], order[60:] + [(1, 39, 9.0, 9.0, 9.0)]])
    from subsidia.operators import history

    want = history.convergence_gate(spark.createDataFrame(rows, "run long, iteration long, objective double, relative_step double, gradient_rms double"), 0.5, 0.09, 0.004).collect()
    assert len(got) == len(want) == 80
    for w in want:
        g = got[w["run"], w["iteration"]]
        assert g["converged"] == w["converged"] and g["rel_drop"] == pytest.approx(w["rel_drop"]) and g["max_step"] == w["max_step"]
    assert any(w["converged"] for w in want)


def test_running_gate_costs_little_for_a_run(spark, monkeypatch):
    """A run has few rows in a batch: what a call does besides must stay small, with rows as a window over the whole gives them."""
    import cProfile
    import pstats

    import pandas as pd
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from subsidia.operators import history

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    taken = []
    own = PandasGroupedOpsMixin.applyInPandasWithState
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandasWithState", lambda self, f, *more: taken.append(f) or own(self, f, *more))
    names = ["iteration", "objective", "relative_step", "gradient_rms"]
    rows = [(i, 1.0 + (i * 7 % 11) / 10, i % 10 / 100, i % 7 / 1000) for i in range(64)]
    history_rows = spark.createDataFrame([(1, *r) for r in rows], "run long, iteration long, objective double, relative_step double, gradient_rms double")
    histories.running_gate(history_rows, 0.5, 0.09, 0.004)
    state, got, profile = State(), {}, cProfile.Profile()
    for k in range(4):
        part = pd.DataFrame([r for r in rows if r[0] * 5 % 4 == k or r[0] % 16 == k], columns=names)
        found = profile.runcall(lambda part=part: list(taken[0]((1,), iter([part]), state)))
        got |= {r.iteration: (round(r.rel_drop, 9), r.max_step, r.grad_rms, r.converged) for x in found for r in x.itertuples()}
    want = history.convergence_gate(history_rows, 0.5, 0.09, 0.004).collect()
    assert got == {r.iteration: (round(r.rel_drop, 9), r.max_step, r.grad_rms, r.converged) for r in want} and any(r.converged for r in want)
    assert pstats.Stats(profile).total_calls < 4 * 2500


def test_running_gate_lets_go_of_what_is_too_late(spark):
    rows = [(1, i, 1.0 + i, 0.01, 0.001) for i in range(1, 60)]
    got = gate_rows(spark, [rows, [(1, 0, 5.0, 0.0, 0.0)], [(1, 60, 61.0, 0.01, 0.001)]], late=5)
    assert (1, 0) not in got and len(got) == 60 and got[1, 60]["rel_drop"] == pytest.approx(9 / 52)


def test_polygon_areas(spark):
    one = spark.range(1)
    area = lambda ring: one.select(geometry.polygon_area([(F.lit(x), F.lit(y)) for x, y in ring])).first()[0]
    straight = one.select(geometry.cell_area(F.lit(0), 38.0, 0.001, 0.001)).first()[0]
    ring = [(115.0, 38.0), (115.001, 38.0), (115.001, 37.999), (115.0, 37.999)]
    assert area(ring) == pytest.approx(straight, rel=1e-9) and area(ring[::-1]) == pytest.approx(straight, rel=1e-9)
    cell = one.select(geometry.affine_cell_area(F.lit(0), F.lit(0), (0.001, 0.0, 115.0, 0.0, -0.001, 38.0))).first()[0]
    assert cell == pytest.approx(straight, rel=1e-9)
    half = area(ring[:3]) + area([ring[0], ring[2], ring[3]])
    assert half == pytest.approx(straight, rel=1e-9)
    # a quarter of the earth's zone between the equator and 1 degree: b^2 / 2 (sin p / (1 - e2 sin2 p) + atanh(e sin p) / e) pi / 2
    e = math.sqrt(geometry.FLATTENING * (2 - geometry.FLATTENING))
    s = math.sin(math.radians(1))
    zone = (geometry.MAJOR * (1 - geometry.FLATTENING)) ** 2 / 2 * (s / (1 - e * e * s * s) + math.atanh(e * s) / e) * math.pi / 2
    assert area([(0.0, 0.0), (90.0, 0.0), (90.0, 1.0), (0.0, 1.0)]) == pytest.approx(zone, rel=1e-9)
    turned = [(x - y * 0.3, y + x * 0.2) for x, y in ((0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001))]
    assert area([(10 + x, 20 + y) for x, y in turned]) == pytest.approx(area([(10, 20), (10.001, 20), (10.001, 20.001), (10, 20.001)]) * 1.06, rel=1e-4)


def test_file_digests(spark, tmp_path):
    big = os.urandom(20 << 20)
    (tmp_path / "big").write_bytes(big)
    (tmp_path / "empty").write_bytes(b"")
    rows = [(str(tmp_path / "big"),), (f"file://{tmp_path}/empty",), (str(tmp_path / "none"),), (None,)]
    got = [tuple(r)[1:] for r in files.file_digests(spark.createDataFrame(rows, "path string")).collect()]
    assert got == [(len(big), hashlib.sha256(big).hexdigest()), (0, hashlib.sha256(b"").hexdigest()), (None, None), (None, None)]
    assert files.file_digest(str(tmp_path / "big")) == got[0][1]


def test_leaves_of_documents(spark, tmp_path):
    body = {"a": {"b": [1, {"c": "x"}, True], "d": None}, "e": 1.5, "deep": {"p": {"q": {"r": {"s": {"t": 1}}}}}, "empty": {}}
    (tmp_path / "one.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("{not json")
    got = {(r["document"], r["path"]): (r["kind"], r["value"]) for r in files.leaves(files.nested_documents(spark, str(tmp_path))).collect()}
    assert got["one.json", "a.b.0"] == ("BIGINT", "1") and got["one.json", "a.b.1.c"] == ("STRING", "x") and got["one.json", "a.b.2"] == ("BOOLEAN", "true")
    assert got["one.json", "a.d"][0] == "VOID" and got["one.json", "e"] == ("DECIMAL", "1.5")
    assert got["one.json", "deep.p.q.r"] == ("JSON", '{"s":{"t":1}}')
    assert not any(k[0] == "bad.json" for k in got)


def test_acceptance_of_documents(spark):
    found = spark.createDataFrame([("a", "n", "BIGINT", "3"), ("a", "x", "DECIMAL", "1.25"), ("a", "ok", "BOOLEAN", "true"), ("a", "text", "STRING", "true"), ("a", "s", "STRING", "passed"), ("a", "t", "STRING", "3")], "document string, path string, kind string, value string")
    wanted = [("exact", "n", "3", True), ("exact", "n", "4", False), ("exact", "t", "3", False), ("near", "x", "1.2", True), ("near", "x", "2", False), ("true", "ok", "true", True), ("true", "text", "true", False), ("passed", "s", "passed", True), ("configured", "s", "configured", False), ("absent", "n", None, False), ("absent", "z", None, True), ("exact", "z", "1", False)]
    rows = spark.createDataFrame([(i, f, "a", p, e, 0.1) for i, (f, p, e, _) in enumerate(wanted)], "position int, family string, document string, path string, expected string, tol double")
    gates = release.accepted(found, rows)
    assert [r["passed"] for r in gates.orderBy("position").collect()] == [w[3] for w in wanted]
    status = release.acceptance_status(gates).first()
    assert status["overall_status"] == "failed" and status["failed"] == 7 and status["failure_reasons"][:2] == ["a.n", "a.t"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    assert scratch.folder(spark, "x") != scratch.folder(spark, "x")
