"""Queries over what the engine has stored itself: blocks, rasters, located tables, sketches, documents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry
from ..functions.geometry import FLATTENING, MAJOR, Grid
from ..operators import bounded, folds, located, metrics, release, sketches, storage
from ..sources import blocks, files, rasters, scratch
from ..sources.pixels import DESIGN, MODEL, STEP, TOP, WIDTH, damaged_pixels, masked_pixels, order_pixels, read_table, undefined_folds
from ..streaming import histories
from . import sql as S
from .queries import MF, SQL, event_history, frame, query, r, rounded

_NUMBERS = "pixel_id long, row long, col long, block_id long, fold_id long, mask int, obs_sin double, obs_cos double, hc_sin double, hc_cos double, ske_ref double"


@query(f"WITH {S.PX} SELECT block_id, fold_id, count(*) AS n, round(sum(obs_sin), 6) AS total FROM px WHERE block_id BETWEEN 3 AND 40 AND mask = 1 GROUP BY block_id, fold_id")
def q61_block_source(spark, d):
    """Pixels stored as blocks of .npy columns; the filter skips blocks, the schema leaves columns unread."""
    path = scratch.folder(spark, "blocks")
    blocks.write_blocks(order_pixels(spark, d).select(*(c.split()[0] for c in _NUMBERS.split(", "))), path)
    rows = blocks.read_blocks(spark, path, "block_id long, fold_id long, mask int, obs_sin double").where("block_id BETWEEN 3 AND 40 AND mask = 1")
    return rounded(rows.groupBy("block_id", "fold_id").agg(F.count("*").alias("n"), F.sum("obs_sin").alias("total")), total=6)


def fixture_grid(pixels: DataFrame) -> Grid:
    """The grid that the fixture's cells lie in."""
    height = (pixels.agg(F.max("row")).first()[0] or 0) + 1
    return Grid(WIDTH, height, (STEP, 0.0, 115.0, 0.0, -STEP, TOP), "EPSG:4326")


def stored_raster(spark, cells: DataFrame, grid: Grid, name: str, tile: int = 32) -> str:
    path = scratch.folder(spark, name)
    rasters.write_raster(cells, path, grid, tile)
    return path


@query(f"WITH {S.PX} SELECT row, col, ske_ref AS value FROM px WHERE row >= 37 AND row < 220 AND col BETWEEN 11 AND 90")
def q62_raster_window(spark, d):
    """A window of a tiled raster: files and tiles outside it stay unread."""
    pixels = order_pixels(spark, d)
    path = stored_raster(spark, pixels.select("row", "col", F.col("ske_ref").alias("value")), fixture_grid(pixels), "window")
    return rasters.read_raster(spark, path).where("row >= 37 AND row < 220 AND col BETWEEN 11 AND 90")


#: Rasters of the fixture that are written, in files of so many rows and columns.
_WRITTEN, _SIDE = ("obs_sin", "hc_cos", "ske_ref"), 64


def written_products(spark, d) -> DataFrame:
    """(product, path) of the files of three rasters, one of which says another reference system, and of one that isn't there."""
    pixels = damaged_pixels(spark, d)
    grid, files = fixture_grid(pixels), None
    for name in _WRITTEN:
        own = Grid(grid.width, grid.height, grid.transform, "EPSG:32650") if name == "ske_ref" else grid
        path = scratch.folder(spark, name)
        index = rasters.write_raster(pixels.select("row", "col", F.col(name).alias("value")), path, own, _SIDE // 2, 2)
        rows = index.select(F.concat(F.lit(f"{name}/"), "file").alias("product"), F.concat(F.lit(f"{path}/"), "file").alias("path"))
        files = rows if files is None else files.unionByName(rows)
    return files.unionByName(spark.createDataFrame([("hu_sin", f"{path}/missing.tif")], "product string, path string"))


_FILES = f"""u AS (SELECT product, value, row // {_SIDE} * {_SIDE} AS t, col // {_SIDE} * {_SIDE} AS l FROM bad UNPIVOT (value FOR product IN (obs_sin, hc_cos, ske_ref))), h AS (SELECT max(row) + 1 AS height FROM bad),
m AS (SELECT product || '/tiles-' || CAST(t AS BIGINT) || '-' || CAST(l AS BIGINT) || '.tif' AS product, CASE WHEN product = 'ske_ref' THEN 'EPSG:32650' ELSE 'EPSG:4326' END AS crs, format('0.001,0,{{:.15g}},0,-0.001,{{:.15g}}', {S.num(115)} + {S.num(0.001)} * l, {S.num(TOP)} + {S.num(-0.001)} * t) AS transform,
 CAST(least({_SIDE}, any_value(height) - t) AS INTEGER) AS height, CAST(least({_SIDE}, {WIDTH} - l) AS INTEGER) AS width, {S.num(-9999)} AS nodata, count(CASE WHEN isfinite(value) THEN 1 END) AS finite_count, round(min(CASE WHEN isfinite(value) THEN value END), 9) AS min_value, round(max(CASE WHEN isfinite(value) THEN value END), 9) AS max_value, 'passed' AS status
 FROM u, h GROUP BY product, t, l)"""


@query(f"WITH {S.PX}, {S.BAD}, {_FILES} SELECT * FROM m UNION ALL SELECT 'hu_sin', NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL, 'missing'")
def q63_raster_products(spark, d):
    """The audit of raster files: tasks read headers, digests and cells."""
    return rounded(release.audited_rasters(written_products(spark, d)).drop("sha256"), min_value=9, max_value=9)


@query(f"WITH {S.PX}, {S.BAD}, {_FILES} SELECT count(*) AS products, count(DISTINCT (crs, transform, height, width)) <= 1 AS same FROM m")
def q64_same_geometry(spark, d):
    return release.same_geometry(rasters.raster_files(written_products(spark, d)).where("height IS NOT NULL"))


@query(f"WITH {S.PX} SELECT block_id, fold_id, count(*) AS n, round(sum(obs_sin), 6) AS total, round(max(ske_ref), 9) AS ske_max FROM px WHERE mask = 1 GROUP BY block_id, fold_id")
def q65_located_joins(spark, d):
    """Pixels look up mask, fold and published coefficient in rasters that are laid out as they are."""
    pixels = order_pixels(spark, d)
    stored = [located.store_located(pixels.select("row", "col", *c), c[-1], 8) for c in (("block_id", "obs_sin"), ("mask",), ("fold_id",), ("ske_ref",))]
    rows = located.looked_up(spark, *stored).where("mask = 1")
    return rounded(rows.groupBy("block_id", "fold_id").agg(F.count("*").alias("n"), F.sum("obs_sin").alias("total"), F.max("ske_ref").alias("ske_max")), total=6, ske_max=9)


_AUDIT = """k AS (SELECT unnest([1, 2, 3, 4])::BIGINT AS fold_id), v AS (SELECT k.fold_id, count(DISTINCT pixel_id) AS n FROM k LEFT JOIN c ON c.fold_id = k.fold_id GROUP BY ALL),
t AS (SELECT k.fold_id, count(DISTINCT pixel_id) AS n FROM k LEFT JOIN c ON c.fold_id IS DISTINCT FROM k.fold_id GROUP BY ALL), b AS (SELECT k.fold_id, count(DISTINCT x.pixel_id) AS n FROM k LEFT JOIN c x ON x.fold_id = k.fold_id AND EXISTS (SELECT 1 FROM c y WHERE y.pixel_id = x.pixel_id AND y.fold_id IS DISTINCT FROM k.fold_id) GROUP BY ALL)
SELECT fold_id, t.n AS training_n, v.n AS validation_n, b.n AS intersection_n, t.n + v.n - b.n AS union_n, b.n = 0 AS passed FROM v JOIN t USING (fold_id) JOIN b USING (fold_id)"""


@query(f"WITH {S.PX}, {S.UNDEFINED}, c AS (SELECT pixel_id, fold_id FROM uf WHERE mask = 1 UNION ALL SELECT pixel_id, CASE WHEN fold_id = 4 THEN 2 ELSE fold_id END FROM uf WHERE mask = 1 AND pixel_id % 31 = 0), {_AUDIT}")
def q66_partition_bitmaps(spark, d):
    """Pixels in two folds, found by bitmaps: some of fold 4 stand in fold 2 as well."""
    own = undefined_folds(masked_pixels(spark, d))
    again = own.where("pixel_id % 31 = 0").withColumn("fold_id", F.when(F.col("fold_id") == 4, 2).otherwise(F.col("fold_id")).cast("long"))
    return folds.partition_bitmaps(own.unionByName(again))


_G = sketches._growth(sketches.ERROR)
_AT = [0.01, 0.25, 0.5, 0.99]


@query(f"""WITH {S.PX}, {S.BAD}, o AS (SELECT fold_id, obs_sin AS x, row_number() OVER (PARTITION BY fold_id ORDER BY obs_sin) - 1 AS rank, count(*) OVER (PARTITION BY fold_id) AS n FROM bad WHERE isfinite(obs_sin))
SELECT o.fold_id, CAST(q AS DOUBLE) AS q, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * {S.num(2 / (2.718281828459045**_G + 1))} * exp(ceil(ln(abs(x)) / {S.num(_G)}) * {S.num(_G)}) END, 8) AS value FROM o JOIN (SELECT unnest({_AT}) AS q) ON rank = floor(CAST(q AS DOUBLE) * (n - 1))""")
def q67_merged_sketches(spark, d):
    """Sketches stored for each block and fold, merged by fold."""
    path = scratch.folder(spark, "sketches")
    sketches.sketches(damaged_pixels(spark, d), ["block_id", "fold_id"], F.col("obs_sin")).write.parquet(path)
    whole = sketches.merged(spark.read.parquet(path), ["fold_id"])
    columns = F.array(*(F.struct(F.lit(q).alias("q"), sketches.quantile(F.col("sketch"), q).alias("value")) for q in _AT))
    return rounded(whole.select("fold_id", F.inline(columns)), value=8)


_READINGS = """b AS (SELECT CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) AS year, o_orderstatus AS metric, round(o_totalprice / 1000, 3) AS value, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 END AS area FROM orders)"""


@query(f"WITH {_READINGS} SELECT metric, year, min(value) AS low, max(value) AS high, CAST(max(area) AS DOUBLE) AS area, count(area) AS n_area FROM b GROUP BY ALL")
def q42_bulletin_extremes(spark, d):
    """A bulletin written as CSV, whose blanks are missing numbers, read with its explicit schema."""
    key, path = F.col("o_orderkey"), scratch.folder(spark, "bulletin")
    area = F.when(key % 3 == 0, F.format_string(" %d", key % 50)).when(key % 3 == 1, " ").otherwise("")
    rows = read_table(spark, d, "orders").select(F.year(F.col("o_orderdate").cast("date")).alias("year"), F.col("o_orderstatus").alias("metric"), F.round(F.col("o_totalprice") / 1000, 3).alias("value"), area.alias("funnel_area"))
    files.write_table(rows, path, files.BULLETIN.names)
    found = files.read_bulletin(spark, path)
    return found.groupBy("metric", "year").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("funnel_area").alias("area"), F.count("funnel_area").alias("n_area"))


#: Where the families of acceptance look, and what they ask for; fold 2 is asked for a pixel too many.
_WANTED = (("exact", "validation.pixel_count", None, None), ("near", "validation.rmse", "5", 1e3), ("near", "validation.mae", "0", 1e-9), ("true", "checks.0.hash_match", "true", None), ("passed", "status", "passed", None), ("configured", "checks.1.ci_status", "configured", None), ("absent", "validation.error", None, None), ("true", "status", "true", None))
_ACCEPTED = f"""a AS ({S.metrics('fold_id')}), w AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}', '{p}')" for i, (f, p, _, _) in enumerate(_WANTED))}) v(position, family, path)),
g AS (SELECT fold_id, position, path, CASE path WHEN 'validation.pixel_count' THEN fold_id <> 2 WHEN 'validation.rmse' THEN abs(rmse - 5) <= 1000 WHEN 'validation.mae' THEN abs(mae) <= {S.num(1e-9)} WHEN 'checks.0.hash_match' THEN fold_id <> 3 WHEN 'status' THEN family = 'passed' AND pixel_count % 2 = 0 WHEN 'validation.error' THEN fold_id <> 4 ELSE TRUE END AS passed FROM a, w)"""


@query(MF + f", {_ACCEPTED} SELECT fold_id, count(*) AS gates, count_if(NOT passed) AS failed, CASE WHEN bool_and(passed) THEN 'passed' ELSE 'failed' END AS overall_status, coalesce(string_agg(CASE WHEN NOT passed THEN 'fold_' || fold_id || '.json.' || path END, ',' ORDER BY position), '') AS failure_reasons FROM g GROUP BY fold_id")
def q55_acceptance(spark, d):
    """Reports of the folds, written as documents by the engine, read back and held against what a release asks for."""
    path = scratch.folder(spark, "reports")
    found = metrics.metrics(frame(spark, d), MODEL.high, ["fold_id"]).persist()
    k = F.col("fold_id")
    status = F.when(F.col("pixel_count") % 2 == 0, "passed").otherwise("failed")
    checks = F.array(F.struct((k != 3).alias("hash_match"), F.lit(None).cast("string").alias("ci_status")), F.struct(F.lit(None).cast("boolean").alias("hash_match"), F.lit("configured").alias("ci_status")))
    body = F.to_json(F.struct(F.struct("pixel_count", "rmse", "mae", F.when(k == 4, "late").alias("error")).alias("validation"), status.alias("status"), checks.alias("checks")))
    release.write_documents(found.select(F.format_string("fold_%d.json", k).alias("document"), body.alias("body")), path)
    asked = spark.createDataFrame([(i, *x) for i, x in enumerate(_WANTED)], "position int, family string, path string, expected string, tol double")
    count = F.when(F.col("path") == "validation.pixel_count", (F.col("pixel_count") + F.when(k == 2, 1).otherwise(0)).cast("string")).otherwise(F.col("expected"))
    wanted = found.select(k, "pixel_count").join(F.broadcast(asked)).select("position", "family", F.format_string("fold_%d.json", k).alias("document"), "path", count.alias("expected"), "tol")
    gates = release.accepted(files.leaves(files.nested_documents(spark, path)), wanted)
    verdict = release.acceptance_status(gates, "document")
    return verdict.select(F.regexp_extract("document", r"(\d+)", 1).cast("long").alias("fold_id"), "gates", "failed", "overall_status", F.array_join("failure_reasons", ",").alias("failure_reasons"))


@query(SQL["q27_convergence_gate"])
def q68_running_gate(spark, d):
    """The gate of q27 over iterations that arrive in four parts, some late, some again; the query stops and goes on."""
    rows = event_history(spark, d)
    most = rows.agg(F.max("iteration")).first()[0] or 0
    late = F.col("iteration") + F.pmod(F.xxhash64("iteration"), F.lit(40))
    parts = rows.withColumn("part", F.least(F.floor(late * 4 / (most + 1)), F.lit(3)))
    parts = parts.unionByName(parts.where("iteration % 37 = 0 AND part < 3").withColumn("part", F.col("part") + 1))
    base = scratch.folder(spark, "history")
    for k in range(4):
        parts.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in")
        histories.write_gates(histories.running_gate(stream, 0.5, 0.095, 0.0045), f"{base}/out", f"{base}/state").awaitTermination()
    return rounded(histories.settled(spark.read.parquet(f"{base}/out/*")), rel_drop=9)


#: A grid that is turned and sheared.
_TURNED = (8e-4, 3e-4, 115.0, 2e-4, -9e-4, 38.0)


def _turned_area() -> str:
    a, b, _, dd, e, f = map(S.num, _TURNED)
    e2 = S.num(FLATTENING * (2 - FLATTENING))
    u, w = (0.5 - math.sqrt(0.15), 0.5, 0.5 + math.sqrt(0.15)), (5 / 18, 8 / 18, 5 / 18)
    at = lambda i, j: f"radians({dd} * (col + {S.num(u[j])}) + {e} * (row + {S.num(u[i])}) + {f})"
    parts = " + ".join(f"{S.num(w[i] * w[j])} * cos({at(i, j)}) / power(1 - {e2} * power(sin({at(i, j)}), 2), 2)" for i in range(3) for j in range(3))
    size = abs(_TURNED[0] * _TURNED[4] - _TURNED[1] * _TURNED[3]) * math.radians(1) ** 2 * (MAJOR * (1 - FLATTENING)) ** 2
    return f"{S.num(size)} * ({parts})"


@query(f"WITH {S.PX} SELECT row, count(*) AS n, round(sum({S.area('row')}), 2) AS straight_m2, round(sum({_turned_area()}), 2) AS turned_m2, round(sum({_turned_area()}), 2) AS cells_m2 FROM px GROUP BY row")
def q69_polygon_area(spark, d):
    """Areas of each row's cells as polygons, of the fixture's grid and of one that is turned and sheared; and as its cells."""
    straight, turned = (geometry.polygon_area(geometry.cell_ring(F.col("row"), F.col("col"), t)) for t in ((STEP, 0.0, 115.0, 0.0, -STEP, TOP), _TURNED))
    cells = geometry.affine_cell_area(F.col("row"), F.col("col"), _TURNED)
    return order_pixels(spark, d).groupBy("row").agg(F.count("*").alias("n"), r(F.sum(straight), 2, "straight_m2"), r(F.sum(turned), 2, "turned_m2"), r(F.sum(cells), 2, "cells_m2"))


@query("SELECT c_nationkey, CAST(sum(length(c_name || '|' || c_custkey) + 1) AS BIGINT) AS size_bytes, sha256(string_agg(c_name || '|' || c_custkey || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY c_nationkey")
def q70_file_digests(spark, d):
    """Digests of files that tasks have written, computed by tasks."""
    path = scratch.folder(spark, "listed")
    lines = read_table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat_ws("|", "c_name", F.col("c_custkey").cast("string")).alias("line"))
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "line").write.partitionBy("c_nationkey").text(path)
    listed = spark.read.format("binaryFile").load(path).select(F.col("c_nationkey").cast("long").alias("c_nationkey"), "path")
    return files.file_digests(listed).drop("path")


#: Bounds of the levels that q71 fits.
_LEVELS = (-0.2, 0.12)


@query(f"WITH {S.PX} SELECT fold_id, round(greatest(least(avg(obs_sin), {S.num(_LEVELS[1])}), {S.num(_LEVELS[0])}), 5) AS level FROM px WHERE mask = 1 AND fold_id > 0 GROUP BY fold_id")
def q71_bounded_levels(spark, d):
    """The level of each fold that is nearest to its pixels by least squares, within bounds, found by the bounded search."""
    rows = masked_pixels(spark, d).where("fold_id > 0").select("fold_id", "obs_sin").persist()

    def f(points):
        level = lambda p: F.element_at(F.array(*map(F.lit, p.tolist())), F.col("fold_id").cast("int"))
        loss = [F.sum(F.pow(F.col("obs_sin") - level(p), 2)).alias(f"f{j}") for j, p in enumerate(points)]
        slope = [F.sum(F.when(F.col("fold_id") == k, 2 * (float(p[i]) - F.col("obs_sin"))).otherwise(0.0)).alias(f"g{j}_{k}") for j, p in enumerate(points) for i, k in enumerate(folds.FOLDS)]
        row = rows.agg(F.count("*").alias("n"), *loss, *slope).first()
        n = max(row["n"], 1)
        return [((row[f"f{j}"] or 0.0) / n, np.array([row[f"g{j}_{k}"] or 0.0 for k in folds.FOLDS]) / n) for j in range(len(points))]

    size = len(folds.FOLDS)
    found = bounded.minimise_bounded(f, np.full(size, 0.1), np.full(size, _LEVELS[0]), np.full(size, _LEVELS[1]), 100, g_tol=1e-7, f_tol=0.0)
    rows.unpersist()
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in zip(folds.FOLDS, found.theta, strict=True)], "fold_id long, level double"), level=5)


_LOST = "lost AS (SELECT * REPLACE (CASE WHEN pixel_id % 23 = 0 THEN CAST('nan' AS DOUBLE) ELSE x END AS x, CASE WHEN pixel_id % 29 = 0 THEN CAST('nan' AS DOUBLE) WHEN pixel_id % 31 = 0 THEN NULL ELSE ske_ref END AS ske_ref) FROM bad)"
_OWN = S.area("row")


@query(f"""WITH {S.PX}, {S.BAD}, {_LOST}, {S.model('lost', 'mask = 1 AND coalesce(isfinite(hc_sin) AND isfinite(hc_cos), FALSE)')}, v AS (SELECT CASE WHEN isfinite(ske) THEN ske * hc_sin * {_OWN} END AS vs, CASE WHEN isfinite(ske) THEN ske * hc_cos * {_OWN} END AS vc, CASE WHEN isfinite(ske) AND isfinite(ske_ref) THEN ske - ske_ref END AS d FROM mf)
SELECT count(*) AS valid_pixel_count, count(vs) AS with_volume, round(sum(vs), 2) AS real_m3, round(sum(vc), 2) AS imag_m3, round(sum(sqrt(vs * vs + vc * vc)), 2) AS local_sum_m3, count(d) AS compared, round(max(abs(d)), 9) AS max_abs_diff, round(sqrt(sum(d * d) / count(d)), 9) AS rms_diff FROM v""")
def q72_damaged_storage(spark, d):
    """Storage and its comparison over heads, places and published coefficients of which some are damaged."""
    key, nan = F.col("pixel_id"), F.lit(math.nan)
    rows = damaged_pixels(spark, d).withColumns({"x": F.when(key % 23 == 0, nan).otherwise(F.col("x")), "ske_ref": F.when(key % 29 == 0, nan).when(key % 31 == 0, F.lit(None).cast("double")).otherwise(F.col("ske_ref"))})
    area = geometry.cell_area(F.col("row"), TOP, STEP, STEP)
    found = storage.storage_components(rows, MODEL, DESIGN, area).persist()
    summary = storage.storage_summary(found, MODEL).select("valid_pixel_count", "real_m3", "imag_m3", "local_sum_m3")
    compared = metrics.difference(found, F.col("ske"), F.col("ske_ref")).withColumnRenamed("n", "compared")
    volumes = found.agg(F.count("vol_sin").alias("with_volume"))
    one = lambda df: df.withColumn("one", F.lit(1))
    wide = one(summary).join(one(compared), "one").join(one(volumes), "one").drop("one")
    return rounded(wide, real_m3=2, imag_m3=2, local_sum_m3=2, max_abs_diff=9, rms_diff=9)
