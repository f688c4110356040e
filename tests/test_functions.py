import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from subsidia.functions import basis, geometry, guards, harmonics as H, projection, storage_model as M
from subsidia.operators import fit, folds, gates, history, metrics, percentiles, release, storage
from subsidia.operators.model_frame import model_frame, split_filter, usable

MODEL = M.StorageModel(0.2, (0.3, -0.4), math.log(0.004), 42.0, lag_u=10.0, ridge=0.3)
DESIGN = basis.Design(((0.0, 0.0), (1.0, 1.0)), 1.0, ((0.8, 0.6), (0.6, -0.8)))
COLUMNS = ["pixel_id", "fold_id", "mask", "x", "y", "obs_sin", "obs_cos", "hc_sin", "hc_cos", "hu_sin", "hu_cos"]
KIND = "pixel_id long, fold_id long, mask int, " + ", ".join(f"{c} double" for c in COLUMNS[3:])


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def pixels(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, i % 5, 1, *map(float, rng.normal(size=8))) for i in range(n)], KIND)


def by_numpy(rows, model, design):
    """Objective and metrics of plain arrays."""
    a = {c: np.array([r[c] for r in rows], float) for c in COLUMNS}
    raw = np.stack([np.exp(-((a["x"] - cx) ** 2 + (a["y"] - cy) ** 2) / (2 * design.sigma**2)) for cx, cy in design.centers], 1)
    eta = model.eta0 + raw @ np.array(design.transform) @ np.array(model.gamma)
    ske = model.low + (model.high - model.low) / (1 + np.exp(-eta))

    def turn(v, lag):
        t = 2 * np.pi * lag / model.period
        return a[f"{v}_sin"] * np.cos(t) + a[f"{v}_cos"] * np.sin(t), a[f"{v}_cos"] * np.cos(t) - a[f"{v}_sin"] * np.sin(t)

    p = [1000 * (ske * c + math.exp(model.log_cu) * u) for c, u in zip(turn("hc", model.lag_c), turn("hu", model.lag_u), strict=True)]
    e = a["obs_sin"] - p[0], a["obs_cos"] - p[1]
    sse = (e[0] ** 2 + e[1] ** 2).sum()
    n = 2 * len(rows)
    return (0.5 * sse / model.sigma**2 + 0.5 * model.ridge * model.gamma_norm**2) / n, math.sqrt(sse / n), (abs(e[0]) + abs(e[1])).sum() / n, ske, p


def test_phase_and_value(spark):
    got = one(spark, phase=H.phase_days(F.lit(0.0), F.lit(1.0)), value=H.harmonic_value(F.lit(0.0), F.lit(1.0), F.lit(0)))
    assert abs(got.phase) < 1e-12 and abs(got.value - 1) < 1e-12


def test_delay_moves_the_phase(spark):
    lag = 55.77321162652655
    s, c = H.delayed(F.lit(0.0), F.lit(1.0), lag)
    got = one(spark, shift=H.circular_difference(H.phase_days(F.lit(0.0), F.lit(1.0)), H.phase_days(s, c)), label=H.direction_label(F.lit(0.0)))
    assert abs(got["shift"] - lag) < 1e-11 and got["label"] == "negative_or_zero_delay"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(-5, 5), st.floats(-5, 5), st.floats(0, 365), st.floats(0, 365))
def test_delayed_harmonic_is_the_harmonic_delayed(spark, s, c, lag, day):
    d = H.delayed(F.lit(s), F.lit(c), lag)
    got = one(spark, a=H.harmonic_value(*d, F.lit(day)), b=H.harmonic_value(F.lit(s), F.lit(c), F.lit(day - lag)))
    assert abs(got.a - got.b) < 1e-9


def test_sigmoid_holds_at_extremes(spark):
    rows = spark.createDataFrame([(x,) for x in (-1000.0, -1.0, 0.0, 1.0, 1000.0)], "x double").select(M.bounded(F.col("x"), 1e-8, 0.05).alias("v"), M.bounded_slope(F.col("x"), 1e-8, 0.05).alias("d")).collect()
    assert all(1e-8 <= r.v <= 0.05 and r.d >= 0 and math.isfinite(r.d) for r in rows)


def test_rbf_row_norm_and_dimension(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0)], "x double, y double")
    design = basis.Design(((0.0, 0.0), (1.0, 0.0)), 1.0)
    assert [r.n > 0 for r in rows.select(basis.row_norm(basis.gaussian(F.col("x"), F.col("y"), design)).alias("n")).collect()] == [True, True]
    with pytest.raises(ValueError):
        basis.gaussian(F.col("x"), F.col("y"), basis.Design(((0.0, 0.0),) * 65, 1.0))


def test_metrics_equal_numpy(spark):
    rows = pixels(spark)
    f, rmse, mae, ske, p = by_numpy(rows.collect(), MODEL, DESIGN)
    got = metrics.metrics(model_frame(usable(rows), MODEL, DESIGN), MODEL.high).first()
    assert np.allclose([got.rmse, got.mae, got.ske_min, got.ske_p50, got.ske_max], [rmse, mae, ske.min(), np.percentile(ske, 50), ske.max()], rtol=1e-12)
    assert np.isclose(got.pred_abs_p99, np.percentile(np.maximum(abs(p[0]), abs(p[1])), 99), rtol=1e-12)
    assert np.isclose(fit.evaluate(rows, MODEL, DESIGN).total, f, rtol=1e-12)
    near = metrics.metrics(model_frame(rows, MODEL, DESIGN), MODEL.high, approx=True).first()
    assert ske.min() <= near.ske_p50 <= ske.max()


@pytest.mark.parametrize("seed", [1, 2])
def test_gradient_equals_central_differences(spark, seed):
    rows = pixels(spark, 12, seed).persist()
    theta = np.array(MODEL.theta)
    g = fit.evaluate(rows, MODEL, DESIGN).gradient
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5 * max(1, abs(theta[i]))
        a, b = (by_numpy(rows.collect(), MODEL.with_theta(theta + k * step), DESIGN)[0] for k in (1, -1))
        assert np.isclose(g[i], (a - b) / (2 * step[i]), rtol=1e-5, atol=1e-7)


def test_log_cu_beyond_its_bounds_has_no_slope(spark):
    assert fit.evaluate(pixels(spark, 5), MODEL.with_theta([0, 0, 0, -50, 1]), DESIGN).gradient[-2] == 0


def test_minimise_keeps_bounds():
    f = lambda x: (float((x[0] - 3) ** 2 + 10 * (x[1] + 1) ** 2), np.array([2 * (x[0] - 3), 20 * (x[1] + 1)]))
    found = fit.minimise(f, np.array([0.0, 5.0]), np.array([-np.inf, 0.0]), np.array([np.inf, 9.0]), 50)
    assert np.allclose(found.theta, [3, 0], atol=1e-6) and found.status.startswith("converged")


def test_fit_finds_planted_parameters(spark):
    rng = np.random.default_rng(4)
    planted = M.StorageModel(-2.0, (0.5, -0.5), math.log(4e-4), 50.0, ridge=1e-6)
    blank = spark.createDataFrame([(i, i % 5, 1, *map(float, rng.uniform(-1, 2, 2)), 0.0, 0.0, *map(float, rng.normal(size=4))) for i in range(300)], KIND)
    made = model_frame(blank, planted, DESIGN).select(*COLUMNS[:5], F.col("pred_sin").alias("obs_sin"), F.col("pred_cos").alias("obs_cos"), *COLUMNS[7:])
    start = planted.with_theta([-1.0, 0.0, 0.0, math.log(1e-3), 30.0])
    fitted, summary = fit.fit(made, start, DESIGN, (12, 12, 40))
    assert summary["final_objective"] < 1e-3 * summary["initial_objective"]
    assert abs(fitted.lag_c - 50) < 0.5 and abs(math.exp(fitted.log_cu) / 4e-4 - 1) < 0.2
    same, told = fit.fit(made, start, DESIGN, (0, 0, 0))
    assert same == start and told["status"] == "evaluated only"


def test_nonfinite_rows_are_counted_not_summed(spark):
    nan, inf = math.nan, math.inf
    bad = [(1, 1, 1, 0.0, 0.0, v, 0.0, 0.0, 0.0, 0.0, 0.0) for v in (nan, inf, -inf, None)]
    rows = pixels(spark, 3).unionByName(spark.createDataFrame(bad, KIND))
    assert usable(rows).count() == 3
    got = metrics.metrics(model_frame(rows, MODEL, DESIGN), MODEL.high).first()
    assert (got.pixel_count, got.observation_count, got.nonfinite_count) == (7, 6, 4) and math.isfinite(got.rmse)
    empty = metrics.metrics(model_frame(rows.limit(0), MODEL, DESIGN), MODEL.high).first()
    assert (empty.pixel_count, empty.rmse, empty.ske_min) == (0, 0.0, None)


def test_percentiles_are_numpys(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=700), "b": np.full(50, 2.5), "c": np.array([1.0, 4.0]), "d": np.array([7.0]), None: rng.integers(0, 4, 300) * 1e300 - 1e300, "e": np.array([math.nan])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", math.inf)], "k string, x double")
    for held, bins in ((1 << 20, 4096), (5, 8), (2, 2)):
        got = {r.k: r for r in percentiles.percentiles(df, ["k"], {"p0": (F.col("x"), 0.0), "p37": (F.col("x"), 0.37), "p1": (F.col("x"), 1.0)}, held, bins).collect()}
        assert got.keys() == groups.keys() - {"e"}
        for k, r in got.items():
            assert np.allclose([r.p0, r.p37, r.p1], np.percentile(groups[k], [0, 37, 100]), rtol=1e-12)
    assert percentiles.percentiles(df, [], {"m": (F.col("x"), 0.5)}, 5, 8).first().m == pytest.approx(np.median(np.concatenate([v for k, v in groups.items() if k != "e"])))
    rows = model_frame(usable(pixels(spark)), MODEL, DESIGN)
    for by in ([], ["fold_id"]):
        a, b = (sorted(metrics.metrics(rows, MODEL.high, by, narrowed=n).collect()) for n in (False, True))
        assert np.allclose(a, b, rtol=1e-12)
    for n in (None, True):
        empty = metrics.metrics(rows.limit(0), MODEL.high, narrowed=n).first()
        assert (empty.pixel_count, empty.ske_p50) == (0, None)


def test_large_groups_leave_the_single_task(spark, monkeypatch):
    """Groups of more rows than a task may hold are narrowed, the others not; a null key is a group as others are."""
    rnd = np.random.default_rng(8)
    sizes = {None: 90, 0: 400, 1: 50, 2: 51, 3: 1}
    data = [(k, *map(float, rnd.normal(size=5))) for k, n in sizes.items() for _ in range(n)] + [(4, math.nan, 0.0, 0.0, 0.0, 1.0)] * 60
    rows = spark.createDataFrame(data, "fold_id long, pred_sin double, pred_cos double, res_sin double, res_cos double, ske double")
    narrowed, plain = [], metrics.percentiles

    def seen(frame, by, asked, held):
        narrowed.append(frame.count())
        return plain(frame, by, asked, held)

    monkeypatch.setattr(metrics, "percentiles", seen)
    for by in ([], ["fold_id"]):
        order = lambda r: str(r[0])
        wanted = sorted(metrics.metrics(rows, MODEL.high, by, narrowed=False).collect(), key=order)
        assert narrowed == []
        for held, parts in ((10**6, []), (50, [90 + 400 + 51 + 60] if by else [len(data)])):
            found = sorted(metrics.metrics(rows, MODEL.high, by, held=held).collect(), key=order)
            assert narrowed == parts and [r[:1] for r in found] == [r[:1] for r in wanted] and found[0].asDict().keys() == wanted[0].asDict().keys()
            for a, b in zip(found, wanted, strict=True):
                assert all(x == y if x is None or y is None else math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b, strict=True))
        narrowed.clear()
        approx = metrics.metrics(rows, MODEL.high, by, approx=True, held=1).collect()
        assert len(approx) == len(wanted) and narrowed == []


def test_training_errors_sum_all_other_folds(spark):
    rows = pixels(spark).unionByName(spark.createDataFrame([(99, None, 1, *[0.5] * 8), (98, 9, 1, *[0.1] * 8)], KIND))
    frame = model_frame(rows, MODEL, DESIGN)
    got = {r.fold_id: r for r in metrics.training_errors(frame, folds.FOLDS).collect()}
    for k in folds.FOLDS:
        want = metrics.metrics(split_filter(frame, "training", k), MODEL.high).first()
        assert got[k].pixel_count == want.pixel_count and np.allclose([got[k].rmse, got[k].mae], [want.rmse, want.mae], rtol=1e-12)


def test_many_centres(spark):
    rng = np.random.default_rng(1)
    centers, weights = rng.normal(size=(90, 2)), rng.normal(size=90)
    row = spark.createDataFrame([(0.3, -0.2), (None, 1.0)], "x double, y double").select(basis.weighted_total(basis.rbf_array(F.col("x"), F.col("y"), [tuple(map(float, c)) for c in centers], 1.5), list(weights)).alias("v")).collect()
    assert np.isclose(row[0].v, np.exp(-((centers - [0.3, -0.2]) ** 2).sum(1) / 4.5) @ weights) and row[1].v is None


def test_release_families(spark):
    rows = release.acceptance(spark, {"n": 1, "m": True, "s": "passed"}, {"n": 1, "m": 1}, ("m", "n"), ("s", "t"))
    assert release.reasons(rows, "position") == ["m", "n", "t"]
    meta = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "product string, crs string, height int").selectExpr("*", "'t' AS transform", "3 AS width")
    assert not release.same_geometry(meta).first().same and release.same_geometry(meta.limit(1)).first().same and release.same_geometry(meta.limit(0)).first().same
    paths = spark.createDataFrame([("a/build/x.py",), ("builds/x.py",), ("x.tif",), (None,)], "path string")
    assert [r.path for r in release.active_paths(paths, ("build",), (".py",)).collect()] == ["builds/x.py"]
    assert release.active_paths(paths, ()).count() == 4


def test_splits(spark):
    rows = pixels(spark, 10).unionByName(spark.createDataFrame([(99, None, 1, *[0.0] * 8), (98, 9, 1, *[0.0] * 8)], KIND))
    assert split_filter(rows, "validation", 2).count() == 2 and split_filter(rows, "training", 2).count() == 10
    for bad in (("training", None), ("test", 1)):
        with pytest.raises(ValueError):
            split_filter(rows, *bad)
    audit = {r.fold_id: r for r in folds.partition_audit(rows).collect()}
    assert all(r.passed and r.intersection_n == 0 for r in audit.values()) and audit[1].training_n == 10
    twice = folds.partition_audit(rows.unionByName(rows.where("pixel_id = 1").withColumn("fold_id", F.lit(3).cast("long"))), by_pixel=True)
    assert {r.fold_id: r.intersection_n for r in twice.collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    assert {r.fold_id: r.n for r in folds.fold_histogram(rows).collect()} == {-1: 2, 0: 2, 1: 2, 2: 2, 3: 2, 4: 2}


def test_storage_invariants(spark):
    rows = storage.storage_components(pixels(spark).withColumn("row", F.col("pixel_id")), MODEL, DESIGN, geometry.cell_area(F.col("row"), 38.0, 0.001, 0.001))
    got = storage.storage_summary(rows, MODEL).first()
    assert got.local_sum_m3 >= got.coherent_m3 and abs(got.shift_days - MODEL.lag_c) < 1e-6 and got.peak_to_trough_m3 == 2 * got.coherent_m3


def test_cell_areas_cover_the_ellipsoid(spark):
    total = spark.range(1800).select(F.sum(geometry.cell_area(F.col("id"), 90.0, 0.1, 360.0))).first()[0]
    assert abs(total / 510_065_621_724_088.5 - 1) < 1e-12


def test_projection(spark):
    rows = spark.createDataFrame([(-79.387139, 43.642567), (-81.0, 0.0), (-81.0, 90.0), (-78.0, 60.0), (None, 1.0)], "lon double, lat double")
    ahead = rows.select("*", *(c.alias(n) for n, c in zip("xy", projection.reproject(F.col("lon"), F.col("lat"), "EPSG:4326", "epsg:32617"), strict=True)))
    back = ahead.select("*", *(c.alias(n) for n, c in zip(("lon2", "lat2"), projection.reproject(F.col("x"), F.col("y"), "EPSG:32617", "EPSG:4326"), strict=True)))
    tower, equator, pole, edge, missing = back.collect()
    assert abs(tower.x - 630084) < 1 and abs(tower.y - 4833438) < 1.5
    assert (equator.x, equator.y) == (500000, 0) and abs(pole.y - 9997964.943) < 1e-3 and abs(pole.x - 500000) < 1e-6
    for r in (tower, equator, edge):
        assert abs(r.lon - r.lon2) < 1e-10 and abs(r.lat - r.lat2) < 1e-10
    assert missing.x is None and missing.lon2 is None
    south = one(spark, **dict(zip("xy", projection.reproject(F.lit(-81.0), F.lit(-45.0), "EPSG:4326", "EPSG:32717"), strict=True)))
    north = one(spark, **dict(zip("xy", projection.reproject(F.lit(-81.0), F.lit(45.0), "EPSG:4326", "EPSG:32617"), strict=True)))
    assert abs(south.y + north.y - 1e7) < 1e-6
    assert one(spark, **dict(zip("xy", projection.reproject(F.lit(180.0), F.lit(0.0), "EPSG:4326", "EPSG:3857"), strict=True))).x == pytest.approx(20037508.342789244)
    for crs in ("EPSG:32661", "EPSG:2154", "EPSG:32700"):
        with pytest.raises(ValueError):
            projection.reproject(F.col("x"), F.col("y"), "EPSG:4326", crs)


def test_gates(spark):
    actual = gates.unpivoted(spark.createDataFrame([("a", 1.0, math.nan)], "scope string, x double, y double"), "scope")
    table = gates.gate_table(actual, spark.createDataFrame([("a", "x", 1.0, 0.0), ("a", "y", 0.0, 9.0), ("a", "z", 0.0, 9.0), ("b", "x", 1.0, 1.0)], gates.GATES))
    states = {r.scope: (r.status, r.failed) for r in gates.verdicts(table).collect()}
    assert states == {"a": ("failed", ["y", "z"]), "b": ("failed", ["x"])}


def test_convergence_needs_ten_rows(spark):
    rows = spark.createDataFrame([(1, i, 1.0, 0.0, 0.0) for i in range(12)], "run int, iteration int, objective double, relative_step double, gradient_rms double")
    assert [r.converged for r in history.convergence_gate(rows, 0.0, 0.0, 0.0).orderBy("iteration").collect()] == [False] * 9 + [True] * 3
    assert history.iteration_changes(rows).orderBy("iteration").first().relative_change == math.inf


def test_symmetric_limit(spark):
    rows = spark.createDataFrame([(-2.0,), (1.0,), (math.nan,)], "x double")
    assert rows.agg(guards.symmetric_limit(F.col("x"))).first()[0] == 2.0
    assert rows.limit(0).agg(guards.symmetric_limit(F.col("x"))).first()[0] == 1.0


def test_grids():
    a = geometry.Grid(3, 2, (0.1, 0.0, 5.0, 0.0, -0.1, 9.0), "EPSG:4326")
    assert geometry.same_grid(a, geometry.Grid(*(getattr(a, f) for f in ("width", "height", "transform", "crs")))) and not geometry.same_grid(a, geometry.Grid(3, 2, a.transform, "EPSG:32650"))


def test_layout_prunes_folds(spark, tmp_path):
    from subsidia.sources.pixels import layout

    layout(pixels(spark).withColumn("block_id", F.col("pixel_id") % 3), str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).where("fold_id = 2")
    assert rows.count() == 8 and "PartitionFilters: [isnotnull(fold_id" in rows._jdf.queryExecution().executedPlan().toString()
