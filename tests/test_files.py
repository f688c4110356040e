import hashlib
import json
import math
from dataclasses import replace

import pytest

from subsidia import cli, config
from subsidia.functions.geometry import Grid
from subsidia.sources import files, rasters
from tests.test_functions import DESIGN, KIND, MODEL, pixels


def raw(pixels_path, **more):
    model = {"eta0": MODEL.eta0, "gamma": list(MODEL.gamma), "log_cu": MODEL.log_cu, "lag_c": MODEL.lag_c}
    return {"pixels": pixels_path, "design": {"centers": DESIGN.centers, "sigma": 1.0, "transform": DESIGN.transform}, "model": model, **more}


def test_reports_and_digests(spark, tmp_path):
    path = str(tmp_path / "a" / "r.json")
    files.write_report({"b": 1, "a": "ü"}, path)
    assert files.read_document(path) == {"a": "ü", "b": 1} and list(files.read_document(path)) == ["a", "b"]
    want = hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert files.file_digest(path, 3) == want
    assert [r.sha256 for r in files.small_file_digests(spark, str(tmp_path / "a"), "*.json").collect()] == [want]
    assert files.digest({"b": 1, "a": 2}) == files.digest({"a": 2, "b": 1})


def test_parameters_come_back_in_order(spark, tmp_path):
    files.save_parameters(spark, str(tmp_path / "p"), "one", MODEL.theta)
    assert files.load_parameters(spark, str(tmp_path / "p"), "one") == MODEL.theta
    with pytest.raises(ValueError):
        files.load_parameters(spark, str(tmp_path / "p"), "two")


def test_tables_and_bulletins(spark, tmp_path):
    files.write_table(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "t"), ["b", "c", "a"])
    assert spark.read.csv(str(tmp_path / "t"), header=True).collect()[0].asDict() == {"b": None, "c": None, "a": "1"}
    (tmp_path / "b.csv").write_text("year,metric,value,unit,observation_system,center_location,contour_threshold,funnel_area,source_status\n2001,m,1.5,u,o,,, ,s\n")
    row = files.read_bulletin(spark, str(tmp_path / "b.csv")).first()
    assert (row.year, row.value, row.funnel_area, row.contour_threshold) == (2001, 1.5, None, None)


def test_config_is_held_against_frozen_values(tmp_path):
    c = config.config_from(raw("p", frozen={"lag_c": 42.0}), tmp_path)
    assert c.model.gamma == MODEL.gamma and c.pixels == str(tmp_path / "p")
    for more in ({"frozen": {"lag_c": 41.0}}, {"lag_convention": "y(t+lag)"}):
        with pytest.raises(ValueError):
            config.config_from(raw("p", **more), tmp_path)
    assert config.fold_name(3) == "fold_03"


def test_commands_and_exit_codes(spark, tmp_path, capsys):
    pixels(spark, 60).selectExpr("*", "pixel_id AS row").write.parquet(str(tmp_path / "pixels"))
    (tmp_path / "data").write_text("x")
    settings = raw("pixels", output="out", budgets=[1, 1, 1], expected=[["final", "rmse", 0.0, 1e9], ["fold_01", "pixel_count", 12, 0], ["storage", "shift_days", 42.0, 1e-6]], hashes={"data": hashlib.sha256(b"x").hexdigest()})
    path = tmp_path / "c.json"
    path.write_text(json.dumps(settings))
    for command in ("verify", "cv", "storage", "products", "figures", "all"):
        assert cli.main([command, "--config", str(path)]) == 0, capsys.readouterr().out
    assert cli.main(["invert", "--config", str(path), "--optimize", "--maxiter", "1"]) == 0
    assert len(files.load_parameters(spark, str(tmp_path / "out" / "parameters"), "fitted")) == 5
    settings |= {"products": {"map": "nowhere"}, "hashes": {"data": "0"}, "qa": "none.json"}
    path.write_text(json.dumps(settings))
    assert cli.main(["verify", "--config", str(path)]) == cli.main(["products", "--config", str(path)]) == cli.main(["audit", "--config", str(path)]) == 1
    reasons = files.read_document(str(tmp_path / "out" / "audit.json"))["failure_reasons"]
    assert {"spatial_qa: qa_status", "products: products_status"} <= set(reasons)
    assert cli.main(["cv", "--config", str(tmp_path / "none.json")]) == 1
    with pytest.raises(SystemExit) as told:
        cli.main(["--help"])
    assert told.value.code == 0


def report(capsys, *argv):
    code = cli.main(list(argv))
    return code, json.loads(capsys.readouterr().out)


def test_folds_have_their_own_models_and_gates(spark, tmp_path, capsys):
    pixels(spark, 60).selectExpr("*", "pixel_id AS row", "0L AS col").write.parquet(str(tmp_path / "pixels"))
    models = {str(k): {"eta0": MODEL.eta0 - k, "lag_c": 40.0 + k} for k in (1, 2, 3, 4)}
    settings, path = raw("pixels", fold_models=models, design={"centers": DESIGN.centers, "sigma": 1.0, "transform": DESIGN.transform}), tmp_path / "c.json"

    def run(command, *argv, **more):
        path.write_text(json.dumps(settings | more))
        return report(capsys, command, "--config", str(path), *argv)

    code, found = run("cv")
    assert code == 0 and len({f["rmse"] for f in found["folds"]}) == 4 and [f["lag_c"] for f in found["folds"]] == [41.0, 42.0, 43.0, 44.0]
    assert run("cv", fold_models={})[1]["folds"][0]["rmse"] != found["folds"][0]["rmse"]
    for k, f in enumerate(found["folds"], 1):
        stored = {"rmse": f["rmse"], "mae": f["mae"], "pixel_count": 12, "Ske_min": f["ske_min"], "Ske_max": f["ske_max"], "Cu_global": f["cu"], "lag_c_days": f["lag_c"]}
        (tmp_path / f"fit{k}.json").write_text(json.dumps({"validation": stored}))
    held = {"fold_fits": {k: f"fit{k}.json" for k in (1, 2, 3, 4)}, "fold_rmse": {k: f["rmse"] for k, f in enumerate(found["folds"], 1)}}
    code, good = run("cv", **held)
    assert (code, good["validation_recalculation_status"], len(good["validation_gates"])) == (0, "passed", 48)
    (tmp_path / "fit2.json").unlink()
    code, bad = run("cv", **held | {"fold_rmse": held["fold_rmse"] | {3: 0.0}})
    assert code == 1 and "fold_03.validation_rmse" in bad["validation_failed"] and "fold_02.validation_mae" in bad["validation_failed"]
    assert not [x for x in bad["validation_failed"] if x.startswith(("fold_01", "fold_04"))]
    (tmp_path / "errors.json").write_text(json.dumps({"rows": [{"fold_id": 2, "validation_rmse": 1.5}]}))
    assert files.stored_errors(str(tmp_path / "none"), str(tmp_path / "errors.json")) == {2: 1.5}


def test_storage_and_release_gates(spark, tmp_path, capsys):
    pixels(spark, 60).selectExpr("*", "pixel_id AS row", "0L AS col").write.parquet(str(tmp_path / "pixels"))
    spark.range(60).selectExpr("id AS row", "0L AS col", "0.0D AS ske").write.parquet(str(tmp_path / "ske"))
    path = tmp_path / "c.json"
    path.write_text(json.dumps(raw("pixels")))
    summary = report(capsys, "storage", "--config", str(path))[1]["summary"]
    wanted = {k: summary[k] for k in ("coherent_m3", "local_sum_m3", "peak_to_trough_m3")} | {"lag_c": MODEL.lag_c, "low_m3": 1.0, "high_m3": 9.0, "status": "passed"}
    (tmp_path / "envelope.json").write_text(json.dumps({"confined_storage_uncertainty_status": "passed", "p2_5_m3": 1.5, "p97_5_m3": 9.0}))
    more = {"storage": wanted, "published": "ske", "envelope": "envelope.json", "final": {"rmse": [0.0, 1e9], "ske_max": [0.0, 1.0]}}
    path.write_text(json.dumps(raw("pixels", **more)))
    code, found = report(capsys, "storage", "--config", str(path))
    assert (code, found["storage_failed"]) == (1, ["published_ske"])
    path.write_text(json.dumps(raw("pixels", **more | {"envelope": "none.json"})))
    assert set(report(capsys, "storage", "--config", str(path))[1]["storage_failed"]) == {"published_ske", "envelope_present", "envelope_status", "envelope_low", "envelope_high"}
    code, found = report(capsys, "invert", "--config", str(path))
    assert (code, found["final_recalculation_status"], len(found["final_gates"])) == (0, "passed", 10)
    families = {"report": {"ci": "configured", "n": 2}, "exact": {"n": 1}, "passed": ["final_recalculation_status", "partition_status", "absent"], "configured": ["ci"]}
    path.write_text(json.dumps(raw("pixels", acceptance=families, final=more["final"], output="out")))
    code, found = report(capsys, "audit", "--config", str(path))
    assert (code, found["failure_reasons"]) == (1, ["n", "absent"])


def test_maxiter_replaces_the_last_budget(spark, tmp_path, monkeypatch, capsys):
    pixels(spark, 20).write.parquet(str(tmp_path / "pixels"))
    path, seen = tmp_path / "c.json", []
    path.write_text(json.dumps(raw("pixels", budgets=[100, 200, 300], output="out")))
    monkeypatch.setattr(cli.fit, "fit", lambda p, model, design, budgets: seen.append(budgets) or (model, {}))
    for n in ("5", "0", "700"):
        cli.main(["invert", "--config", str(path), "--optimize", "--maxiter", n])
    cli.main(["invert", "--config", str(path), "--optimize"])
    assert seen == [(100, 200, 5), (0, 0, 0), (100, 200, 700), (100, 200, 300)]


def test_products_are_read_and_audit_judges_its_own_reports(spark, tmp_path, capsys):
    pixels(spark, 60).selectExpr("*", "pixel_id AS row", "0L AS col").write.parquet(str(tmp_path / "pixels"))
    grid = Grid(4, 3, (30.0, 0.0, 0.0, 0.0, -30.0, 0.0), "EPSG:32650")
    for name, own in (("a", grid), ("b", grid), ("c", replace(grid, crs="EPSG:4326"))):
        rasters.write_raster(spark.range(12).selectExpr("id div 4 AS row", "id % 4 AS col", "id / 2.0 AS value"), f"file://{tmp_path}/{name}", own, 4, 1)
    (tmp_path / "text.tif").write_text("no raster")
    tif = lambda x: str(tmp_path / x / "tiles-0-0.tif")
    path = tmp_path / "c.json"

    def run(command, **more):
        path.write_text(json.dumps(raw("pixels", output="out", **more)))
        return report(capsys, command, "--config", str(path))

    code, found = run("products", products={"a": tif("a"), "b": tif("b")})
    assert (code, found["products_status"], found["products_same_geometry"]) == (0, "passed", True)
    a = found["products"]["a"]
    assert (a["sha256"], a["crs"], a["height"], a["finite_count"], a["max_value"]) == (files.file_digest(tif("a")), "EPSG:32650", 3, 12, 5.5)
    code, found = run("products", products={"a": tif("a"), "c": tif("c")})
    assert (code, found["products_same_geometry"]) == (0, False)
    assert run("products", products={"a": tif("a"), "t": str(tmp_path / "text.tif")})[1]["products_status"] == "failed"
    assert run("products", products={"n": str(tmp_path / "none.tif")})[1]["products_status"] == "missing"
    (tmp_path / "stored").mkdir()
    (tmp_path / "stored" / "review.json").write_text(json.dumps({"review": {"status": "passed"}}))
    count = run("invert")[1]["metrics"]["pixel_count"]
    gates = [["exact", "invert.json", "metrics.pixel_count", count], ["exact", "invert.json", "metrics.pixel_count", count + 1], ["near", "invert.json", "metrics.rmse", 0, 1e9], ["passed", "products.json", "products_status"], ["passed", "review.json", "review.status"], ["true", "derived.json", "scientific_metrics_unchanged"], ["passed", "cv.json", "partition_status"], ["absent", "cv.json", "error"], ["passed", "nowhere.json", "status"]]
    code, found = run("audit", products={"a": tif("a")}, acceptance={"gates": gates, "documents": "stored"})
    assert (code, found["failure_reasons"]) == (1, ["invert.json.metrics.pixel_count", "nowhere.json.status"])
    code, found = run("audit", products={"a": tif("a")}, acceptance={"gates": [g for i, g in enumerate(gates) if i not in (1, 8)], "documents": "stored"})
    assert (code, found["overall_status"]) == (0, "passed")
