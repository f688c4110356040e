"""Run configuration: paths, model and optimiser parameters, frozen values to hold them against."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from .functions.basis import Design
from .functions.storage_model import StorageModel
from .operators.release import StorageRelease

LAG_CONVENTION = "y(t-lag)"


@dataclass(frozen=True)
class Config:
    pixels: str
    design: Design
    model: StorageModel
    output: str = "outputs"
    qa: str | None = None
    budgets: tuple[int, int, int] = (100, 200, 500)
    origin_latitude: float = 0.0
    step: tuple[float, float] = (0.001, 0.001)
    lag_convention: str = LAG_CONVENTION
    products: Mapping[str, str] = field(default_factory=dict)
    figures: Mapping[str, str] = field(default_factory=dict)
    hashes: Mapping[str, str] = field(default_factory=dict)
    expected: tuple[tuple[str, str, float, float], ...] = ()
    frozen: Mapping[str, Any] = field(default_factory=dict)
    #: Each fold's own model, the document of its stored fit and its frozen error.
    fold_models: Mapping[int, StorageModel] = field(default_factory=dict)
    fold_fits: Mapping[int, str] = field(default_factory=dict)
    fold_rmse: Mapping[int, float] = field(default_factory=dict)
    #: Numbers of the final model with tolerances.
    final: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    #: What storage is held against, the document of its envelope and the raster of the published coefficient.
    storage: StorageRelease | None = None
    envelope: str | None = None
    published: str | None = None
    #: Families of the release: exact numbers, booleans, statuses.
    acceptance: Mapping[str, Any] = field(default_factory=dict)


def load_config(path: str) -> Config:
    """From JSON, or from YAML where its library is there; relative paths start at the file's folder."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    return config_from(raw, Path(path).resolve().parent)


def config_from(raw: Mapping[str, Any], base: Path = Path(".")) -> Config:
    place = lambda p: p if "://" in str(p) or Path(p).is_absolute() else str(base / p)
    d, m = raw["design"], dict(raw["model"])
    design = Design(tuple(map(tuple, d["centers"])), float(d["sigma_km"]) * 1000 if "sigma_km" in d else float(d["sigma"]), tuple(map(tuple, d["transform"])) if d.get("transform") else None)
    model = StorageModel(**(m | {"gamma": tuple(m["gamma"])}))
    if len(model.gamma) != design.size:
        raise ValueError(f"{design.size} weights are needed, not {len(model.gamma)}")
    rest = {k: raw[k] for k in ("origin_latitude", "lag_convention", "frozen") if k in raw}
    rest |= {k: {n: place(p) for n, p in raw[k].items()} for k in ("products", "figures") if k in raw}
    rest |= {k: tuple(raw[k]) for k in ("budgets", "step") if k in raw}
    rest |= {"hashes": {place(p): h for p, h in raw.get("hashes", {}).items()}, "expected": tuple((str(s), str(g), float(v), float(t)) for s, g, v, t in raw.get("expected", ()))}
    if raw.get("fold_models"):
        rest["fold_models"] = {int(k): replace(model, **(v | ({"gamma": tuple(v["gamma"])} if "gamma" in v else {}))) for k, v in raw["fold_models"].items()}
        if any(len(x.gamma) != design.size for x in rest["fold_models"].values()):
            raise ValueError(f"{design.size} weights are needed in every fold")
    rest |= {"fold_fits": {int(k): place(v) for k, v in raw.get("fold_fits", {}).items()}, "fold_rmse": {int(k): float(v) for k, v in raw.get("fold_rmse", {}).items()}}
    rest |= {"final": {k: (float(v), float(t)) for k, (v, t) in raw.get("final", {}).items()}, "acceptance": raw.get("acceptance", {}) | ({"documents": place(raw["acceptance"]["documents"])} if raw.get("acceptance", {}).get("documents") else {})}
    rest |= {k: place(raw[k]) for k in ("envelope", "published") if raw.get(k)}
    if raw.get("storage"):
        rest["storage"] = StorageRelease(**raw["storage"])
    config = Config(pixels=place(raw["pixels"]), design=design, model=model, output=place(raw.get("output", "outputs")), qa=place(raw["qa"]) if raw.get("qa") else None, **rest)
    check_frozen(config)
    return config


def check_frozen(config: Config) -> None:
    """Every frozen model value must be the configured one, and the lag a delay."""
    if config.lag_convention != LAG_CONVENTION:
        raise ValueError(f"the lag convention must be {LAG_CONVENTION}")
    wrong = {k: (getattr(config.model, k, None), v) for k, v in config.frozen.items() if getattr(config.model, k, None) != v}
    if wrong:
        raise ValueError(f"values differ from the frozen ones: {wrong}")


def fold_name(fold: int) -> str:
    return f"fold_{fold:02d}"
