"""What a run is asked for: the request, its YAML form, and its errors."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from veldt.errors import ConfigurationError


@dataclass(frozen=True)
class Request:
    before_folder: str
    after_folder: str
    aoi_path: str | None
    output_dir: str
    run_label: str = "run"
    normalization: str = "robust_median_mad"
    reflectance_scale: float = 10000.0
    nodata_value: float = 0.0
    method: str = "both"
    threshold_method: str = "otsu"
    percentile: float = 95.0
    manual_threshold: float | None = None
    morphology_enabled: bool = True
    morphology_operation: str = "opening_then_closing"
    morphology_kernel_size: int = 3
    fill_holes: bool = False
    min_area_m2: float = 400.0
    spatial_statistics_enabled: bool = True
    spatial_grid_size_m: float = 150.0
    spatial_weights: str = "queen"
    knn_k: int = 8
    row_standardization: bool = True
    permutations: int = 999
    alpha: float = 0.05
    fdr_correction: bool = True
    spatial_ml_enabled: bool = False
    ml_model: str = "isolation_forest"
    ml_n_estimators: int = 200
    ml_contamination: float = 0.1
    ml_n_bootstrap: int = 20
    dbscan_eps: float = 1.5
    dbscan_min_samples: int = 5
    ml_use_coordinates: bool = False
    random_seed: int = 42
    processed_dir: str | None = None
    write_stacks: bool = True
    write_intermediate: bool = True
    create_interactive_map: bool = True
    create_qgis_styles: bool = True

    @property
    def grid_size_m(self) -> float:
        return self.spatial_grid_size_m

    def parameters(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("before_folder", "after_folder", "aoi_path", "output_dir", "processed_dir")}


#: Where each field stands in a configuration file, section, then keys; what can't be chosen stands below.
YAML = {
    "before_folder": "paths.before_folder", "after_folder": "paths.after_folder", "aoi_path": "paths.aoi", "output_dir": "paths.output_dir",
    "normalization": "preprocessing.normalization", "reflectance_scale": "preprocessing.reflectance_scale", "nodata_value": "preprocessing.nodata_value",
    "method": "change_detection.method", "threshold_method": "change_detection.threshold_method", "percentile": "change_detection.percentile", "manual_threshold": "change_detection.manual_threshold",
    "morphology_enabled": "change_detection.morphology.enabled", "morphology_operation": "change_detection.morphology.operation", "morphology_kernel_size": "change_detection.morphology.structure_size",
    "fill_holes": "change_detection.morphology.fill_holes", "min_area_m2": "change_detection.min_area_m2",
    "spatial_statistics_enabled": "spatial_statistics.enabled", "spatial_grid_size_m": "spatial_statistics.grid_size_m", "spatial_weights": "spatial_statistics.weights", "knn_k": "spatial_statistics.knn_k",
    "row_standardization": "spatial_statistics.row_standardization", "permutations": "spatial_statistics.permutations", "alpha": "spatial_statistics.alpha", "fdr_correction": "spatial_statistics.fdr_correction",
    "spatial_ml_enabled": "spatial_ml.enabled", "ml_model": "spatial_ml.model", "ml_n_estimators": "spatial_ml.n_estimators", "dbscan_eps": "spatial_ml.clustering.eps", "dbscan_min_samples": "spatial_ml.clustering.min_samples",
    "ml_use_coordinates": "spatial_ml.use_coordinates", "ml_contamination": "spatial_ml.contamination", "ml_n_bootstrap": "spatial_ml.n_bootstrap", "random_seed": "run.random_seed",
    "processed_dir": "paths.processed_dir", "write_stacks": "output.write_stacks", "write_intermediate": "output.write_intermediate", "create_interactive_map": "output.create_interactive_map",
    "create_qgis_styles": "output.create_qgis_styles",
}
FIXED = {"preprocessing.resampling": "bilinear", "preprocessing.reference_date": "before", "spatial_ml.clustering.algorithm": "dbscan"}


def _at(config: dict, place: str):
    for k in place.split("."):
        config = config.get(k) if isinstance(config, dict) else None
    return config


def from_config(config: dict, base: str = ".") -> Request:
    """A request from a parsed configuration. Unknown keys are ignored; the three input paths must be there, and what can't be
    chosen must be as it is."""
    found = {}
    for place, only in FIXED.items():
        if (told := _at(config, place)) not in (None, only):
            raise ConfigurationError(f"{place} is always {only}", detail=str(told))
    for name, place in YAML.items():
        if (told := _at(config, place)) is not None:
            found[name] = told
    missing = [k for k in ("before_folder", "after_folder", "aoi_path") if k not in found]
    if missing:
        raise ConfigurationError(f"missing in paths: {', '.join(missing)}")
    found.setdefault("output_dir", "outputs")
    for k in ("before_folder", "after_folder", "aoi_path", "output_dir", *(["processed_dir"] if "processed_dir" in found else [])):
        found[k] = str(Path(base) / str(found[k]))
    if found.get("ml_model") == "hdbscan":
        raise ConfigurationError("hdbscan is not available: take dbscan")
    kinds = {f.name: f.type for f in fields(Request)}
    cast = {"float": float, "int": int, "bool": bool, "str": str, "float | None": float, "str | None": str}
    return Request(**{k: cast[kinds[k]](v) for k, v in found.items()})


def load(path: str, base: str | None = None, **overrides) -> Request:
    import yaml

    if not Path(path).exists():
        raise ConfigurationError(f"no configuration at {path}")
    try:
        told = yaml.safe_load(Path(path).read_text()) or {}
    except yaml.YAMLError as e:
        raise ConfigurationError(f"the configuration at {path} is not YAML", detail=str(e)) from e
    request = from_config(told, base or ".")
    return replace(request, **{k: v for k, v in overrides.items() if v is not None})


def to_config(request: Request) -> dict:
    """The configuration that gives this request; an unset folder for stacks is left out."""
    out: dict = {}
    told = {place: getattr(request, name) for name, place in YAML.items()}
    if request.processed_dir is None:
        del told["paths.processed_dir"]
    for place, value in (told | FIXED).items():
        at = out
        *sections, key = place.split(".")
        for s in sections:
            at = at.setdefault(s, {})
        at[key] = value
    return out
