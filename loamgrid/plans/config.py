"""Configuration of a scene analysis: defaults, files, environment, dotted access."""

from __future__ import annotations

import copy
import json
import os
from dataclasses import dataclass, field

from loamgrid.scene import CLASSES

DEFAULTS = {
    "runtime": {"random_seed": 42},
    "data": {"hyperspectral": {"wavelength_range": [400.0, 2500.0], "nodata_value": -9999.0}, "samples": {"train_ratio": 0.7, "val_ratio": 0.15, "test_ratio": 0.15}},
    "preprocessing": {"radiometric": {"enabled": True, "method": "TOA"}, "atmospheric": {"enabled": True, "method": "DOS"}, "noise_reduction": {"enabled": True, "method": "savgol", "window_size": 5, "polynomial_order": 2}},
    "features": {"indices": ["ndvi", "ndwi", "mndwi"], "derivative": True},
    "classification": {"type": "rf"},
    "postprocessing": {"method": "standard"},
    "landscape": {"enabled": True, "pixel_size": 1.0},
    "classes": {i: {"name": n} for i, n in CLASSES.items()},
}


def merge(a: dict, b: dict) -> dict:
    """b over a, dict by dict."""
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass
class Config:
    values: dict = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    def __post_init__(self) -> None:
        # Files key classes by name with an id inside; ids are what the plan uses.
        classes = self.values.get("classes", {})
        self.values["classes"] = {int(v.get("id", k)): {**v, "name": v.get("name", k)} for k, v in classes.items()}
        self.check()

    def check(self) -> None:
        s = self.get("data.samples", {})
        total = sum(s.get(f"{k}_ratio", 0) for k in ("train", "val", "test"))
        if abs(total - 1) > 1e-6:
            raise ValueError(f"sample ratios sum to {total}, not 1")

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        base = copy.deepcopy(DEFAULTS)
        if "classes" in values:
            base.pop("classes")
        return cls(merge(base, values))

    @classmethod
    def from_file(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {})
        if path.endswith(".toml"):
            import tomllib

            return cls.from_dict(tomllib.loads(text))
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        raise ValueError(f"unsupported configuration format: {path}")

    @classmethod
    def from_env(cls, prefix: str = "LOAMGRID_") -> Config:
        out: dict = {}
        for name, text in os.environ.items():
            if name.startswith(prefix):
                try:
                    value = json.loads(text)
                except ValueError:
                    value = text
                at = out
                *path, last = name[len(prefix) :].lower().split("__")
                for part in path:
                    at = at.setdefault(part, {})
                at[last] = value
        return cls.from_dict(out)

    def get(self, key: str, default=None):
        at = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, key: str, value) -> None:
        *path, last = key.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value

    def update(self, values: dict) -> None:
        self.values = merge(self.values, values)
        self.check()

    def to_dict(self) -> dict:
        return copy.deepcopy(self.values)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                yaml.safe_dump(self.values, f)
            else:
                json.dump(self.values, f, indent=2)

    def class_names(self) -> list[str]:
        return [v["name"] for _, v in sorted(self.values["classes"].items())]
