"""Settings of the library's operators (S-13): a frozen record, overridable by a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

# Settings that results must agree on, in the order of their use.
NAME_PATTERNS = ("screenshot", "screen shot", "화면 캡처", "화면캡처", "스크린샷", "scr_")
SCREENS = (
    (1280, 720), (1366, 768), (1440, 900), (1536, 864), (1600, 900), (1920, 1080), (1920, 1200), (2560, 1440), (2560, 1600), (3840, 2160),
    (750, 1334), (828, 1792), (1080, 1920), (1080, 2340), (1125, 2436), (1170, 2532), (1179, 2556), (1284, 2778), (1290, 2796), (1440, 3200),
)
PRESETS = {
    "person": {"sharpness": 0.30, "exposure": 0.20, "contrast": 0.10, "eyes_open": 0.40},
    "landscape": {"sharpness": 0.40, "exposure": 0.30, "contrast": 0.30, "eyes_open": 0.00},
}


@dataclass(frozen=True)
class Config:
    hamming_threshold: int = 5
    phash_bits: int = 64
    burst_seconds: float = 3.0
    burst_hamming_threshold: int = 10
    burst_max_window: int = 200
    thumb_size: int = 256
    blur_laplacian_threshold: float = 100.0
    blur_min_brightness: float = 40.0
    document_white_ratio: float = 0.55
    document_min_edge_density: float = 0.02
    screenshot_name_patterns: tuple[str, ...] = NAME_PATTERNS
    screenshot_resolutions: tuple[tuple[int, int], ...] = SCREENS
    quality_presets: dict[str, dict[str, float]] = field(default_factory=lambda: {k: dict(v) for k, v in PRESETS.items()})

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_dict(values: dict[str, Any]) -> Config:
        """Known keys replace defaults; unknown ones are ignored, lists become tuples."""
        known = {f.name for f in fields(Config)}
        freeze = lambda v: tuple(freeze(x) for x in v) if isinstance(v, list) else v
        return Config(**{k: freeze(v) for k, v in values.items() if k in known})

    @staticmethod
    def load(path: str | Path | None = None) -> Config:
        """From a TOML file's [thresholds] section, or its top level; the defaults where there is no file."""
        if path is None or not Path(path).is_file():
            return Config()
        with open(path, "rb") as f:
            found = tomllib.load(f)
        return Config.from_dict(found.get("thresholds", found))
