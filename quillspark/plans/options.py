"""Options and limits of a plan, checked before any job runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace

PRESETS = ("conservative", "balanced", "aggressive")


@dataclass(frozen=True)
class Limits:
    """What a package may hold."""

    archive_bytes: int = 16 << 30
    entries: int = 50_000
    total_bytes: int = 32 << 30
    entry_bytes: int = 8 << 30
    ratio: int = 1000
    ratio_above: int = 1 << 20
    text_bytes: int = 128 << 20
    name_bytes: int = 1024
    path_depth: int = 64
    xml_depth: int = 512
    json_depth: int = 256
    image_pixels: int = 100_000_000
    image_bytes: int = 256 << 20
    video_bytes: int = 8 << 30
    video_seconds: int = 6 * 3600
    pdf_bytes: int = 512 << 20


BROWSER = Limits(archive_bytes=8 << 30, total_bytes=16 << 30, entry_bytes=4 << 30, text_bytes=64 << 20, image_pixels=40_000_000, image_bytes=64 << 20, video_bytes=1 << 30, video_seconds=2 * 3600, pdf_bytes=256 << 20)


def limits(base: Limits = Limits(), **own: int) -> Limits:  # noqa: B008
    known = {f.name for f in fields(Limits)}
    for k, v in own.items():
        if k not in known:
            raise ValueError(f"unknown limit: {k}")
        if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
            raise ValueError(f"{k} must be a whole number over 0")
    return replace(base, **own)


#: The range of each number.
RANGES = {"crf": (16, 35), "audio_kbps": (64, 320), "jpeg_quality": (30, 100), "webp_quality": (30, 100), "max_side": (64, 20_000), "min_saving_percent": (0, 90), "min_saving_bytes": (0, 1 << 40)}


@dataclass(frozen=True)
class Options:
    preset: str = "balanced"
    crf: int = 23
    audio_kbps: int = 128
    jpeg_quality: int = 82
    webp_quality: int = 82
    max_side: int | None = 1920
    min_saving_percent: float = 5
    min_saving_bytes: int = 1024
    force: bool = False
    remove_unused: bool = False
    merge_duplicates: bool = False
    clean_names: bool = False

    def canonical(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


#: What a preset stands for.
VALUES = {
    "conservative": {"crf": 20, "audio_kbps": 192, "jpeg_quality": 90, "webp_quality": 90, "max_side": 2560},
    "balanced": {"crf": 23, "audio_kbps": 128, "jpeg_quality": 82, "webp_quality": 82, "max_side": 1920},
    "aggressive": {"crf": 28, "audio_kbps": 96, "jpeg_quality": 72, "webp_quality": 75, "max_side": 1600},
}


def options(**own) -> Options:
    """The preset's values with own ones in their place; unknown names and values out of range are refused."""
    preset = own.get("preset", "balanced")
    if preset not in PRESETS:
        raise ValueError(f"preset must be one of {', '.join(PRESETS)}")
    kinds = {f.name: f.type for f in fields(Options)}
    for k, v in own.items():
        if k not in kinds:
            raise ValueError(f"unknown option: {k}")
        if kinds[k] == "bool" and not isinstance(v, bool):
            raise ValueError(f"{k} must be true or false")
        if k in RANGES and not (v is None and k == "max_side"):
            low, high = RANGES[k]
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not low <= v <= high:
                raise ValueError(f"{k} must be between {low} and {high}")
    return Options(**({"preset": preset} | VALUES[preset] | own))
