"""Configuration on the driver: overlays, argument checks, named profiles."""

from __future__ import annotations

import os
from collections.abc import Mapping


def overlay(base: Mapping, changes: Mapping, path: str = "") -> dict:
    """``base`` with the nested ``changes``; unknown keys are refused, keys that start
    with ``_`` are comments, a mapping cannot replace a value or the reverse."""
    out = dict(base)
    for key, value in changes.items():
        if str(key).startswith("_"):
            continue
        at = f"{path}.{key}" if path else str(key)
        if key not in base:
            raise KeyError(f"unknown setting {at}")
        if isinstance(base[key], Mapping) != isinstance(value, Mapping):
            raise TypeError(f"setting {at} has another shape")
        out[key] = overlay(base[key], value, at) if isinstance(value, Mapping) else value
    return out


def named_profile(profiles: Mapping[str, Mapping], name: str, aliases: Mapping[str, str] | None = None, size: int | None = None) -> dict:
    """A profile by name or alias; ``size`` must be the profile's own if given."""
    key = name.strip().lower()
    key = (aliases or {}).get(key, key)
    if key not in profiles:
        raise KeyError(f"unknown profile {name!r}; known are {', '.join(sorted(profiles))}")
    found = dict(profiles[key])
    if size is not None and found.get("size") not in (None, size):
        raise ValueError(f"profile {key!r} has size {found['size']}, not {size}")
    return found


def check_split_arguments(sealed: float, calibration: float, folds: int, inputs: Mapping[str, str] | None = None, output: str | None = None) -> None:
    """Fractions strictly between 0 and 1, at least two folds, inputs there, output not."""
    for name, x in (("sealed fraction", sealed), ("calibration fraction", calibration)):
        if not 0 < x < 1:
            raise ValueError(f"{name} must lie between 0 and 1")
    if folds < 2:
        raise ValueError("at least two folds are needed")
    for name, path in (inputs or {}).items():
        if not os.path.exists(path):
            raise FileNotFoundError(f"{name}: {path}")
    if output and os.path.exists(output) and os.listdir(output):
        raise FileExistsError(output)


def beside(path: str, *names: str) -> str | None:
    """First of ``names`` that exists in the folder of ``path``."""
    folder = os.path.dirname(path)
    return next((p for n in names if os.path.exists(p := os.path.join(folder, n))), None)


IMAGENET = {"mean": (0.485, 0.456, 0.406), "std": (0.229, 0.224, 0.225)}
XCEPTION = {"mean": (0.5, 0.5, 0.5), "std": (0.5, 0.5, 0.5)}
#: How pictures are brought to the size a model was trained on.
PROFILES = {
    "legacy_256_imagenet": {"size": 256, "resize": "square_warp", **IMAGENET},
    "xception_256": {"size": 256, "resize": "square_warp", **XCEPTION},
    "padded_256_imagenet": {"size": 256, "resize": "aspect_pad", **IMAGENET},
    "padded_320_imagenet": {"size": 320, "resize": "aspect_pad", **IMAGENET},
    "padded_256_xception": {"size": 256, "resize": "aspect_pad", **XCEPTION},
    "padded_320_xception": {"size": 320, "resize": "aspect_pad", **XCEPTION},
}
PROFILE_ALIASES = {
    "legacy_imagenet": "legacy_256_imagenet",
    "legacy": "legacy_256_imagenet",
    "xception": "xception_256",
    "padded_256": "padded_256_imagenet",
    "padded_320": "padded_320_imagenet",
}


def picture_profile(name: str, size: int | None = None) -> dict:
    """The profile of a name or alias, at another size if one is given; sizes are positive
    multiples of sixteen."""
    found = named_profile(PROFILES, name, PROFILE_ALIASES)
    found["size"] = int(found["size"] if size is None else size)
    if found["size"] <= 0 or found["size"] % 16:
        raise ValueError("the size must be a positive multiple of 16")
    return found | {"name": PROFILE_ALIASES.get(name.strip().lower(), name.strip().lower())}
