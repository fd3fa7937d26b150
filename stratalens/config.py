"""Settings from defaults, files, their .local companions and the environment, in rising order of precedence."""

from __future__ import annotations

import ast
import copy
import json
import os
import re
import tempfile
import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from stratalens.errors import ConfigError

PREFIX = "STRATALENS_"
DEFAULTS: dict[str, Any] = {
    "hash_algorithm": "sha256", "perceptual_hash_distance_threshold": 8, "recursive": True, "symlink_policy": "skip", "workers": 1, "dry_run": True,
    "cache": {"enabled": True, "directory": "~/.cache/stratalens"}, "paths": {"exclude_patterns": []}, "organize": {"max_depth": None},
    "routing": {"enabled": True, "min_confidence": 0.75, "keep_dated_layout": True, "screenshots": "Screenshots", "graphics": "Graphics", "live_photos": "LivePhotos", "ai_generated": "AI-Generated", "review": "Review", "duplicates": "Duplicates"},
}


# The words that are true; everything else is false.
TRUE_WORDS = ("t", "true", "enabled", "1", "on", "yes")


def _boolean(text: str) -> bool:
    return text.strip().lower() in TRUE_WORDS


def _json(text: str) -> Any:
    """JSON; else the first object within the text, Python's constants after colons allowed; else a Python literal."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        pass
    relaxed = re.sub(r"(: ?)(True|False|None)", lambda m: m[1] + {"True": "true", "False": "false", "None": "null"}[m[2]], text)
    for brace in (m.start() for m in re.finditer(r"\{", relaxed)):
        try:
            return json.JSONDecoder().raw_decode(relaxed[brace:])[0]
        except ValueError:
            continue
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError) as error:
        raise ValueError(f"not JSON: {text}") from error


# The cast markers that values may begin with, and those that are refused.
CASTS: dict[str, Callable[[str], Any]] = {
    "@str": str, "@int": int, "@float": float, "@bool": _boolean, "@json": _json, "@none": lambda _: None, "@null": lambda _: None, "@note": lambda _: None, "@comment": lambda _: None,
    "@upper": str.upper, "@lower": str.lower, "@title": str.title, "@capitalize": str.capitalize, "@strip": str.strip, "@lstrip": str.lstrip, "@rstrip": str.rstrip, "@split": str.split,
    "@casefold": str.casefold, "@swapcase": str.swapcase,
}
REFUSED = ("@format", "@jinja", "@get", "@read_file", "@reset", "@del", "@merge", "@merge_unique", "@insert", "@empty")


def cast(text: str) -> Any:
    """The value of a text: by its marker, or the text itself."""
    head, _, rest = text.partition(" ")
    second = rest.partition(" ")[0]
    if head in REFUSED or (head in CASTS and second in ("@jinja", "@format", "@read_file", "@get")):
        raise ConfigError(f"marker not supported: {head if head in REFUSED else second}")
    if head not in CASTS:
        return text
    try:
        return CASTS[head](rest)
    except ValueError as error:
        raise ConfigError(f"cannot cast {rest!r} with {head}") from error


def env_value(text: str) -> Any:
    """A marker, else a TOML value (with True and False as well), else the text."""
    plain = text.lower() if text.strip() in ("True", "False") else text
    if plain.partition(" ")[0] in (*CASTS, *REFUSED):
        return cast(plain)
    try:
        return tomllib.loads(f"v={plain}")["v"]
    except (tomllib.TOMLDecodeError, KeyError):
        return plain


def from_environment(environ: Mapping[str, str], prefix: str = PREFIX) -> dict[str, Any]:
    """PREFIX_A__B=x as {"a": {"b": x}}."""
    out: dict[str, Any] = {}
    for name in sorted(environ):
        if name.startswith(prefix):
            *path, last = name[len(prefix) :].lower().split("__")
            spot = out
            for key in path:
                spot = spot.setdefault(key, {})
            spot[last] = env_value(environ[name])
    return out


def merge(old: Any, new: Any) -> Any:
    """Maps merge key by key, different lists join, anything else is replaced."""
    if isinstance(old, dict) and isinstance(new, dict):
        return {k: merge(old[k], new[k]) if k in old and k in new else new.get(k, old.get(k)) for k in [*old, *(k for k in new if k not in old)]}
    if isinstance(old, list) and isinstance(new, list) and old != new:
        return old + new
    return new


def _lower(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k).lower(): _lower(v) for k, v in value.items()}
    return [_lower(v) for v in value] if isinstance(value, list) else cast(value) if isinstance(value, str) else value


def read_file(path: Path) -> dict[str, Any]:
    """A TOML, JSON or YAML document; other kinds are refused."""
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".toml":
        data = tomllib.loads(text)
    elif path.suffix == ".json":
        data = json.loads(text or "{}")
    elif path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as error:
            raise ConfigError("YAML needs the yaml package", file_path=str(path)) from error
        data = yaml.safe_load(text) or {}
    else:
        raise ConfigError("not a configuration format", file_path=str(path))
    if not isinstance(data, Mapping):
        raise ConfigError("a configuration must be a mapping", file_path=str(path))
    return _lower(data)


def check(config: dict[str, Any]) -> dict[str, Any]:
    """Known keys only below the top, values of the defaults' kinds and within bounds."""

    def walk(have: dict, want: dict, at: str) -> None:
        for key, value in have.items():
            if key not in want:
                raise ConfigError(f"unknown setting {at}{key}")
            if isinstance(want[key], dict):
                if not isinstance(value, dict):
                    raise ConfigError(f"{at}{key} must be a mapping")
                walk(value, want[key], f"{at}{key}.")
            elif want[key] is not None and value is not None and not isinstance(value, (int, float) if isinstance(want[key], float) else type(want[key])):
                raise ConfigError(f"{at}{key} must be of type {type(want[key]).__name__}")

    walk(config, DEFAULTS, "")
    if not 0 <= config["routing"]["min_confidence"] <= 1 or config["perceptual_hash_distance_threshold"] < 0 or config["workers"] < 1:
        raise ConfigError("a setting is out of bounds")
    if config["symlink_policy"] not in ("skip", "follow", "error"):
        raise ConfigError("unknown symlink policy")
    return config


def load(path: str | Path | None = None, environ: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Unknown top-level keys are dropped; anything else unknown is an error."""
    config = copy.deepcopy(DEFAULTS)
    layers: list[dict[str, Any]] = []
    if path:
        path = Path(path)
        layers += [read_file(p) for p in (path, path.with_name(f"{path.stem}.local{path.suffix}")) if p.exists()]
    layers.append(from_environment(os.environ if environ is None else environ))
    for layer in layers:
        config = merge(config, {k: v for k, v in layer.items() if k in DEFAULTS})
    return check(config)


def write(path: Path, config: dict[str, Any]) -> None:
    """JSON, replaced as a whole."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as file:
        json.dump(config, file, indent=2, sort_keys=True)
        file.flush()
        os.fsync(file.fileno())
    os.replace(file.name, path)


def initialise(path: Path) -> dict[str, Any]:
    """A file with all defaults; an existing one is not overwritten."""
    if path.exists():
        raise ConfigError("the file exists already", details={"path": str(path)})
    write(path, DEFAULTS)
    return load(path)


def set_value(path: Path, dotted: str, value: Any) -> dict[str, Any]:
    """Set one setting in a file that otherwise stays as sparse as it is."""
    data = read_file(path) if path.exists() else {}
    spot = data
    *parents, last = re.split(r"\.", dotted)
    for key in parents:
        spot = spot.setdefault(key, {})
    spot[last] = value
    check(merge(copy.deepcopy(DEFAULTS), data))
    write(path, data)
    return data
