"""Configuration: dataclasses, presets, precedence and interpolation."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.2
    by_populations: bool = False
    seed: int = 0


@dataclass(frozen=True)
class SimConfig:
    simulate: bool = True
    strategy: str = "random"
    prop: float = 0.2


@dataclass(frozen=True)
class ModelConfig:
    latent: int = 4
    hidden: int = 1
    epochs: int = 60
    neighbours: int = 10
    rounds: int = 2


@dataclass(frozen=True)
class Config:
    split: SplitConfig = field(default_factory=SplitConfig)
    sim: SimConfig = field(default_factory=SimConfig)
    model: ModelConfig = field(default_factory=ModelConfig)


PRESETS: dict[str, dict[str, Any]] = {
    "fast": {"model.epochs": 20, "model.rounds": 1, "model.neighbours": 5},
    "balanced": {},
    "thorough": {"model.epochs": 200, "model.rounds": 5, "model.neighbours": 20},
}


def coerce(value: Any, current: Any) -> Any:
    """A given value as the type of the current one; an empty string keeps the current."""
    if not isinstance(value, str):
        return value
    if value == "" and not isinstance(current, str):
        return current
    if isinstance(current, bool):
        return value.strip().lower() in ("true", "1", "yes", "on")
    if isinstance(current, int):
        return int(value)
    if isinstance(current, float):
        return float(value)
    return value


def override(config: Any, changes: Mapping[str, Any]) -> Any:
    """A new configuration with dotted keys set; an unknown key raises KeyError."""
    for key, value in changes.items():
        head, _, rest = key.partition(".")
        if not dataclasses.is_dataclass(config) or head not in {f.name for f in dataclasses.fields(config)}:
            raise KeyError(key)
        current = getattr(config, head)
        if rest:
            new = override(current, {rest: value})
        elif dataclasses.is_dataclass(current):
            new = override(current, value)
        else:
            new = coerce(value, current)
        config = dataclasses.replace(config, **{head: new})
    return config


def interpolate(text: str, environment: Mapping[str, str] | None = None) -> str:
    """``${VAR}`` and ``${VAR:default}``; an unset one without default, or one not closed, stays."""
    environment = os.environ if environment is None else environment
    return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: environment.get(m[1], m[2] if m[2] is not None else m[0]), text)


def flatten(tree: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in tree.items():
        out |= flatten(value, f"{prefix}{key}.") if isinstance(value, Mapping) else {prefix + key: interpolate(value) if isinstance(value, str) else value}
    return out


def effective(preset: str | None = None, document: Mapping[str, Any] | str | None = None, flags: Mapping[str, Any] | None = None, sets: Mapping[str, Any] | None = None) -> Config:
    """Defaults < preset < document < flags < sets. A document is a mapping, JSON, YAML, or the path of a file of these."""
    document = read_document(document)
    preset = preset or document.pop("preset", None)
    if preset is not None and preset not in PRESETS:
        raise KeyError(preset)
    config = override(Config(), PRESETS[preset or "balanced"])
    for layer in (flatten(document), flags or {}, sets or {}):
        config = override(config, layer)
    return config


def read_document(document: Mapping[str, Any] | str | None) -> dict[str, Any]:
    """A mapping as it is; a string as JSON or YAML text, or as the path of such a file."""
    if document is None or isinstance(document, Mapping):
        return dict(document or {})
    if document.endswith((".yaml", ".yml", ".json")):
        with open(document) as file:
            document = file.read()
    if document.lstrip().startswith("{"):
        return json.loads(document)
    import yaml

    return yaml.safe_load(document) or {}


def effective_parameters(base: Any, presets: Mapping[str, Mapping[str, Any]], preset: str | None, document: Mapping[str, Any] | str | None, sets: Mapping[str, Any]) -> Any:
    """One model's parameters: base < preset (the document may name it) < document < sets; unknown presets and keys raise KeyError."""
    document = read_document(document)
    preset = preset or document.pop("preset", None)
    for layer in (presets[preset] if preset else {}, flatten(document), sets):
        base = override(base, layer)
    return base


def best_parameters(text: str, aliases: Mapping[str, str] | None = None, ignored: tuple[str, ...] = ()) -> dict[str, Any]:
    """Saved best parameters as dotted changes, aliases applied, derived keys left out."""
    aliases = aliases or {}
    return {f"model.{aliases.get(k, k)}": v for k, v in json.loads(text).items() if k not in ignored}
