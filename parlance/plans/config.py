"""Configuration: a mapping or YAML file, checked once on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from ..operators.redact import Labels
from .errors import PipelineConfigError

SCHEMA_VERSION = "1.0.0"
LOG_LEVELS = ("debug", "info", "warn", "error")
MODES = ("simple", "model")


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 2000
    overlap: int = 100
    max_parallel: int = 4
    memory_limit_mb: int = 512


@dataclass(frozen=True)
class Privacy:
    pii_redaction: bool = True
    pii_detector_plugin: str | None = None
    replacements: Labels = field(default_factory=Labels)


@dataclass(frozen=True)
class StepConfig:
    name: str
    plugin: str
    merge: str | None = None


@dataclass(frozen=True)
class Config:
    steps: tuple[StepConfig, ...]
    chunking: Chunking = field(default_factory=Chunking)
    privacy: Privacy = field(default_factory=Privacy)
    mode: str = "simple"
    log_level: str = "info"
    schema_version: str = SCHEMA_VERSION


#: Names in a file, and ours, with the least value allowed.
_NUMBERS = (("chunkSize", "chunk_size", 1), ("overlap", "overlap", 0), ("maxParallel", "max_parallel", 1), ("memoryLimitMb", "memory_limit_mb", 1))


def _whole(value: Any, least: int) -> int | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
        return None
    return int(value) if value == int(value) and value >= least else None


def _section(raw: dict, name: str) -> dict:
    value = raw.get(name)
    return value if isinstance(value, dict) else {}


def build_config(raw: Any, source: str = "<code>") -> Config:
    """A checked Config; the first fault raises PipelineConfigError. Unknown keys are ignored."""

    def need(ok: Any, message: str) -> None:
        if not ok:
            raise PipelineConfigError(f"Config '{source}': {message}")

    need(isinstance(raw, dict), "must be a YAML/JSON object.")
    version = raw.get("schemaVersion")
    need(isinstance(version, str) and version, "missing required field 'schemaVersion' (string).")
    need(version == SCHEMA_VERSION, f"unsupported schemaVersion '{version}'. Expected '{SCHEMA_VERSION}'.")
    need(isinstance(raw.get("pipeline"), dict), "missing required 'pipeline' section.")
    listed = raw["pipeline"].get("steps")
    need(isinstance(listed, list) and listed, "'pipeline.steps' must be a non-empty array.")
    for i, step in enumerate(listed):
        need(isinstance(step, dict), f"pipeline.steps[{i}] must be an object.")
        for part in ("name", "plugin"):
            need(isinstance(step.get(part), str) and step[part], f"pipeline.steps[{i}] missing '{part}'.")
    mode, level = _section(raw, "output").get("mode"), _section(raw, "logging").get("level")
    need(mode in (None, *MODES), "output.mode must be 'simple' or 'model'.")
    need(level in (None, *LOG_LEVELS), f"logging.level must be one of {', '.join(LOG_LEVELS)}.")

    numbers, given = {}, _section(raw, "chunking")
    for outer, inner, least in _NUMBERS:
        value = _whole(given.get(outer, getattr(Chunking, inner)), least)
        need(value is not None, f"chunking.{outer} must be a {'positive' if least else 'non-negative'} integer.")
        numbers[inner] = value

    given = _section(raw, "privacy")
    on, detector = given.get("piiRedaction", True), given.get("piiDetectorPlugin")
    need(isinstance(on, bool), "privacy.piiRedaction must be boolean.")
    need(detector is None or isinstance(detector, str), "privacy.piiDetectorPlugin must be string or null.")
    labels = given.get("replacements", {"email": Labels.email, "phone": Labels.phone, "name": Labels.name})
    for part in ("email", "phone", "name"):
        need(isinstance(labels, dict) and isinstance(labels.get(part), str) and labels[part], f"privacy.replacements.{part} must be a non-empty string.")
    return Config(
        steps=tuple(StepConfig(s["name"], s["plugin"], s.get("merge")) for s in listed),
        chunking=Chunking(**numbers), privacy=Privacy(on, detector, Labels(labels["email"], labels["phone"], labels["name"])),
        mode=mode or "simple", log_level=level or "info",
    )


def _yaml_loader():
    """YAML 1.2 core scalars: yes, no, on and off are strings, 1e3 is a number."""
    import re

    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:float")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$"), list("-+0123456789."))
    return Loader


def load_config(path: str | None = None) -> Config:
    """The Config in a YAML file, ./pipeline.yaml by default."""
    import yaml

    path = os.path.abspath(path or "pipeline.yaml")
    if not os.path.exists(path):
        raise PipelineConfigError(f"pipeline.yaml not found at '{path}'. Create one or pass an explicit config path.")
    try:
        with open(path, encoding="utf-8") as f:
            raw = yaml.load(f, _yaml_loader())  # noqa: S506  a SafeLoader
    except (yaml.YAMLError, OSError, UnicodeDecodeError) as e:
        raise PipelineConfigError(f"Failed to parse '{path}': {e}") from e
    return build_config(raw, path)
