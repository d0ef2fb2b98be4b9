"""Named steps and detectors."""

from __future__ import annotations

from typing import Any

from .errors import PluginRegistrationError


def _text(x: Any) -> bool:
    return isinstance(x, str) and x != ""


class Registry:
    def __init__(self) -> None:
        self._steps: dict[str, Any] = {}
        self._detectors: dict[str, Any] = {}

    def register_step(self, name: str, step: Any) -> None:
        for part in ("name", "version"):
            if not _text(getattr(step, part, None)):
                raise PluginRegistrationError(f"Step '{name}' must have a non-empty '{part}' string.")
        if not callable(getattr(step, "apply", None)):
            raise PluginRegistrationError(f"Step '{name}' must implement apply(chunks, run).")
        if name in self._steps:
            raise PluginRegistrationError(f"Step '{name}' is already registered. Use a unique name.")
        self._steps[name] = step

    def register_detector(self, name: str, detector: Any) -> None:
        if not _text(getattr(detector, "version", None)):
            raise PluginRegistrationError(f"Detector '{name}' must have a non-empty 'version' string.")
        if not callable(getattr(detector, "redact", None)):
            raise PluginRegistrationError(f"Detector '{name}' must implement redact(column).")
        if name in self._detectors:
            raise PluginRegistrationError(f"Detector '{name}' is already registered. Use a unique name.")
        self._detectors[name] = detector

    def step(self, name: str) -> Any:
        return self._find(self._steps, name, "Step", "steps")

    def detector(self, name: str) -> Any:
        return self._find(self._detectors, name, "Detector", "detectors")

    def has_step(self, name: str) -> bool:
        return name in self._steps

    @staticmethod
    def _find(held: dict, name: str, kind: str, many: str) -> Any:
        if name not in held:
            raise PluginRegistrationError(f"{kind} '{name}' is not registered. Available {many}: [{', '.join(held)}]")
        return held[name]
