"""Run events as JSON lines; no transcript text is ever written."""

from __future__ import annotations

import json
import sys
from datetime import datetime, timezone
from typing import Any, TextIO

LEVELS = {"debug": 0, "info": 1, "warn": 2, "error": 3}


class EventLog:
    def __init__(self, level: str = "info", out: TextIO | None = None):
        self.least, self.out = LEVELS[level], out

    def wants(self, level: str) -> bool:
        return LEVELS[level] >= self.least

    def write(self, level: str, **entry: Any) -> None:
        if not self.wants(level):
            return
        now = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        print(json.dumps({"timestamp": now, "level": level, **entry}, default=str), file=self.out or sys.stderr, flush=True)


def safe_message(error: Exception, text: str | None = None, longest: int = 200) -> str:
    """An error for logs: the text it is about is cut out, and long messages are cut off."""
    message = f"{type(error).__name__}: {error}"
    if text:
        message = message.replace(text, "[REDACTED_TRANSCRIPT]")
    return message[:longest]
