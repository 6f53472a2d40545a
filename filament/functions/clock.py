"""The master clock of a replay: time runs only while playing."""

from __future__ import annotations

import time
from collections.abc import Callable


class MasterClock:
    """Position in milliseconds; play and pause may be repeated, seeks never go below zero."""

    def __init__(self, now: Callable[[], float] = time.monotonic):
        self._now, self._base, self._since = now, 0.0, None

    @property
    def playing(self) -> bool:
        return self._since is not None

    @property
    def t_ms(self) -> int:
        run = 0.0 if self._since is None else (self._now() - self._since) * 1000
        return int(self._base + run)

    def play(self) -> None:
        if self._since is None:
            self._since = self._now()

    def pause(self) -> None:
        if self._since is not None:
            self._base, self._since = float(self._base + (self._now() - self._since) * 1000), None

    def seek(self, t_ms: float) -> None:
        self._base = max(0.0, float(t_ms))
        if self._since is not None:
            self._since = self._now()

    def seek_by(self, delta_ms: float) -> None:
        self.seek(self.t_ms + delta_ms)

    def apply(self, command: str, argument: float | None = None) -> None:
        """A transport command by name; an unknown one is an error."""
        if command in ("play", "pause"):
            getattr(self, command)()
        elif command in ("seek", "seek_by") and argument is not None:
            getattr(self, command)(argument)
        else:
            raise ValueError(f"unknown transport command: {command}")


def broadcast_ms(origin_ms: int, t_ms: int) -> int:
    return origin_ms + t_ms
