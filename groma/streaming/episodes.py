"""The alert of a fingerprint, sample by sample: what a batch does with windows, one step at a time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Alert:
    """The latest episode of a fingerprint."""

    episode: int = 0
    first_seen: float = 0.0
    last_seen: float = 0.0
    status: str = ""
    duration: float = 0.0
    critical_duration: float = 0.0
    above: bool = False
    version: int = 0

    def now(self) -> Alert:
        return Alert(self.episode, self.first_seen, self.last_seen, self.status, self.duration, self.critical_duration, self.above, self.version)

    def step(self, clock: float, kind: str, above: bool, allowed: float, visible_after: float) -> list[Alert]:
        """Takes one sample; returns the states to publish (an interrupted episode, and the one that is current)."""
        live, before = self.status in ("open", "unknown"), []
        self.version += 1
        if kind != "F":
            if live:
                self.status = "resolved" if kind == "C" else "interrupted"
                self.last_seen = clock if kind == "C" else self.last_seen
            return [self.now()] if live else []
        gap = clock - self.last_seen
        if not (live and 0 <= gap <= allowed):
            if live:
                self.status = "interrupted"
                before = [self.now()]
            self.episode, self.first_seen, self.duration, self.critical_duration = self.episode + 1, clock, 0.0, 0.0
        else:
            self.duration += gap
            self.critical_duration = self.critical_duration + gap if above and self.above else 0.0
        self.last_seen, self.above = clock, above
        self.status = "open" if self.duration >= visible_after else "unknown"
        return [*before, self.now()]
