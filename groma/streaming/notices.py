"""Notices of a user interface as a stream of what is on show: equal kinds are gathered, a few groups are visible, urgent ones come first.

The order of events decides, so this is a fold, one queue for each user.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from groma.operators.ordered import folded

#: Groups on show and waiting, and seconds on show by urgency.
VISIBLE, WAITING = 3, 3
URGENCY = {"failed": 2, "error": 2, "cancelled": 1}
SECONDS = {0: 7.0, 1: 7.0, 2: 12.0}


@dataclass
class Group:
    number: int
    kind: str
    keys: set[str] = field(default_factory=set)
    until: float | None = None

    def order(self) -> tuple[int, int]:
        return -URGENCY.get(self.kind, 0), self.number


class Queue:
    def __init__(self) -> None:
        self.shown: list[Group] = []
        self.waiting: list[Group] = []
        self.next = 1

    def advance(self, clock: float) -> None:
        """Drops what has been shown long enough, and shows what waits while there is room. A group's time runs on once it has been shown."""
        alive = lambda groups: [g for g in groups if g.until is None or g.until > clock]
        self.shown, self.waiting = alive(self.shown), sorted(alive(self.waiting), key=Group.order)
        while self.waiting and len(self.shown) < VISIBLE:
            g = self.waiting.pop(0)
            g.until = clock + SECONDS[URGENCY.get(g.kind, 0)] if g.until is None else g.until
            self.shown.append(g)

    def take(self, clock: float, kind: str, key: str) -> list[Group]:
        """Adds an event and returns what is on show then."""
        self.advance(clock)
        held = self.shown + self.waiting
        if any(key in g.keys for g in held):
            return self.shown
        same = next((g for g in held if g.kind == kind), None)
        if same is not None:
            same.keys.add(key)
            return self.shown
        new = Group(self.next, kind, {key})
        self.next += 1
        self.waiting.append(new)
        if len(self.shown) == VISIBLE:
            least = min(self.shown, key=lambda g: (URGENCY.get(g.kind, 0), g.number))
            if URGENCY.get(kind, 0) > URGENCY.get(least.kind, 0):
                self.shown.remove(least)
                self.waiting.append(least)
        self.advance(clock)
        self.waiting = self.waiting[:WAITING]  # what is left out is still in its project
        return self.shown


    def step(self, clock: float, kind: str, key: str) -> tuple[str]:
        return (",".join(f"{g.kind}:{len(g.keys)}" for g in self.take(clock, kind, key)),)

    def state(self) -> str:
        """Groups by their order of coming alone: what has left counts no more, so queues that began apart become equal."""
        place = {g.number: i for i, g in enumerate(sorted(self.shown + self.waiting, key=lambda g: g.number), 1)}
        spelled = lambda groups: [[place[g.number], g.kind, sorted(g.keys), g.until] for g in groups]
        return json.dumps([spelled(self.shown), spelled(self.waiting)])

    def restore(self, state: str) -> None:
        shown, waiting = json.loads(state)
        group = lambda number, kind, keys, until: Group(number, kind, set(keys), until)
        self.shown, self.waiting = [group(*g) for g in shown], [group(*g) for g in waiting]
        self.next = len(shown) + len(waiting) + 1


def notices(events: DataFrame) -> DataFrame:
    """user_id, clock, event_id, kind, key -> after each event what is on show: kind and number of events of each group, in the order shown.

    A queue forgets within seconds, so the ranges of a user with very many events soon agree.
    """
    rows = events.select("user_id", "clock", "event_id", "kind", "key")
    found = folded(rows, keys=["user_id"], order=["clock", "event_id"], reads=["clock", "kind", "key"], machine=Queue, gives="shown string")
    return found.select("user_id", "clock", "event_id", "shown")
