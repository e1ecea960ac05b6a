"""The freshness and panic of a session, call by call: one machine for batch tables, streams and replays."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

# fixed values: load, age (ms) and density at which a session degrades and turns stale; loads of the depths of staleness
LOADS, AGES, DENSITIES, DEPTHS = (30, 60), (15 * 60_000, 30 * 60_000), (0.15, 0.30), (85, 110)
# fixed values: calls looked back on, load of a change of module and how long it is damped, load of a dense and of a
# bursting session and how long these are held off, density and weight of a burst
WINDOW, SWITCH, DAMPED, DENSE, SPIKE, HELD, BURST, HEAVY = 15, 5, 5_000, 15, 20, 60_000, 0.60, 8
# fixed values: score that raises each level, and that lowers it; points of the signals, of recovery, and a minute's decay
UP, DOWN = {0: 30, 1: 50, 2: 70, 3: 90}, {1: 20, 2: 40, 3: 60, 4: 80}
TRAJECTORY, OSCILLATION, DEEP, RECOVERY, DECAY, MOST = 15, 10, 25, 3, 5, 100
# fixed values: a new start within RAPID of the last is rapid, the third of such is spam; points of either; how long the
# signals are held off after one that lowered the score; how long a session is kept without a call
RAPID, SPAM, NORMAL_START, RAPID_START, QUIET, EXPIRY = 120_000, 3, 40, 15, 45_000, 30 * 60_000
POINT = 60_000 // DECAY


def density(modules) -> float:
    """Changes of module over the window's size; calls without a module make none."""
    known = [m for m in modules if m is not None]
    return sum(a != b for a, b in zip(known, known[1:], strict=False)) / WINDOW


def oscillation(modules) -> float:
    """Of the changes of module, the share that return to the module before the last."""
    known = [m for m in modules if m is not None]
    turns = [m for i, m in enumerate(known) if i == 0 or m != known[i - 1]]
    back = sum(a == b for a, b in zip(turns, turns[2:], strict=False))
    return back / (len(turns) - 2) if len(turns) > 2 else 0.0


def next_level(level: int, score: float, depth: int) -> int:
    """One step of hysteresis: up or else down, the last level up only at depth 3; the depth sets a floor."""
    now = level
    if level < 4 and score >= UP[level] and (level < 3 or depth >= 3):
        now += 1
    elif level > 0 and score < DOWN[level]:
        now -= 1
    return max(now, min(2, max(0, depth - 1)))


def settled(level: int, score: float) -> int:
    """The level that decay leads to without a call; never a higher one."""
    while (now := next_level(level, score, 0)) < level:
        level = now
    return level


@dataclass
class Session:
    """Times are milliseconds."""

    since: int
    load: int = 0
    state: str = "fresh"
    depth: int = 0
    module: str | None = None
    switched: int = 0
    bonus: int = 0
    score: float = 0
    level: int = 0
    decayed: int = 0
    oriented: int | None = None
    orients: int = 0
    quiet: int = 0
    seen: int = 0
    window: deque = field(default_factory=lambda: deque(maxlen=WINDOW))

    def orient(self, at: int) -> None:
        """A new start: the load goes, and panic falls, the less the oftener it is asked for."""
        rapid = self.oriented is not None and at - self.oriented < RAPID
        self.orients, self.oriented, self.seen = self.orients * rapid + 1, at, at
        points = 0 if self.orients >= SPAM else RAPID_START if rapid else NORMAL_START
        self.score = max(0, self.score - points)
        self.level = next_level(self.level, self.score, 0)
        if points:
            self.quiet = at + QUIET
        self.since, self.load, self.state, self.depth, self.module, self.switched, self.bonus = at, 0, "fresh", 0, None, 0, 0
        self.window.clear()

    def call(self, at: int, weight: int, module: str | None, suppressed: bool = False) -> None:
        self.seen = at
        self.window.append(module)
        dense, swing = density(self.window), oscillation(self.window)
        if self.state == "stale":
            burst = weight >= HEAVY or dense >= BURST
            self.depth = 3 if burst else max(self.depth, self._depth())
        else:
            self._spend(at, weight, module, dense)
        self._panic(at, dense, swing, suppressed or self.quiet > at)

    def next_change(self) -> int:
        """When, if no call comes, the level falls by decay, or else the session ends."""
        end = self.seen + EXPIRY
        if not self.level or not self.decayed:
            return end
        points = math.floor(self.score - DOWN[self.level]) + 1  # until the score is below what holds the level
        return min(end, self.decayed + max(1, points) * POINT)

    def settle(self, at: int) -> bool:
        """What time alone does up to ``at``: whole points of decay, and the level that they lead to. Whether the session
        goes on."""
        if at >= self.seen + EXPIRY:
            return False
        points = max(0, at - self.decayed) // POINT if self.decayed else 0
        self.score, self.decayed = max(0, self.score - points), self.decayed + points * POINT
        self.level = settled(self.level, self.score)
        return True

    def _depth(self) -> int:
        return 1 + sum(self.load >= x for x in DEPTHS)

    def _spend(self, at: int, weight: int, module: str | None, dense: float) -> None:
        self.load += weight
        if module is not None:
            if self.module not in (None, module) and at - self.switched > DAMPED:
                self.load, self.switched = self.load + SWITCH, at
            self.module = module
        if dense >= DENSITIES[1] and at - self.bonus > HELD:
            self.load, self.bonus = self.load + (SPIKE if dense >= BURST else DENSE), at
        passed = [self.load >= a or at - self.since >= b or dense >= c for a, b, c in zip(LOADS, AGES, DENSITIES, strict=True)]
        if passed[1]:
            self.state, self.depth = "stale", self._depth()
        elif passed[0]:
            self.state = "degraded"

    def _panic(self, at: int, dense: float, swing: float, suppressed: bool) -> None:
        delta = 0
        if self.decayed:
            points = max(0, at - self.decayed) // POINT
            delta, self.decayed = -points, self.decayed + points * POINT  # what is left of a point counts later
        else:
            self.decayed = at
        focus = max(0.0, (1 - min(1, 2 * dense)) * (1 - min(1, swing)))
        if not suppressed:
            delta += TRAJECTORY * (dense >= BURST) + OSCILLATION * (swing >= 0.5) + DEEP * (self.depth >= 3 and focus < 0.5)
        if dense < 0.10 and swing < 0.10 and self.depth == 0:
            delta -= RECOVERY
        self.score = min(MOST, max(0, self.score + delta))
        self.level = next_level(self.level, self.score, self.depth)
