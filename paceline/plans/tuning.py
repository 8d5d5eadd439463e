"""Tuners and policies: plain rules on numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_size(overhead_ms: float, point_ms: float) -> int:
    return int(300 * math.sqrt(overhead_ms / point_ms))


def block_size_column(overhead_ms: Column, point_ms: Column) -> Column:
    return F.floor(300 * F.sqrt(overhead_ms / point_ms))


def block_count(points: int, tasks: int, size: int) -> int:
    return max(1, points // (tasks * max(1, size)))


@dataclass
class BlockTuner:
    """The block size from the averages of the first ``reports`` supersteps; then it stays."""

    reports: int = 3
    size: int | None = None
    seen: list = field(default_factory=list)

    def step(self, overhead_ms: float, point_ms: float) -> int | None:
        if self.size is None:
            self.seen.append((overhead_ms, point_ms))
            if len(self.seen) == self.reports:
                self.size = max(1, block_size(sum(s[0] for s in self.seen), sum(s[1] for s in self.seen)))
        return self.size


@dataclass
class IntervalTuner:
    """Halves the barrier interval while a superstep's progress per full interval stays above the target;
    when it does not, goes back half a step (1.5 times) and stays there. The first interval is half of
    the first superstep. Progress is the fall of the objective; ``rising`` objectives (a
    log-likelihood) have negative progress, and the comparison turns round."""

    rising: bool = False
    interval: float = 100.0
    target: float = 0.0
    frozen: bool = False
    syncs: list = field(default_factory=list)

    def step(self, superstep: int, elapsed_ms: float, progress: float, sync_ms: float = 0.0) -> float:
        if superstep == 1:
            self.interval, self.target = elapsed_ms / 2, 0.0
        elif not self.frozen:
            self.syncs.append(sync_ms)
            real = progress * (2 - sum(self.syncs) / len(self.syncs) / self.interval)
            if real >= self.target if self.rising else real <= self.target:
                self.interval, self.frozen = 1.5 * self.interval, True
            else:
                self.target, self.interval = progress, self.interval / 2
        return self.interval


@dataclass
class WindowedTuner:
    """The same decision once for each window of max(4, 2 + ``skip``) supersteps, on the summed progress of
    those after the first ``skip`` of the window. The next target goes on from the last two supersteps'
    progress: (last - (last but one - last)) * (1 + sync / interval)."""

    rising: bool = False
    skip: int = 2
    interval: float = 100.0
    target: float = 0.0
    frozen: bool = False
    progress: list = field(default_factory=list)
    before: float = 0.0
    syncs: list = field(default_factory=list)

    def step(self, superstep: int, elapsed_ms: float, progress: float, sync_ms: float = 0.0) -> float:
        if superstep == 1:
            self.interval, self.before = elapsed_ms / 2, progress
            return self.interval
        older, self.before = self.before, progress
        self.progress.append(progress)
        self.syncs.append(sync_ms)
        if self.frozen or len(self.progress) < max(4, 2 + self.skip):
            return self.interval
        real, self.progress = sum(self.progress[self.skip :]), []
        if real >= self.target if self.rising else real <= self.target:
            self.interval, self.frozen, self.target = 1.5 * self.interval, True, 0.0
        else:
            self.target = (progress - (older - progress)) * (1 + sum(self.syncs) / len(self.syncs) / self.interval)
            self.interval /= 2
        return self.interval


@dataclass
class Checkpoints:
    """fixed: every k supersteps. dynamic: at least k since the last one, and archiving costs no more than
    the recovery it saves."""

    every: int = 1 << 31
    policy: str = "fixed"
    last: int = 0

    def due(self, superstep: int, archive_s: float = 0.0, recovery_s: float = 0.0) -> bool:
        yes = superstep % self.every == 0 if self.policy == "fixed" else superstep - self.last >= self.every and archive_s <= recovery_s
        if yes:
            self.last = superstep
        return yes


def stops(superstep: int, most: int, objective: float, threshold: float, rising: bool) -> bool:
    return superstep >= most or (objective > threshold if rising else objective < threshold)


#: States of a fit, in order; the last three end it.
STATES = ("PREP", "LOAD", "RUNNING", "SAVE", "SUCCEEDED", "FAILED", "KILLED")
