"""The fit loop: one pass over the window's points per barrier, under a choice of barrier.

``points`` has id, x; block and flexible barriers also need task, pos (see prep.tasks_by_position). The
driver holds the totals, the parameters, and for each task the ranges of positions with the versions of
the parameters that they were last visited with. A barrier reads the points of its window only and adds
new less last contribution of each to the totals; a last contribution is computed again from those
versions. So no state of points is ever written, and a lost executor costs its own tasks only.

A checkpoint is the driver's state, a few numbers for each task and centre; a fit goes on from it.
"""

from __future__ import annotations

import copy
import math
import pickle
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paceline.functions import vectors as V
from paceline.operators import partitioning
from paceline.operators.models import Model, Params
from paceline.plans.lineage import checkpoint_dir, load_version, save_version
from paceline.plans.tuning import BlockTuner, Checkpoints, IntervalTuner, WindowedTuner, stops

#: Points that a model gets at once.
CHUNK = 8192


@dataclass
class Concurrent:
    """Every superstep takes every point."""


@dataclass
class Block:
    """From superstep 2 on a barrier after each block of every task: ``blocks`` of them, even to one point. With
    ``remainder`` blocks of n // blocks points and one for the rest; with ``size`` blocks of so many points
    (with one task: mini-batches). A ``tuner`` sets the size from measured times."""

    blocks: int = 4
    remainder: bool = False
    size: int | None = None
    tuner: BlockTuner | None = None

    def lengths(self, sizes: list[int]) -> list[int] | None:
        """The block length of each task; None for even blocks."""
        if self.size:
            return [self.size] * len(sizes)
        return [max(1, n // self.blocks) for n in sizes] if self.remainder else None

    def barriers(self, sizes: list[int]) -> int:
        each = self.lengths(sizes)
        return max((-(-n // b) for n, b in zip(sizes, each)), default=0) if each else self.blocks

    def ranges(self, sizes: list[int], block: int) -> list[list[tuple[int, int, int]]]:
        """For each task the (from, to, visits) of a block."""
        each = self.lengths(sizes)
        at = (lambda t, n, b: min(n, each[t] * b)) if each else (lambda t, n, b: -(-n * b // self.blocks))
        return [[(at(t, n, block), at(t, n, block + 1), 1)] for t, n in enumerate(sizes)]


@dataclass
class Flexible:
    """A time-based barrier on a virtual clock: in each interval a task gets through as many points as its
    speed (points a millisecond) allows, at least one; the cursor goes on from there, round and round.
    The first ``idle_tasks`` tasks lose ``idle_ms`` at every 1000 points. ``interval`` None: the time of
    the first superstep. ``ratio`` scales it. The clock is armed from superstep 2 on; a ``tuner`` sets the
    next interval after each superstep, with ``sync_ms`` as the cost of a barrier."""

    interval: float | None
    speeds: list[float]
    idle_ms: float = 0.0
    idle_tasks: int = 0
    ratio: float = 1.0
    tuner: IntervalTuner | WindowedTuner | None = None
    sync_ms: float = 0.0

    def pace(self) -> list[float]:
        return [1000 / (1000 / v + self.idle_ms) if t < self.idle_tasks and self.idle_ms > 0 else v for t, v in enumerate(self.speeds)]

    def quotas(self) -> list[int]:
        return [max(1, math.floor(v * self.interval * self.ratio + 1e-9)) for v in self.pace()]

    def full_pass(self, sizes: list[int]) -> float:
        return max((n / v for n, v in zip(sizes, self.pace())), default=0.0)


def cyclic(sizes: list[int], cursors: list[int], quotas: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each task the (from, to, visits) that a quota passes from its cursor on."""
    out = []
    for n, c, q in zip(sizes, cursors, quotas):
        whole, rest = divmod(q, n) if n else (0, 0)
        end = c + rest
        cut = [(c, min(end, n), whole + 1), (0, max(0, end - n), whole + 1), (max(0, end - n), c, whole), (min(end, n), n, whole)]
        out.append([r for r in cut if r[0] < r[1] and r[2]])
    return out


@dataclass
class FitConfig:
    """``tasks``: at least so many, those without points are disabled. ``migrate``: superstep -> task whose tail moves to others before it. ``checkpoint_to``: folder of the
    fit's checkpoints (None: a new one in the checkpoint folder); with ``resume`` it goes on from the last
    one there. ``fail_at``: a superstep that is lost once (a test of recovery)."""

    max_supersteps: int = 1
    sync: Concurrent | Block | Flexible = field(default_factory=Concurrent)
    threshold: float | None = None
    checkpoint: Checkpoints = field(default_factory=Checkpoints)
    checkpoint_to: str | None = None
    resume: bool = False
    fail_at: int | None = None
    tasks: int = 0
    migrate: dict[int, int] = field(default_factory=dict)
    migrate_chunk: int = partitioning.CHUNK_POINTS
    on_state: Callable[[str], None] | None = None


@dataclass
class State:
    """Everything that goes on from superstep to superstep."""

    params: Params
    sync: Concurrent | Block | Flexible
    superstep: int = 0
    used: Params | None = None
    totals: dict | None = None
    versions: dict[int, Params] = field(default_factory=dict)
    ranges: list[list[tuple[int, int, tuple[int, ...]]]] = field(default_factory=list)  # of each task
    cursors: list[int] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    moves: list[tuple[int, list[int], int]] = field(default_factory=list)
    checkpoint: Checkpoints | None = None
    saved_to: str | None = None
    archives: list[float] = field(default_factory=list)
    recovery_s: float = 0.0

    @property
    def sizes(self) -> list[int]:
        return [r[-1][1] if r else 0 for r in self.ranges]

    def visit(self, windows: list[list[tuple[int, int, int]]], version: int, memory: int | None) -> None:
        for task, window in enumerate(windows):
            for lo, hi, visits in window:
                out = []
                for a, b, seen in self.ranges[task]:
                    for c, d in ((a, min(b, lo)), (max(a, lo), min(b, hi)), (max(a, hi), b)):
                        if c < d:
                            inside = lo <= c and d <= hi
                            now = seen + (version,) * (visits if memory is None else 1) if inside else seen
                            out.append((c, d, now if memory is None else now[-memory:]))
                joined = []
                for r in out:
                    if joined and joined[-1][2] == r[2] and joined[-1][1] == r[0]:
                        joined[-1] = (joined[-1][0], r[1], r[2])
                    else:
                        joined.append(r)
                self.ranges[task] = joined
        live = {v for r in self.ranges for _, _, seen in r for v in seen}
        self.versions = {v: p for v, p in self.versions.items() if v in live}


@dataclass
class FitResult:
    params: Params
    used: Params  # of the last superstep's projection
    history: list[dict]
    totals: dict
    states: list[str]
    state: State
    model: Model

    def metrics(self, spark) -> DataFrame:
        names = ["superstep", "objective", "seconds", "points", "interval_ms", "sync_s", "busiest_s", "idlest_s", "checkpoint_s"]
        rows = [(h["superstep"], float(h["objective"]), float(h["seconds"]), int(h["points"]), *(None if h[c] is None else float(h[c]) for c in names[4:])) for h in self.history]
        return spark.createDataFrame(rows, "superstep int, objective double, seconds double, points long, " + ", ".join(f"{c} double" for c in names[4:]))

    def contributions(self, points: DataFrame) -> DataFrame:
        """(id, w, obj): the last contribution of every point of a clustering fit."""
        shared = points.sparkSession.sparkContext.broadcast(cloudpickle.dumps((self.model, self.state.versions, self.state.ranges)))
        tasked = bool(self.state.ranges)
        rows = relabelled(points, self.state.moves) if tasked else points

        def part(batches):
            import pyarrow as pa

            model, versions, ranges = pickle.loads(shared.value)
            for b in batches:
                for rows, hist, _ in grouped(b, ranges if tasked else None, versions):
                    for lo in range(0, len(rows), CHUNK):
                        at = rows[lo : lo + CHUNK]
                        some = b.take(pa.array(at))
                        x = vectors_of(some)
                        w, o = model.weights(x, hist[-1])
                        for p in reversed(hist[:-1]):  # the visits before, where the last had no density
                            none = np.exp(o) == 0 if model.memory is None else np.zeros(len(o), bool)
                            if not none.any():
                                break
                            w[none], o[none] = (a[none] for a in model.weights(x, p))
                        yield pa.RecordBatch.from_pydict({"id": some.column("id"), "w": list(w), "obj": o})

        return rows.where("x is not null").select(*(["task", "pos"] if tasked else []), "id", "x").mapInArrow(part, "id long, w array<double>, obj double")


def vectors_of(batch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float, copy=False)


def grouped(batch, ranges, versions) -> Iterator[tuple[np.ndarray, list[Params], int]]:
    """(rows, the parameters that they were visited with, visits now) of a batch."""
    n = batch.num_rows
    visits = batch.column("visits").to_numpy(zero_copy_only=False).astype(np.int64) if "visits" in batch.schema.names else np.ones(n, np.int64)
    if ranges is None:
        yield np.arange(n), list(versions.values()), 1
        return
    task, pos = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("task", "pos"))
    key = np.zeros((n, 3), np.int64)
    key[:, 0], key[:, 2] = task, visits
    for t in np.unique(task):
        mine = task == t
        key[mine, 1] = np.searchsorted([r[0] for r in ranges[t]], pos[mine], side="right") - 1
    kinds, of = np.unique(key, axis=0, return_inverse=True)
    for i, (t, r, v) in enumerate(kinds):
        yield np.flatnonzero(of.ravel() == i), [versions[s] for s in ranges[t][r][2]], int(v)


def relabelled(points: DataFrame, moves: list[tuple[int, list[int], int]]) -> DataFrame:
    """``points`` with task and pos after the migrations: plain columns, nothing is shuffled."""
    for sender, sizes, chunk in moves:
        points = partitioning.moved(points, sender, sizes, chunk)
    return points


def barrier_sums(rows: DataFrame, model: Model, p: Params, state: State, tasked: bool) -> dict[str, np.ndarray]:
    """The window's additions to the totals, by one pass; ``busy`` are the seconds of the slowest and fastest task.
    ``rows`` has task, pos, visits where there are windows."""
    import pyarrow as pa

    shapes = model.shapes(p)
    if getattr(model, "columns", None) and (cols := model.columns(p)):
        r = (rows if tasked else rows.withColumn("visits", F.lit(1))).withColumnRenamed("visits", "n").where("x is not null").agg(*[c.alias(name) for name, c in cols.items()]).first()
        flat = {c: r[c] or 0.0 for c in ("n", "o")}
        return flat | {"R": np.array([r[f"R{i}"] or 0.0 for i in range(shapes["R"][0])]), "busy": None}
    # a few numbers for each centre, live version and task; by value, so that a model may be defined anywhere
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps((model, p, state.versions, state.ranges if tasked else None)))

    def part(batches):
        model, p, versions, ranges = pickle.loads(shared.value)
        began, total = time.monotonic(), np.zeros(sum(int(np.prod(s)) for s in shapes.values()))
        for b in batches:
            for at, hist, visits in grouped(b, ranges, versions):
                if ranges is None:
                    hist = hist if model.memory is None else []  # whole passes replace the totals
                for lo in range(0, len(at), CHUNK):
                    some = b.take(pa.array(at[lo : lo + CHUNK])) if len(at) < b.num_rows or len(at) > CHUNK else b
                    x, ids = vectors_of(some), some.column("id").to_numpy(zero_copy_only=False)
                    if ranges is None and model.cumulative:
                        one = model.sums(x, ids, [*hist, p])
                    else:
                        one = model.window(x, ids, hist, p, visits)
                    total += np.concatenate([np.ravel(one[c]) for c in shapes])
        busy = time.monotonic() - began
        yield pa.RecordBatch.from_pydict({"i": np.arange(-1, len(total), dtype=np.int32), "v": np.concatenate([[busy], total])})

    sent = rows.where("x is not null").select(*(["task", "pos", "visits"] if tasked else []), "id", "x").mapInArrow(part, "i int, v double")
    got = sent.groupBy("i").agg(F.sum("v").alias("v"), F.max("v").alias("most"), F.min("v").alias("least")).orderBy("i").toArrow()
    shared.unpersist()
    if not got.num_rows:
        return {c: np.zeros(s) for c, s in shapes.items()} | {"busy": (0.0, 0.0)}
    v, at, out = got.column("v").to_numpy()[1:], 0, {}
    for c, s in shapes.items():
        out[c], at = v[at : at + int(np.prod(s))].reshape(s), at + int(np.prod(s))
    return out | {"busy": (got.column("most")[0].as_py(), got.column("least")[0].as_py())}


def window_column(windows: list[list[tuple[int, int, int]]]) -> Column:
    """How often the windows pass a point: from the few ranges of each task, as literals."""
    most = max((len(w) for w in windows), default=0)
    at = lambda i, c: F.get(V.whole_numbers(w[i][c] if i < len(w) else 0 for w in windows), F.col("task"))
    out = F.lit(0)
    for i in range(most):
        out = out + F.when((F.col("pos") >= at(i, 0)) & (F.col("pos") < at(i, 1)), at(i, 2)).otherwise(0)
    return out


def fit(points: DataFrame, model: Model, config: FitConfig) -> FitResult:
    spark, states = points.sparkSession, []

    def enter(name: str) -> None:
        states.append(name)
        if config.on_state:
            config.on_state(name)

    enter("PREP")
    try:
        enter("LOAD")
        saved = load_version(spark, config.checkpoint_to) if config.resume and config.checkpoint_to else None
        s = saved or State(model.init(points), copy.deepcopy(config.sync), checkpoint=copy.deepcopy(config.checkpoint))
        tasked = not isinstance(s.sync, Concurrent)
        if tasked and not s.ranges:
            counts = {r.task: r.n for r in points.groupBy("task").agg(F.count("*").alias("n")).collect()}  # one row for each task
            s.ranges = [[(0, counts[t], ())] if counts.get(t) else [] for t in range(max(config.tasks, max(counts, default=-1) + 1))]
            s.cursors = [0] * len(s.ranges)
        start, lost = copy.deepcopy(s), config.fail_at
        model.task_setup(points)
        enter("RUNNING")
        while s.superstep < config.max_supersteps:
            if config.threshold is not None and s.history and stops(s.superstep, config.max_supersteps, s.history[-1]["objective"], config.threshold, model.mean_objective):
                break
            if lost is not None and s.superstep + 1 == lost:
                lost, s = None, (load_version(spark, s.saved_to) if s.saved_to else None) or copy.deepcopy(start)
                continue
            superstep(points, model, config, s, tasked)
        enter("SAVE")
        model.task_cleanup(s.params)
        enter("SUCCEEDED")
    except BaseException as e:
        enter("KILLED" if isinstance(e, KeyboardInterrupt) else "FAILED")
        raise
    return FitResult(s.params, s.used or s.params, s.history, s.totals or {}, states, s, model)


def superstep(points: DataFrame, model: Model, config: FitConfig, s: State, tasked: bool) -> None:
    n, spark = s.superstep + 1, points.sparkSession
    began, objective, seen, busy, wall = time.monotonic(), 0.0, 0, [], 0.0
    model.superstep_setup(n, s.params)
    if n in config.migrate and tasked:
        s.moves.append((config.migrate[n], s.sizes, config.migrate_chunk))
        s.ranges = partitioning.moved_ranges(s.ranges, config.migrate[n], config.migrate_chunk)
        s.cursors = [c % size if size else 0 for c, size in zip(s.cursors, s.sizes)]
    rows, sizes, flexible = relabelled(points, s.moves), s.sizes, isinstance(s.sync, Flexible)
    if not tasked:
        windows = [None]
    elif n == 1:
        windows = [[[(0, size, 1)] if size else [] for size in sizes]]
    elif flexible:
        windows = [cyclic(sizes, s.cursors, s.sync.quotas())]
        s.cursors = [(c + q) % size if size else 0 for c, q, size in zip(s.cursors, s.sync.quotas(), sizes)]
    else:
        blocks = [s.sync.ranges(sizes, b) for b in range(s.sync.barriers(sizes))]
        windows = [w for w in blocks if any(lo < hi for r in w for lo, hi, _ in r)]
    for w in windows:
        at, counted = time.perf_counter(), Observation()
        part = rows if w is None else rows.withColumn("visits", window_column(w)).where("visits > 0")
        if w is not None:  # bounds that reach the scan
            part = part.where(F.col("pos").between(min((lo for r in w for lo, hi, _ in r if lo < hi), default=0), max((hi for r in w for lo, hi, _ in r if lo < hi), default=0) - 1))
        sums = barrier_sums(part.observe(counted, F.sum("visits" if w is not None else F.lit(1)).alias("read")), model, s.params, s, tasked)
        wall += time.perf_counter() - at
        if sums["busy"]:
            busy.append(sums["busy"])
        seen += counted.get["read"] or 0
        sums = {c: v for c, v in sums.items() if c != "busy"}
        if not model.cumulative or not tasked or s.totals is None:
            s.totals = sums
        else:
            s.totals = {c: s.totals[c] + v for c, v in sums.items()}
        version = max(s.versions, default=0) + 1
        s.versions[version] = s.params
        if tasked:
            s.visit(w, version, model.memory)
        elif model.memory is not None:
            s.versions = {version: s.params}
        s.used, s.params = s.params, model.finalise(s.totals, s.params)
        objective = model.objective(s.totals, s.params) + (0.0 if model.cumulative else objective)
    s.superstep = n
    before = s.history[-1]["objective"] if s.history else objective
    busiest, idlest = (sum(b[i] for b in busy) if busy else None for i in (0, 1))
    sync_s = max(0.0, wall - busiest) if busy else None
    s.history.append({
        "superstep": n, "objective": objective, "seconds": time.monotonic() - began, "points": seen, "interval_ms": s.sync.interval if flexible and n > 1 else None,
        "sync_s": sync_s, "busiest_s": busiest, "idlest_s": idlest, "checkpoint_s": None,
    })
    if flexible:
        full = s.sync.full_pass(sizes)
        if s.sync.tuner:
            s.sync.interval = s.sync.tuner.step(n, full if n == 1 else s.sync.interval, before - objective, s.sync.sync_ms)
        elif n == 1 and s.sync.interval is None:
            s.sync.interval = full
    elif isinstance(s.sync, Block) and s.sync.tuner and busy:
        size = s.sync.tuner.step(1000 * sync_s / len(windows), 1000 * busiest / max(1, seen / max(1, len(sizes))))
        s.sync.size = size or s.sync.size
    model.superstep_cleanup(n, s.params, objective)
    # what a failure would cost now: the supersteps since the last checkpoint, less the time of writing it
    s.recovery_s += s.history[-1]["seconds"]
    if s.checkpoint.due(n, sum(s.archives) / max(1, len(s.archives)), s.recovery_s):
        at = time.monotonic()
        s.saved_to = s.saved_to or config.checkpoint_to or f"{checkpoint_dir(spark)}/fit-{uuid.uuid4().hex}"
        save_version(spark, s.saved_to, n, s)
        s.archives.append(time.monotonic() - at)
        s.recovery_s = -s.archives[-1]
        s.history[-1]["checkpoint_s"] = s.archives[-1]
