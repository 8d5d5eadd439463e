"""Wall-clock flexible barrier: any model of the loop in one barrier stage.

Each task holds one partition. In a superstep it works on blocks of points until the interval is over,
exchanges the additions to the totals with all others at the barrier, and goes on from its cursor with
the new parameters, which every task finalises alike. Results depend on speed, so only bounds and
convergence can be checked. Needs as many slots as tasks; a lost task restarts the whole stage.
"""

from __future__ import annotations

import base64
import pickle
import time

import numpy as np
from pyspark.sql import DataFrame

from paceline.operators.models import KMeans, Model, Params


def fit_by_clock(points: DataFrame, model: Model, supersteps: int, interval_s: float, tasks: int, block: int = 256, start: Params | None = None) -> DataFrame:
    """(task, superstep, points, objective): the points each task got through. The first superstep is full."""
    first = start if start is not None else model.init(points)

    def run(batches):
        import pyarrow as pa
        from pyspark import BarrierTaskContext

        from paceline.plans.loop import vectors_of

        ctx, got = BarrierTaskContext.get(), [b for b in batches if b.num_rows]
        x = np.concatenate([vectors_of(b) for b in got]) if got else np.zeros((0, 0))
        ids = np.concatenate([b.column("id").to_numpy() for b in got]) if got else np.zeros(0, np.int64)
        p, n, cursor, totals, seen = first, len(x), 0, None, np.zeros((len(x), 0), np.int64)
        versions: list[Params] = []
        for s in range(1, supersteps + 1):
            end, done, parts = time.monotonic() + interval_s, 0, []
            versions.append(p)
            now = np.full(n, -1, np.int64)
            while n and ((s == 1 and done < n) or (s > 1 and time.monotonic() < end) or not done):
                at = (cursor + np.arange(min(block, n, n - done if s == 1 else n))) % n
                # points of the block with the same visits before it
                kinds, of = np.unique(np.concatenate([seen[at], now[at, None]], 1), axis=0, return_inverse=True)
                for i, kind in enumerate(kinds):
                    mine, hist = at[of.ravel() == i], [versions[v] for v in kind if v >= 0]
                    parts.append(model.window(x[mine], ids[mine], hist if model.memory is None else hist[-1:], p, 1))
                now[at] = s - 1
                done, cursor = done + len(at), (cursor + len(at)) % n
            seen = np.concatenate([seen, now[:, None]], 1) if model.memory is None else np.where(now >= 0, now, seen[:, 0] if seen.shape[1] else -1)[:, None]
            mine = {c: sum(q[c] for q in parts) for c in parts[0]} if parts else None
            sent = [pickle.loads(base64.b64decode(m)) for m in ctx.allGather(base64.b64encode(pickle.dumps(mine)).decode())]
            sent = [m for m in sent if m]
            new = {c: sum(m[c] for m in sent) for c in sent[0]} if sent else {}
            totals = new if totals is None or not model.cumulative else {c: totals[c] + v for c, v in new.items()}
            if totals:
                p = model.finalise(totals, p)
            objective = model.objective(totals, p) if totals else 0.0
            yield pa.RecordBatch.from_pydict({"task": pa.array([ctx.partitionId()], pa.int32()), "superstep": pa.array([s], pa.int32()), "points": [done], "objective": [float(objective)]})

    rows = points.where("x is not null").select("id", "x").repartition(tasks)
    return rows.mapInArrow(run, "task int, superstep int, points long, objective double", barrier=True)


def kmeans_by_clock(points: DataFrame, centres: np.ndarray, supersteps: int, interval_s: float, tasks: int, block: int = 256) -> DataFrame:
    return fit_by_clock(points, KMeans(len(centres), centres), supersteps, interval_s, tasks, block)
