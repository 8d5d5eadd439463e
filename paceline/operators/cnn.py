"""A small convolutional network: 28x28 -> 6 maps (5x5) -> pool 2 -> 12 maps (5x5) -> pool 2 -> 10.

A model of the fit loop: every partition runs forward and backward over its records in Arrow batches and
sends the sums of the weight changes (a few thousand numbers); the driver adds them. Sigmoid units, squared error; starting kernels are 0.05, biases 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.grids import correlate_maps, kronecker, mean_pool, rot180, sigmoid, softmax_loss
from paceline.operators.models import Model, Params

SIDE, OUT = 28, 10


@dataclass
class Network:
    k1: np.ndarray  # (6, 5, 5)
    b1: np.ndarray
    k2: np.ndarray  # (6, 12, 5, 5)
    b2: np.ndarray
    k3: np.ndarray  # (12, 10, 4, 4)
    b3: np.ndarray

    @staticmethod
    def start(kernel: float = 0.05) -> "Network":
        f = lambda *s: np.full(s, kernel)
        return Network(f(6, 5, 5), np.zeros(6), f(6, 12, 5, 5), np.zeros(12), f(12, OUT, 4, 4), np.zeros(OUT))

    def arrays(self) -> list[np.ndarray]:
        return [self.k1, self.b1, self.k2, self.b2, self.k3, self.b3]


def forward(net: Network, x: np.ndarray) -> list[np.ndarray]:
    """Maps of all layers for images (n, 28, 28)."""
    c1 = sigmoid(correlate_maps("nij,akl->naij", x, net.k1) + net.b1[:, None, None])
    s1 = mean_pool(c1, 2, 2)
    c2 = sigmoid(correlate_maps("naij,abkl->nbij", s1, net.k2) + net.b2[:, None, None])
    s2 = mean_pool(c2, 2, 2)
    out = sigmoid(np.einsum("naij,abij->nb", s2, net.k3, optimize=True) + net.b3)
    return [c1, s1, c2, s2, out]


def changes(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float, int]:
    """(sums over the records of kernel and bias changes, squared error, correct ones)."""
    c1, s1, c2, s2, out = forward(net, x)
    want = np.eye(OUT)[label]
    e3 = out * (1 - out) * (want - out)
    es2 = np.einsum("nb,abij->naij", e3, net.k3)
    e2 = c2 * (1 - c2) * kronecker(es2, 2, 2)
    es1 = correlate_maps("nbij,abkl->naij", e2, rot180(net.k2), full=True)
    e1 = c1 * (1 - c1) * kronecker(es1, 2, 2)
    g = [
        correlate_maps("nij,nakl->aij", x, e1), e1.sum((0, 2, 3)),
        correlate_maps("naij,nbkl->abij", s1, e2), e2.sum((0, 2, 3)),
        np.einsum("naij,nb->abij", s2, e3), e3.sum(0),
    ]
    return g, float(0.5 * ((want - out) ** 2).sum()), int((out.argmax(1) == label).sum())


@dataclass
class CNN(Model):
    """The network as a model of the fit loop. Points: x is the 784 values and the label last. Updates once for each
    barrier with the mean change; biases are divided by the records or, with ``bias_norm='maps'``, by
    the number of maps of their layer. Points with another label or length are left out."""

    net: Network | None = None
    rate: float = 0.85
    decay: float = 0.0
    bias_norm: str = "records"
    cumulative = False

    def init(self, points):
        net = self.net or Network.start()
        return Params(theta=np.concatenate([a.ravel() for a in net.arrays()]), rate=self.rate)

    def network(self, p: Params) -> Network:
        at, out = 0, []
        for a in (self.net or Network.start()).arrays():
            out.append(p.theta[at : at + a.size].reshape(a.shape))
            at += a.size
        return Network(*out)

    def shapes(self, p):
        return {"n": (), "o": (), "right": (), "g": p.theta.shape}

    def window(self, x, ids, history, p, visits):
        net, total, loss, right, n = self.network(p), np.zeros(len(p.theta)), 0.0, 0, 0
        x = x[(x[:, -1] >= 0) & (x[:, -1] < OUT)] if x.shape[1] == SIDE * SIDE + 1 else x[:0]
        for lo in range(0, len(x), 64):
            some = x[lo : lo + 64]
            g, e, c = changes(net, some[:, :-1].reshape(-1, SIDE, SIDE), some[:, -1].astype(int))
            total += np.concatenate([a.ravel() for a in g])
            loss, right, n = loss + e, right + c, n + len(some)
        return {"n": float(visits * n), "o": visits * loss, "right": float(visits * right), "g": visits * total}

    def finalise(self, sums, p):
        step, n = p.step + 1, sums["n"]
        if not n:
            return replace(p, step=step)
        at, new = 0, []
        for i, a in enumerate(self.network(p).arrays()):
            g = sums["g"][at : at + a.size].reshape(a.shape)
            at += a.size
            new.append((a * (1 - self.decay * p.rate * (i % 2 == 0)) + p.rate * g / (len(a) if i % 2 and self.bias_norm == "maps" else n)).ravel())
        rate = 0.001 + 0.9 * p.rate if step % 10 == 1 and sums["right"] / n > 0.96 else p.rate
        return replace(p, theta=np.concatenate(new), rate=rate, step=step)


def labelled_images(records: DataFrame) -> DataFrame:
    """``records`` (x of 784 values, label) as points of the loop, the label last; rows with a null label or another
    length are left out."""
    rows = records.where((F.size("x") == SIDE * SIDE) & F.col("label").between(0, OUT - 1))
    more = [c for c in ("task", "pos") if c in records.columns]
    key = F.col("id") if "id" in records.columns else F.lit(0).cast("long").alias("id")
    return rows.select(*more, key, F.concat("x", F.array(F.col("label").cast("double"))).alias("x"))


def train(records: DataFrame, barriers: int, net: Network | None = None, rate: float = 0.85, decay: float = 0.0, bias_norm: str = "records", sync=None) -> tuple[Network, list[dict]]:
    """``records``: x (784 values), label (and id, task, pos for other barriers than the concurrent one)."""
    from paceline.plans import loop

    class Traced(CNN):
        def finalise(self, sums, p):
            seen.append((sums["right"], sums["n"], p.rate))
            return super().finalise(sums, p)

    seen, model = [], Traced(net, rate, decay, bias_norm)
    r = loop.fit(labelled_images(records), model, loop.FitConfig(barriers, sync or loop.Concurrent()))
    last = len(seen) // max(1, len(r.history))
    history = [{"superstep": h["superstep"], "loss": h["objective"], "accuracy": seen[last * (i + 1) - 1][0] / max(1.0, seen[last * (i + 1) - 1][1]), "records": int(h["points"]), "rate": seen[last * (i + 1) - 1][2]} for i, h in enumerate(r.history)]
    return model.network(r.params), [h for h in history if h["records"]]


def outputs(records: DataFrame, net: Network) -> DataFrame:
    """(id, label, predicted, loss, softmax_loss) of each record: what the trained network gives."""
    shared = records.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def part(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIDE * SIDE + 1).astype(float)
            out = np.concatenate([forward(shared.value, x[lo : lo + 64, :-1].reshape(-1, SIDE, SIDE))[-1] for lo in range(0, len(x), 64)]) if len(x) else np.zeros((0, OUT))
            y = x[:, -1].astype(int)
            soft = np.array([softmax_loss(o, label) for o, label in zip(out, y)], float)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "label": y.astype(np.int32), "predicted": out.argmax(1).astype(np.int32), "loss": 0.5 * np.square(np.eye(OUT)[y] - out).sum(1), "softmax_loss": soft})

    return labelled_images(records).mapInArrow(part, "id long, label int, predicted int, loss double, softmax_loss double")


def write_network(spark, net: Network, path: str) -> None:
    """The weights as rows (layer, i, value); an existing output is replaced."""
    rows = [(name, i, float(v)) for name, a in zip(("k1", "b1", "k2", "b2", "k3", "b3"), net.arrays()) for i, v in enumerate(a.ravel())]
    spark.createDataFrame(rows, "layer string, i int, value double").write.mode("overwrite").parquet(path)


def read_network(spark, path: str) -> Network:
    got = {r.layer: r.v for r in spark.read.parquet(path).groupBy("layer").agg(F.expr("transform(array_sort(collect_list(struct(i, value))), s -> s.value)").alias("v")).collect()}
    start = Network.start()
    return Network(*(np.array(got[name]).reshape(a.shape) for name, a in zip(("k1", "b1", "k2", "b2", "k3", "b3"), start.arrays())))
