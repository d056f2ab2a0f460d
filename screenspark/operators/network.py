"""A weighted two-layer perceptron, trained by gradients that Spark sums up.

Each step is one pass: tasks add up the weighted loss and gradient of their own rows,
and their sums are added place by place, so no row is repeated or moved and only the
parameters come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from screenspark.plans.staging import discard, stage


@dataclass
class Network:
    """Layers of weights (inputs x outputs) and biases; all but the last are rectified, the last is a logit."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def drawn(cls, sizes: list[int], seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        return cls([(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for layer in self.layers for p in layer])

    def filled(self, values: np.ndarray) -> "Network":
        out, at = [], 0
        for layer in self.layers:
            parts = []
            for p in layer:
                parts.append(values[at : at + p.size].reshape(p.shape))
                at += p.size
            out.append(tuple(parts))
        return Network(out)

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        states = [x]
        for w, b in self.layers[:-1]:
            states.append(np.maximum(states[-1] @ w + b, 0))
        w, b = self.layers[-1]
        return (states[-1] @ w + b)[:, 0], states

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x)[0], -500, 500)))

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weighted logistic loss, sum of weights and gradient of the loss, as one flat array."""
        z, states = self.logits(x)
        loss = (w * (np.logaddexp(0, z) - y * z)).sum()
        back, parts = (w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))[:, None], []
        for (weights, _), state in zip(reversed(self.layers), reversed(states)):
            parts = [(state.T @ back).ravel(), back.sum(axis=0), *parts]
            back = (back @ weights.T) * (state > 0)
        return np.concatenate([[loss, w.sum()], *parts])


def weighted_sums(rows: DataFrame, net: Network) -> np.ndarray:
    """Loss, weights and gradient of ``net`` over rows (x, y, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                part = net.loss_and_gradient(x, b.column("y").to_numpy(), b.column("w").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(2 + net.flat().size)
    for i, v in sums.collect():
        out[i] = v
    return out


def train_network(rows: DataFrame, inputs: int, hidden: tuple[int, ...] = (32, 16), steps: int = 60, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Network:
    """A network for rows (x array, y 0 or 1, w weight): full-batch steps with momentum and scaled rates.

    Rows of weight 0 change nothing; without rows the network is that of the seed.
    """
    rows = stage(rows.select("x", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")), "network-rows")
    net = Network.drawn([inputs, *hidden, 1], seed)
    values = net.flat()
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for t in range(1, steps + 1):
        sums = weighted_sums(rows, net)
        if not sums[1]:
            break
        g = sums[2:] / sums[1] + decay * values
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        values = values - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        net = net.filled(values)
    discard(rows)
    return net


def apply_network(net: Network, df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """``df`` with the probability of class 1 from its columns."""
    schema = StructType([*df.schema, StructField(out, DoubleType())])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.probabilities(x))], names=[*names, out])

    return df.mapInArrow(run, schema)
