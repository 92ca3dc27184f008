"""A regression network trained by mini-batches over Spark.

Rows are stored once as blocks of numbers, and dealt to mini-batches by a hash of their key and the epoch.
For one mini-batch a few blocks at a time give one gradient, a task adds its gradients up, and what leaves the task has the
size of the network whatever the rows. The driver holds the weights and takes Adam's step; the weights
travel to the tasks with the next job. Dropout masks and weights at the start come from the seed, so a
run can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.operators.scale import StandardScale
from assayloom.session import constant_table, stored
from assayloom.settings import LEARNING_RATE, MAX_EPOCHS, PATIENCE, RANDOM_SEED


@dataclass(frozen=True)
class NetworkSettings:
    """``step_size`` and ``step_factor``: the rate is multiplied by the factor every so many epochs."""

    hidden: tuple[int, ...] = (256, 256)
    rate: float = LEARNING_RATE
    epochs: int = MAX_EPOCHS
    batches: int = 8
    patience: int = PATIENCE
    dropout: float = 0.1
    decay: float = 1e-5
    step_size: int = 30
    step_factor: float = 0.5
    seed: int = RANDOM_SEED


@dataclass(frozen=True)
class Network:
    """Layers of weights with a ramp between them; the last gives one number."""

    sizes: tuple[int, ...]

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return list(zip(self.sizes, self.sizes[1:]))

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([
            np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in self.shapes])

    def layers(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, weights: np.ndarray, x: np.ndarray, dropout: float = 0.0, rng=None) -> list[np.ndarray]:
        """The input and the output of every layer; dropped units are 0, kept ones grow in turn."""
        values, layers = [x], self.layers(weights)
        for k, (w, b) in enumerate(layers):
            x = x @ w + b
            if k < len(layers) - 1:
                x = np.maximum(x, 0)
                if dropout:
                    x = x * (rng.random(x.shape) >= dropout) / (1 - dropout)
            values.append(x)
        return values

    def gradient(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray, dropout: float = 0.0, rng=None):
        """Sum of squared errors over the rows, and half its gradient."""
        values, layers = self.forward(weights, x, dropout, rng), self.layers(weights)
        error = values[-1] - y[:, None]
        parts, back = [], error
        for k in range(len(layers) - 1, -1, -1):
            parts.append(np.concatenate([(values[k].T @ back).ravel(), back.sum(0)]))
            if k:
                # Dropped units and those below the ramp are 0 and pass nothing back.
                back = (back @ layers[k][0].T) * (values[k] > 0) / (1 - dropout)
        return float((error ** 2).sum()), np.concatenate(parts[::-1])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Rows of binary ``v`` added up: in every task, in a few tasks, then on the driver. Each partial sum
    has ``size`` numbers, and as many reach the driver as there are tasks in the middle."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column("v"):
                total += np.frombuffer(v.as_buffer(), float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    middle = rows.repartition(4).mapInArrow(add, "v binary")
    return np.sum([np.frombuffer(r["v"], float) for r in middle.collect()], axis=0)


#: Bytes of a block, and blocks that give one gradient.
BLOCK_BYTES, BLOCKS = 1 << 13, 32
_BLOCK = "val boolean, width int, h binary, x binary, y binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (val, h, x, y) as blocks: the numbers of several rows in one, train and val rows apart."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
        h, val = batch.column("h").to_numpy(), batch.column("val").to_numpy(zero_copy_only=False)
        made, rows = [], max(1, BLOCK_BYTES // (8 * (x.shape[1] + 2)))
        for flag in (False, True):
            own = np.flatnonzero(val == flag)
            made += [(flag, x.shape[1], *(v[own[at:at + rows]].tobytes() for v in (h, x, y)))
                     for at in range(0, len(own), rows)]
        types = (pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*made), types)], ["val", "width", "h", "x", "y"])


def dealt(h: np.ndarray, epoch: int, batches: int) -> np.ndarray:
    """Mini-batch of each row in an epoch, by a hash of its 64-bit hash."""
    mixed = h.view(np.uint64) + np.uint64((epoch + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))) % np.uint64(batches)


def _pass(blocks: DataFrame, network: Network, weights: np.ndarray, settings: NetworkSettings,
          draw: int | None = None) -> tuple[float, float, np.ndarray]:
    """(rows, sum of squared errors, half its gradient) over mini-batch ``draw``, counted through the epochs; over
    all rows and without the gradient if it is None. A few blocks at a time add to the task's sums."""
    size = 2 + (len(weights) if draw is not None else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in (b.slice(at, BLOCKS) for b in batches for at in range(0, b.num_rows, BLOCKS)):
            h, x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), t)
                       for c, t in (("h", np.int64), ("x", float), ("y", float)))
            x = x.reshape(len(y), -1)
            if draw is not None:
                epoch, batch = divmod(draw, settings.batches)
                own = dealt(h, epoch, settings.batches) == batch
                x, y = x[own], y[own]
            if not len(y):
                continue
            total[0] += len(y)
            if draw is not None:
                # The same rows draw the same mask on a retry.
                rng = np.random.default_rng([settings.seed, draw, int(abs(x[0]).sum() * 1e6) % (1 << 31)])
                loss, gradient = network.gradient(weights, x, y, settings.dropout, rng)
                total[2:] += gradient
            else:
                loss = float(((network.forward(weights, x)[-1][:, 0] - y) ** 2).sum())
            total[1] += loss
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    total = _summed(blocks.select("h", "x", "y").mapInArrow(run, "v binary"), size)
    return total[0], total[1], total[2:]


class Adam:
    """Adam with decoupled weight decay."""

    def __init__(self, size: int):
        self._mean, self._square, self._step = np.zeros(size), np.zeros(size), 0

    def move(self, weights: np.ndarray, gradient: np.ndarray, rate: float, decay: float) -> np.ndarray:
        self._step += 1
        self._mean = 0.9 * self._mean + 0.1 * gradient
        self._square = 0.999 * self._square + 0.001 * gradient ** 2
        mean = self._mean / (1 - 0.9 ** self._step)
        square = self._square / (1 - 0.999 ** self._step)
        return weights * (1 - rate * decay) - rate * mean / (np.sqrt(square) + 1e-8)


@dataclass
class TrainedNetwork:
    """Weights of the best epoch. ``history``: (epoch, train loss, validation loss) in label variances."""

    network: Network
    weights: np.ndarray
    y_scale: StandardScale
    history: list[tuple[int, float, float]] = field(default_factory=list)
    stopped: str = "epochs"

    @property
    def best_epoch(self) -> int:
        return min(self.history, key=lambda h: (h[2], h[0]))[0]

    def predict(self, vector: Column) -> Column:
        """Prediction in label units for a vector column; null for a null vector."""
        network, weights, scale = self.network, self.weights, self.y_scale

        def run(vectors: pa.Array) -> pa.Array:
            out = np.full(len(vectors), np.nan)
            good = vectors.is_valid().to_numpy(zero_copy_only=False)
            if good.any():
                found = network.forward(weights, _matrix(vectors.drop_null()))[-1][:, 0]
                out[good] = found * scale.std + scale.mean
            return pa.array(out, mask=~good)

        return F.arrow_udf(run, T.DoubleType())(vector)

    def history_table(self, spark: SparkSession, run: str) -> DataFrame:
        """(run, epoch, train_loss, loss): what early stopping and learning curves read."""
        epochs, train, val = zip(*self.history)
        return constant_table(spark, {
            "run": ("string", [run] * len(epochs)), "epoch": ("int", list(epochs)),
            "train_loss": ("double", list(train)), "loss": ("double", list(val))})


def train_network(
    df: DataFrame, features: str, label: str, key: str, settings: NetworkSettings | None = None,
    split_col: str = "split", report: Callable[[int, float], bool] | None = None,
) -> TrainedNetwork:
    """Trains on the ``train`` rows (features already scaled), watches the ``val`` rows.

    Stops after ``patience`` epochs without a strictly lower validation loss, or when ``report(epoch,
    loss)`` says so; the weights of the best epoch count. Without val rows the train loss is
    watched. Rows without label or vector are left out.
    """
    settings = settings or NetworkSettings()
    usable = df.where(
        F.col(split_col).isin("train", "val") & F.col(label).isNotNull() & F.col(features).isNotNull())
    y_scale = StandardScale.fit(usable.where(F.col(split_col) == "train"), label)
    rows = stored(usable.select(
        (F.col(split_col) == "val").alias("val"), F.xxhash64(key).alias("h"),
        F.col(features).cast("array<double>").alias("x"),
        y_scale.scaled(F.col(label)).cast("double").alias("y"),
    ).mapInArrow(_blocks, _BLOCK), "network-rows")
    train, val = rows.where("not val"), rows.where("val")
    network = Network((train.agg(F.max("width")).first()[0], *settings.hidden, 1))
    weights, adam = network.start(settings.seed), None
    adam = Adam(len(weights))
    made, best, waited = TrainedNetwork(network, weights, y_scale), None, 0
    watched = not val.isEmpty()
    for epoch in range(settings.epochs):
        rate = settings.rate * settings.step_factor ** (epoch // settings.step_size)
        lost = seen = 0.0
        for batch in range(settings.batches):
            n, loss, gradient = _pass(train, network, weights, settings, epoch * settings.batches + batch)
            if n:
                weights = adam.move(weights, 2 * gradient / n, rate, settings.decay)
                lost, seen = lost + loss, seen + n
        n, loss, _ = _pass(val, network, weights, settings) if watched else (seen, lost, None)
        made.history.append((epoch, lost / seen, loss / n))
        if best is None or loss / n < best:
            best, waited, made.weights = loss / n, 0, weights
        else:
            waited += 1
        if report is not None and report(epoch, loss / n):
            made.stopped = "pruned"
            break
        if waited >= settings.patience:
            made.stopped = "patience"
            break
    return made

