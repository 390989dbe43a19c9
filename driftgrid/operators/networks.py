"""Small neural networks, one per slice, trained on windows: a gated recurrent forecaster and a stacked encoder.

Both start from the linear detector of the same kind, which stays in them as a fixed path, and learn what it leaves: with
the weights they start with they give the linear answer.  A step sums the gradient over all train windows
in the tasks, then by slice, a bounded number of sums in a task at a time, and gives the new weights of all slices in one job.  The
last fifth of the train windows is held out; a slice stops when the loss there has not fallen for some steps, and keeps its
best weights.  Weights go to the tasks by broadcast; slices whose weights are too many for one are trained in several rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from driftgrid import spread
from driftgrid.operators.moments import FAN
from driftgrid.operators.windows import fit_forecast, fit_window_autoencoder
from driftgrid.session import store
from driftgrid.spread import lookup

#: Steps at most, first step size, steps without a better held-out loss, and how much better it must be (relative).
STEPS, RATE, PATIENCE, LEAST_GAIN = 40, 0.002, 10, 1e-4
#: How a step size grows and shrinks, and the largest one.
GROW, SHRINK, LARGEST_STEP = 1.2, 0.5, 0.5
HELD_SHARE = 0.2
#: Windows that are worked on at once.
ROWS = 2048
ARRAYS = ("weights", "sizes", "gradient", "best", "fixed")
STATE = "step int, waited int, done boolean, train_loss double, held_loss double, best_loss double, " + ", ".join(f"{a} array<double>" for a in ARRAYS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights as one flat array, cut into named parts."""

    shapes: dict[str, tuple[int, ...]]
    zero: Sequence[str] = ()

    @property
    def size(self) -> int:
        return sum(math.prod(s) for s in self.shapes.values())

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = math.prod(shape)
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, seed: int = 7) -> np.ndarray:
        """Uniform weights by the number of inputs; those of the last layers are zero, so that the linear path decides."""
        draw = np.random.default_rng(seed)
        out = []
        for name, shape in self.shapes.items():
            reach = 0.0 if name in self.zero or len(shape) == 1 else math.sqrt(6 / shape[0])
            out.append(draw.uniform(-reach, reach, shape).ravel())
        return np.concatenate(out)

    def output(self, flat: np.ndarray, fixed: np.ndarray, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def loss_and_gradient(self, flat: np.ndarray, fixed: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed over the windows: the mean squared error of each, and its derivative by the weights."""
        raise NotImplementedError

    def loss(self, flat: np.ndarray, fixed: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
        raise NotImplementedError


class GatedForecaster(Network):
    """The next value from a linear path over the window plus a gated recurrent unit that reads it value by value."""

    def __init__(self, length: int, hidden: int = 8):
        self.length, self.hidden = length, hidden
        h = hidden
        self.shapes = {
            "wz": (1, h), "wr": (1, h), "wc": (1, h), "uz": (h, h), "ur": (h, h), "uc": (h, h),
            "bz": (h,), "br": (h,), "bc": (h,), "out": (h, 1), "bias": (1,),
        }
        self.zero = ("out",)

    def forward(self, flat: np.ndarray, x: np.ndarray):
        w = self.parts(flat)
        h, steps = np.zeros((len(x), self.hidden)), []
        for t in range(self.length):
            v = x[:, t : t + 1]
            z = sigmoid(v * w["wz"] + h @ w["uz"] + w["bz"])
            r = sigmoid(v * w["wr"] + h @ w["ur"] + w["br"])
            c = np.tanh(v * w["wc"] + (r * h) @ w["uc"] + w["bc"])
            steps.append((h, z, r, c))
            h = (1 - z) * h + z * c
        return w, h, steps

    def output(self, flat, fixed, x):
        w, h, _ = self.forward(flat, x)
        return fixed[0] + x @ fixed[1:] + (h @ w["out"])[:, 0] + w["bias"]

    def loss(self, flat, fixed, x, y):
        return float(((self.output(flat, fixed, x) - y) ** 2).sum())

    def loss_and_gradient(self, flat, fixed, x, y):
        w, h, steps = self.forward(flat, x)
        miss = fixed[0] + x @ fixed[1:] + (h @ w["out"])[:, 0] + w["bias"] - y
        back = 2 * miss[:, None]
        g = {name: np.zeros(shape) for name, shape in self.shapes.items()}
        g["out"], g["bias"] = h.T @ back, back.sum(axis=0)
        dh = back * w["out"][:, 0]
        for t in range(self.length - 1, -1, -1):
            before, z, r, c = steps[t]
            v = x[:, t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - before) * z * (1 - z)
            inner = dc @ w["uc"].T
            dr = inner * before * r * (1 - r)
            for k, d, seen in (("z", dz, before), ("r", dr, before), ("c", dc, r * before)):
                g["w" + k] += v @ d
                g["u" + k] += seen.T @ d
                g["b" + k] += d.sum(axis=0)
            dh = dh * (1 - z) + dz @ w["uz"].T + dr @ w["ur"].T + inner * r
        return float((miss * miss).sum()), np.concatenate([g[name].ravel() for name in self.shapes])


class StackedEncoder(Network):
    """A window through layers that narrow to a code and widen again, beside a linear path through the same code."""

    def __init__(self, length: int, narrow: Sequence[int] = (32, 16, 4), widen: Sequence[int] = (4, 16, 32)):
        self.length, self.code, self.down = length, narrow[-1], len(narrow)
        widths = [length, *narrow, *widen, length]
        self.layers = len(widths) - 1
        self.shapes = {}
        for i in range(self.layers):
            self.shapes[f"w{i}"], self.shapes[f"b{i}"] = (widths[i], widths[i + 1]), (widths[i + 1],)
        self.zero = (f"w{self.down - 1}", f"w{self.layers - 1}")

    def linear(self, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean window and the axes of the linear path (code x length; missing ones are zero)."""
        axes = np.zeros((self.code, self.length))
        given = fixed[self.length :].reshape(-1, self.length)[: self.code]
        axes[: len(given)] = given
        return fixed[: self.length], axes

    def forward(self, flat: np.ndarray, fixed: np.ndarray, x: np.ndarray):
        w, (mean, axes) = self.parts(flat), self.linear(fixed)
        a, inputs, code = x - mean, [], None
        for i in range(self.layers):
            inputs.append(a)
            a = a @ w[f"w{i}"] + w[f"b{i}"]
            if i == self.down - 1:
                a = code = a + (x - mean) @ axes.T
            elif i < self.layers - 1:
                a = np.tanh(a)
        return w, axes, inputs, a + code @ axes + mean

    def output(self, flat, fixed, x):
        return self.forward(flat, fixed, x)[3]

    def loss(self, flat, fixed, x, y):
        return float(((self.output(flat, fixed, x) - x) ** 2).mean(axis=1).sum())

    def loss_and_gradient(self, flat, fixed, x, y):
        w, axes, inputs, out = self.forward(flat, fixed, x)
        miss = out - x
        back = 2 * miss / self.length
        g, to_code = {}, back @ axes.T
        for i in range(self.layers - 1, -1, -1):
            if i == self.down - 1:
                back = back + to_code
            elif i < self.layers - 1:
                back = back * (1 - inputs[i + 1] ** 2)
            g[f"w{i}"], g[f"b{i}"] = inputs[i].T @ back, back.sum(axis=0)
            back = back @ w[f"w{i}"].T
        return float((miss * miss).mean(axis=1).sum()), np.concatenate([g[name].ravel() for name in self.shapes])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gradients(windows: DataFrame, network: Network, shared) -> DataFrame:
    """(slice_id, part, n, loss, held_n, held_loss, gradient): the sums of each task for the slices in training."""
    kind = windows.schema["slice_id"].dataType.simpleString()
    schema = f"slice_id {kind}, part bigint, n bigint, loss double, held_n bigint, held_loss double, gradient array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sums, label = TaskContext.get().partitionId(), {}, None
        for batch in batches:
            label = batch.schema.field("slice_id").type
            slices = batch.column("slice_id").to_pandas()
            for name, at in slices.groupby(slices, sort=False).indices.items():
                if name not in shared.value:
                    continue
                weights, fixed = shared.value[name]
                total = sums.setdefault(name, [0, 0.0, 0, 0.0, np.zeros(network.size)])
                for i in range(0, len(at), ROWS):
                    rows = batch.take(pa.array(at[i : i + ROWS]))
                    x, y, held = matrix(rows.column("x")), rows.column("y").to_numpy(), rows.column("held").to_numpy(zero_copy_only=False)
                    if held.any():
                        total[2] += int(held.sum())
                        total[3] += network.loss(weights, fixed, x[held], y[held])
                    if not held.all():
                        loss, gradient = network.loss_and_gradient(weights, fixed, x[~held], y[~held])
                        total[0] += int((~held).sum())
                        total[1] += loss
                        total[4] += gradient
        if sums:
            columns = list(zip(*sums.values()))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), label), pa.array([part] * len(sums)), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["slice_id", "part", "n", "loss", "held_n", "held_loss", "gradient"],
            )

    return windows.select("slice_id", "held", "x", "y").mapInArrow(run, schema)


def summed(parts: DataFrame, count: int) -> DataFrame:
    """Sums of ``FAN`` tasks at a time, until at most ``FAN`` per slice are left."""

    def total(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        row = group.iloc[:1].assign(**{c: group[c].sum() for c in ("n", "loss", "held_n", "held_loss")})
        return row.assign(gradient=[np.sum(np.stack(group["gradient"].to_numpy()), axis=0)])

    while count > FAN:
        count = -(-count // FAN)
        parts = store(parts.withColumn("part", F.floor(F.col("part") / FAN).cast("bigint")).groupBy("slice_id", "part").applyInPandas(total, parts.schema))
    return parts


def next_state(old: dict, n: int, loss: float, held_n: int, held_loss: float, gradient: np.ndarray, steps: int, patience: int, gain: float) -> dict:
    """One step of the weights of a slice, by the signs of their gradients (Riedmiller, Braun 1993).

    A weight's own step grows while its gradient keeps its sign and shrinks when that turns; over all windows at once gradients have
    no noise, so signs can be trusted.  The losses are those of the old weights.  Without held-out windows the train loss decides.
    """
    train = loss / n if n else 0.0
    held = held_loss / held_n if held_n else train
    new = dict(old, train_loss=train, held_loss=held)
    if held < old["best_loss"] * (1 - gain) or old["step"] == 0:
        new.update(best=old["weights"], best_loss=held, waited=0)
    else:
        new["waited"] = old["waited"] + 1
    step = old["step"] + 1
    new.update(step=step, done=bool(new["waited"] >= patience or step > steps or not n or not np.isfinite(held)))
    if new["done"]:
        return new
    g, last = gradient / n, old["gradient"]
    size = np.where(g * last > 0, np.minimum(old["sizes"] * GROW, LARGEST_STEP), np.where(g * last < 0, old["sizes"] * SHRINK, old["sizes"]))
    g = np.where(g * last < 0, 0.0, g)  # a weight that went too far waits for one step
    new.update(sizes=size, gradient=g, weights=old["weights"] - np.sign(g) * size)
    return new


def stepper(known, fields: Sequence[str], steps: int, patience: int, gain: float):
    """The step of a slice from the last sums of its gradient."""

    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        name = group["slice_id"].iloc[0]
        new = next_state(
            known.value[name], int(group["n"].sum()), float(group["loss"].sum()), int(group["held_n"].sum()), float(group["held_loss"].sum()),
            np.sum(np.stack(group["gradient"].to_numpy()), axis=0), steps, patience, gain,
        )
        return pd.DataFrame([{"slice_id": name, **new}])[list(fields)]

    return step


def held_out(windows: DataFrame, share: float = HELD_SHARE) -> DataFrame:
    """The train windows of each slice, the last ``share`` of them marked ``held``."""
    train = windows.filter(F.col("split") == "train")
    ends = train.groupBy("slice_id").agg(F.min("pos").alias("_from"), F.max("pos").alias("_to"))
    cut = F.col("_from") + F.ceil((F.col("_to") - F.col("_from") + 1) * F.lit(1 - share))
    return lookup(train, ends, "slice_id").select("slice_id", (F.col("pos") >= cut).alias("held"), "x", "y")


def train(
    windows: DataFrame,
    linear: DataFrame,
    network: Network,
    steps: int = STEPS,
    rate: float = RATE,
    patience: int = PATIENCE,
    gain: float = LEAST_GAIN,
    share: float = HELD_SHARE,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """(slice_id, state): networks of all slices of ``linear`` (slice_id, fixed), with their best weights and losses.

    A slice without train windows has no network.
    """
    spark = windows.sparkSession
    rows = store(held_out(windows, share))
    limit = spread.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    slices = linear.join(rows.select("slice_id").distinct(), "slice_id")
    slices, bytes_ = spread.store_measured(slices.select("slice_id", "fixed"))
    count = slices.count()
    # Weights and the fixed path go to the sums; moments and best weights too where the step is made.
    rounds = max(1, -(-(bytes_ + count * network.size * 8 * 6) // max(limit, 1)))
    kind = windows.schema["slice_id"].dataType.simpleString()
    schema = f"slice_id {kind}, {STATE}"
    fields = [f.split()[0] for f in schema.split(", ")]
    results = []
    for i in range(min(rounds, max(count, 1))):
        own = slices.filter(F.pmod(F.xxhash64("slice_id"), F.lit(rounds)) == i) if rounds > 1 else slices
        start, none = network.start(), np.zeros(network.size)
        state = {
            r["slice_id"]: dict(step=0, waited=0, done=False, train_loss=np.inf, held_loss=np.inf, best_loss=np.inf,
                                weights=start, sizes=none + rate, gradient=none, best=start, fixed=np.array(r["fixed"]))
            for r in own.collect()
        }
        mine = rows if rounds == 1 else rows.filter(F.pmod(F.xxhash64("slice_id"), F.lit(rounds)) == i)
        finished, tasks = [], None
        while state:
            sent = spark.sparkContext.broadcast({name: (s["weights"], s["fixed"]) for name, s in state.items()})
            known = spark.sparkContext.broadcast(state)

            parts = gradients(mine, network, sent)
            if tasks is None:  # how many sums there are is seen in the first step
                seen = Observation()
                parts = store(parts.observe(seen, F.max("part").alias("last")))
                tasks = (seen.get["last"] or 0) + 1
            if tasks > FAN:
                parts = summed(store(parts), tasks)
            # One row per slice in training; their bytes are bounded by the rounds.
            got = parts.groupBy("slice_id").applyInPandas(stepper(known, fields, steps, patience, gain), schema).collect()
            finished += [r for r in got if r["done"]]
            state = {r["slice_id"]: {f: np.array(r[f]) if f in ARRAYS else r[f] for f in fields[1:]} for r in got if not r["done"]}
            sent.unpersist()
            known.unpersist()
        results.append(store(spark.createDataFrame(finished, schema)))
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out


def fit_gated_forecast(windows: DataFrame, hidden: int = 8, **options) -> DataFrame:
    """Recurrent forecasters on the train windows, from the linear forecast of each slice on."""
    linear = fit_forecast(windows).withColumnRenamed("coef", "fixed")
    return train(windows, linear, GatedForecaster(_length(windows), hidden), **options)


def fit_stacked_encoder(windows: DataFrame, narrow: Sequence[int] = (32, 16, 4), widen: Sequence[int] = (4, 16, 32), **options) -> DataFrame:
    """Stacked encoders on the train windows, from the principal components of each slice on."""
    linear = fit_window_autoencoder(windows, k=narrow[-1]).select("slice_id", F.concat("mean", "loadings").alias("fixed"))
    return train(windows, linear, StackedEncoder(_length(windows), narrow, widen), **options)


def _length(windows: DataFrame) -> int:
    row = windows.select(F.size("x").alias("n")).first()
    return row["n"] if row else 1


def outputs(windows: DataFrame, model: DataFrame, network: Network, shape: str) -> DataFrame:
    """``windows`` with ``output``, the networks' answer; windows of slices without a network are left out."""
    models, size = spread.store_measured(model.select("slice_id", "best", "fixed"))
    spark, kept = windows.sparkSession, windows.columns
    rounds = max(1, -(-size // spread.BROADCAST_BYTES))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields] + [f"output {shape}"])
    parts = []
    for i in range(rounds):
        of = (lambda df, i=i: df.filter(F.pmod(F.xxhash64("slice_id"), F.lit(rounds)) == i)) if rounds > 1 else (lambda df: df)
        shared = spark.sparkContext.broadcast({r["slice_id"]: (np.array(r["best"]), np.array(r["fixed"])) for r in of(models).collect()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slices = batch.column("slice_id").to_pandas()
                for name, at in slices.groupby(slices, sort=False).indices.items():
                    if name in shared.value:
                        rows = batch.take(pa.array(at))
                        out = network.output(*shared.value[name], matrix(rows.column("x")))
                        values = pa.array(list(out), pa.list_(pa.float64())) if out.ndim == 2 else pa.array(out)
                        yield pa.RecordBatch.from_arrays([*rows.columns, values], names=[*kept, "output"])

        parts.append(of(windows).mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def gated_forecast_loss(windows: DataFrame, model: DataFrame, hidden: int = 8, against: str = "window") -> DataFrame:
    """Error of the recurrent forecast: mean squared distance of the window from it, or of the target."""
    found = outputs(windows, model, GatedForecaster(_length(windows), hidden), "double").withColumnRenamed("output", "predicted")
    p = F.col("predicted")
    if against == "window":
        loss = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - p) * (v - p)) / F.size("x")
    elif against == "target":
        loss = (F.col("y") - p) * (F.col("y") - p)
    else:
        raise ValueError(f"against must be 'window' or 'target', not {against!r}")
    return found.withColumn("loss", loss).select("slice_id", "split", "ts", "pos", "predicted", "loss")


def stacked_encoder_loss(windows: DataFrame, model: DataFrame, narrow: Sequence[int] = (32, 16, 4), widen: Sequence[int] = (4, 16, 32)) -> DataFrame:
    """Mean squared error between a window and what the encoder makes of it."""
    found = outputs(windows, model, StackedEncoder(_length(windows), narrow, widen), "array<double>")
    squares = F.zip_with("x", "output", lambda a, b: (a - b) * (a - b))
    loss = F.aggregate(squares, F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return found.withColumn("loss", loss).select("slice_id", "split", "ts", "pos", "loss")
