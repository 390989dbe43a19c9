"""Wavelet smoothing inside blocks of the time axis.

All levels of a series of up to ``BLOCK`` samples are computed in one task, so such series are moved once.  A longer one is
cut into blocks that bring as many samples of their neighbours as ``LEVELS`` levels of the filter reach: its coefficients after these
levels are a series shorter by 2 ** ``LEVELS``, which is smoothed in the same way, and a second move takes it back up.
Borders are mirrored at every level.  Detail coefficients are set to zero, so they are never made.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.session import store
from driftgrid.spread import lookup, store_measured

KEYS = ("slice_id", "split")
#: Samples of a block (a multiple of 2 ** LEVELS), levels that are taken at once on longer series, and how far a block
#: reaches into its neighbours, in samples per coefficient of its last level.
BLOCK, LEVELS, REACH = 32768, 8, 16

# Decomposition low-pass taps of the Daubechies wavelet with four vanishing moments.
LOW_PASS = {
    "db4": (
        -0.010597401784997278,
        0.032883011666982945,
        0.030841381835986965,
        -0.18703481171888114,
        -0.02798376941698385,
        0.6308807679295904,
        0.7148465705525415,
        0.23037781330885523,
    )
}



class Part:
    """Samples ``first`` to ``first + len(values)`` of a series of ``n``."""

    def __init__(self, values: np.ndarray, first: int, n: int):
        self.values, self.first, self.n = values, first, n

    def at(self, places: np.ndarray) -> np.ndarray:
        """Samples at places of the mirrored axis."""
        folded = np.mod(places, 2 * self.n)
        folded = np.where(folded >= self.n, 2 * self.n - 1 - folded, folded) - self.first
        if folded.size and (folded.min() < 0 or folded.max() >= len(self.values)):
            raise ValueError("a block lacks samples of its neighbours")
        return self.values[folded]


def shorter(n: int, width: int) -> int:
    """Coefficients of a series of ``n`` samples after one level."""
    return (n + width - 1) // 2


def down_range(first: int, last: int, n: int, width: int) -> tuple[int, int]:
    """Samples that the coefficients ``first`` to ``last`` (not included) of the next level need, mirrored ones too."""
    low, high = 2 * first + 2 - width, 2 * last
    if n < 2 * width:
        return 0, n
    if low < 0:
        high = max(high, width)
    if high > n:
        low = min(low, n - width)
    return max(low, 0), min(high, n)


def down(part: Part, first: int, last: int, taps: np.ndarray) -> Part:
    """Coefficients ``first`` to ``last`` of the next level."""
    places = 2 * np.arange(first, last)[:, None] + 1 - np.arange(len(taps))
    return Part(part.at(places) @ taps, first, shorter(part.n, len(taps)))


def up(part: Part, first: int, last: int, n: int, taps: np.ndarray) -> Part:
    """Samples ``first`` to ``last`` of the level above, which has ``n``, from the low-pass part alone."""
    width, i = len(taps), np.arange(first, last)
    out = np.zeros(len(i))
    for half in range(width // 2):
        k = (i + width - 2) // 2 - half
        tap = width - 1 - (i + width - 2 - 2 * k)
        inside = (k >= 0) & (k < part.n)
        out[inside] += part.at(k[inside]) * taps[tap[inside]]
    return Part(out, first, n)


def up_range(first: int, last: int, n: int, width: int) -> tuple[int, int]:
    """Coefficients that the samples ``first`` to ``last`` of the level above need, of ``n`` coefficients."""
    return max((first - 1) // 2, 0), min((last + width - 3) // 2 + 1, n)


def lengths(n: int, levels: int, width: int) -> list[int]:
    out = [n]
    for _ in range(levels):
        out.append(shorter(out[-1], width))
    return out


def descend(part: Part, first: int, last: int, levels: int, taps: np.ndarray) -> Part:
    """Coefficients ``first`` to ``last`` after some levels; each level makes only what the next one needs."""
    sizes, spans = lengths(part.n, levels, len(taps)), [(first, last)]
    for level in range(levels - 1, 0, -1):
        spans.append(down_range(*spans[-1], sizes[level], len(taps)))
    for span in reversed(spans):
        if levels:
            part = down(part, *span, taps)
    return part


def ascend(part: Part, first: int, last: int, n: int, levels: int, taps: np.ndarray) -> Part:
    """Samples ``first`` to ``last`` of a series of ``n`` from its coefficients after some levels."""
    sizes, spans = lengths(n, levels, len(taps)), [(first, last)]
    for level in range(1, levels):
        spans.append(up_range(*spans[-1], sizes[level], len(taps)))
    for level in range(levels - 1, -1, -1):
        part = up(part, *spans[level], sizes[level], taps)
    return part


def smoothed(values: np.ndarray, levels: int, taps: np.ndarray) -> np.ndarray:
    """A whole series, down and up again."""
    n = len(values)
    size = lengths(n, levels, len(taps))[-1]
    return ascend(descend(Part(values, 0, n), 0, size, levels, taps), 0, n, n, levels, taps).values if levels else values


def max_level(n: Column, wavelet: str = "db4") -> Column:
    """Deepest useful level of a series of ``n`` samples."""
    width = len(LOW_PASS[wavelet]) - 1
    return F.when(n >= width, F.floor(F.log2(n / width))).otherwise(0).cast("int")


def _whole(rows: DataFrame, taps: np.ndarray) -> DataFrame:
    """Series that fit a block, each in one task; ``rows`` have pos, value and depth, and keep their columns."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        return group.assign(value=smoothed(group["value"].to_numpy(float), int(group["depth"].iloc[0]), taps))

    return rows.groupBy(*KEYS).applyInPandas(run, rows.schema)


def _in_blocks(rows: DataFrame, block: int, stretch: Column, run: Callable, schema: str) -> DataFrame:
    """Groups of (key, block) with the rows of the block and those that lie near it.

    A row at ``i`` stands for ``stretch`` samples from ``i * stretch`` on.
    """
    reach = REACH * F.pow(F.lit(2.0), F.col("steps")).cast("bigint")
    last = F.floor((F.col("n0") - 1) / block)
    middle = F.col("i") * stretch
    span = F.sequence(
        F.least(F.greatest(F.floor((middle - reach) / block), F.lit(0)), last), F.least(F.floor((middle + reach) / block), last)
    )
    return rows.withColumn("block", F.explode(span)).groupBy(*KEYS, "block").applyInPandas(run, schema)


def _long(rows: DataFrame, wavelet: str, block: int, levels: int) -> DataFrame:
    """(keys, i, smooth) of series longer than a block; ``rows`` are (keys, n0, depth, i, value)."""
    taps = np.array(LOW_PASS[wavelet])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in KEYS)
    rows = rows.withColumn("steps", F.least("depth", F.lit(levels)))

    def go_down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        top = group.iloc[0]
        n, steps, b = int(top["n0"]), int(top["steps"]), int(top["block"])
        size = lengths(n, steps, len(taps))[-1]
        first, last = b * block >> steps, size if (b + 1) * block >= n else (b + 1) * block >> steps
        part = Part(group["value"].to_numpy(float), int(group["i"].iloc[0]), n)
        values = descend(part, first, last, steps, taps).values
        return pd.DataFrame({**{k: top[k] for k in KEYS}, "n0": size, "depth": int(top["depth"]) - steps, "above": n, "steps": steps, "i": np.arange(first, last), "value": values})

    low = store(_in_blocks(rows, block, F.lit(1), go_down, f"{head}, n0 bigint, depth int, above bigint, steps int, i bigint, value double"))
    inner = low.select(*KEYS, "n0", "depth", "i", "value")
    again = _smooth(inner, wavelet, block, levels)
    carried = low.select(*KEYS, "above", "steps").distinct()
    back = lookup(again, carried, list(KEYS)).withColumnRenamed("above", "n0")

    def go_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        top = group.iloc[0]
        n, steps, b = int(top["n0"]), int(top["steps"]), int(top["block"])
        first, last = b * block, min(n, (b + 1) * block)
        part = Part(group["smooth"].to_numpy(float), int(group["i"].iloc[0]), lengths(n, steps, len(taps))[-1])
        return pd.DataFrame({**{k: top[k] for k in KEYS}, "i": np.arange(first, last), "smooth": ascend(part, first, last, n, steps, taps).values})

    stretch = F.pow(F.lit(2.0), F.col("steps")).cast("bigint")
    return _in_blocks(back, block, stretch, go_up, f"{head}, i bigint, smooth double")


def _smooth(rows: DataFrame, wavelet: str, block: int, levels: int) -> DataFrame:
    """(keys, i, smooth) of any series; ``rows`` are (keys, n0, depth, i, value), stored."""
    long = (F.col("n0") > block) & (F.col("depth") > 0)
    whole = _whole(rows.filter(~long).select(*KEYS, "depth", F.col("i").alias("pos"), "value"), np.array(LOW_PASS[wavelet]))
    out = whole.select(*KEYS, F.col("pos").alias("i"), F.col("value").alias("smooth"))
    if rows.filter(long).limit(1).count():
        out = out.union(_long(rows.filter(long), wavelet, block, levels))
    return out


def wavelet_smooth(df: DataFrame, wavelet: str = "db4", level: int | None = None, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """Replace ``value`` by its reconstruction from the deepest approximation, per slice and split.

    ``pos`` is the position within the split.  A slice is decomposed to its own maximal level,
    or to ``level`` if that is lower; a slice too short for one level stays as it is.
    """
    depth = max_level(F.col("n0"), wavelet)
    if level is not None:
        depth = F.least(depth, F.lit(level))
    sizes = store_measured(df.groupBy(*KEYS).agg((F.max("pos") + 1).alias("n0")).withColumn("depth", depth))
    long = (F.col("n0") > block) & (F.col("depth") > 0)
    some = sizes[0].agg(F.count_if(long).alias("long"), F.count_if(~long).alias("whole")).first()
    rows = lookup(df, sizes, list(KEYS))
    whole = _whole(rows.filter(~long), np.array(LOW_PASS[wavelet])).select(*df.columns)
    if not some["long"]:
        return whole
    rows = store(rows.filter(long))
    smooth = _long(rows.select(*KEYS, "n0", "depth", F.col("pos").alias("i"), "value"), wavelet, block, levels)
    joined = rows.join(smooth.withColumnRenamed("i", "pos"), [*KEYS, "pos"]).withColumn("value", F.col("smooth")).select(*df.columns)
    return whole.union(joined) if some["whole"] else joined
