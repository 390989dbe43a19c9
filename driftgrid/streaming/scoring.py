"""Samples scored against stored models as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftgrid.operators.pca import squared_sum
from driftgrid.sources.writers import read_runs, write_run
from driftgrid.spread import lookup
from driftgrid.streaming.grid import tumbling_means


def residual_of(z: Column, loadings: Column, k: Column) -> Column:
    """What the components (a flat array, one after the other) leave of a standardised vector."""
    d = F.size(z)
    add = lambda a, v: a + v
    axes = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.slice(loadings, c * d + 1, d))).otherwise(F.array().cast("array<array<double>>"))
    scores = F.transform(axes, lambda axis: F.aggregate(F.zip_with(z, axis, lambda a, b: a * b), F.lit(0.0), add))
    parts = F.zip_with(scores, axes, lambda s, axis: F.struct(s.alias("s"), axis.alias("axis")))
    return F.transform(z, lambda v, i: v - F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["s"] * F.get(p["axis"], i)))


def score_cells(cells: DataFrame, model: DataFrame | tuple[DataFrame, int]) -> DataFrame:
    """(slice_id, ts, loss) of every time with at least one cell, under models of ``fit_metric_pca``.

    A series of the model without a cell counts as its train mean; series that the model does not know are left out, and so are
    slices without a model.
    """
    times = cells.groupBy("slice_id", "ts").agg(F.map_from_entries(F.collect_list(F.struct("series_id", "value"))).alias("_cells"))
    joined = lookup(times, model, "slice_id")
    standard = lambda s, i: (F.try_element_at("_cells", s) - F.get("center", i)) / F.get("scale", i)
    z = F.transform("series", lambda s, i: F.coalesce(standard(s, i), F.lit(0.0)))
    scored = joined.withColumn("_z", z).withColumn("_r", residual_of(F.col("_z"), F.col("loadings"), F.col("k")))
    return scored.select("slice_id", "ts", squared_sum(F.col("_r")).alias("loss"))


def score_stream(
    samples: DataFrame,
    model: tuple[DataFrame, int],
    path: str,
    checkpoint: str,
    width: str = "1 hour",
    delay: str = "2 hours",
    at_once: bool = True,
) -> StreamingQuery:
    """Start scoring a stream of samples; grid cells go to ``path``/grid, losses to ``path``/loss (``writers.read_runs``).

    ``model`` comes from ``spread.store_measured``: measured once, then joined to every micro-batch where that lies.  A micro-batch
    writes one run with its own number, so a batch that is repeated after a failure replaces what it wrote, and a restart from
    the checkpoint goes on behind the last batch.  ``at_once`` reads all there is and stops.
    """

    def write(cells: DataFrame, batch: int) -> None:
        write_run(cells, f"{path}/grid", str(batch))
        kept = read_runs(cells.sparkSession, f"{path}/grid", [str(batch)])
        write_run(score_cells(kept, model), f"{path}/loss", str(batch))

    stream = tumbling_means(samples, width, delay).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if at_once else stream).start()
