"""Files of losses."""

from pyspark.sql import functions as F

from driftgrid.sources import writers


def test_a_task_that_writes_losses_holds_few_bytes(spark, tmp_path, monkeypatch):
    """The same long slice id over and over is small in a shuffle; it still goes to many tasks."""
    monkeypatch.setattr(writers, "TASK_BYTES", 50_000, raising=False)
    long_id = "x" * 400
    df = spark.range(1200).select(
        F.when(F.col("id") % 3 == 0, long_id).when(F.col("id") % 3 == 1, "007").alias("slice_id"), F.lit(1.0).alias("loss")
    )
    path = str(tmp_path / "loss")
    writers.write_loss(df, path)
    back = writers.read_loss(spark, path)
    assert {r[0]: r[1] for r in back.groupBy("slice_id").count().collect()} == {long_id: 400, "007": 400, None: 400}
    sizes = back.groupBy(F.input_file_name()).agg(F.sum(F.length(F.coalesce("slice_id", F.lit("")))).alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 75_000  # 160,000 in all
    writers.write_loss(df.limit(0), str(tmp_path / "none"))
    writers.write_loss(df, path)
    assert writers.read_loss(spark, path).count() == 2400
