"""Rows with vectors for the searches: numbered once, read as matrices, and a stated set of them sent out in waves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import ready
from driftgrid.session import store

#: Bytes of vectors that one wave sends to every task.
WAVE_BYTES = 16_000_000


def numbered(vectors: DataFrame, vec_id: str, embedding: str, *also: Column, zero: bool = True) -> DataFrame:
    """(row, id, vec, also...), stored, of the rows that take part; ``row`` tells repeated rows apart.

    Out stay rows with a null id, a null vector, or null or non-finite components, and with ``zero`` off those
    without a component other than zero.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"), *also)
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad)
    if not zero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return store(rows.select(F.monotonically_increasing_id().alias("row"), "*"))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def by_length(table: pa.Table, column: str = "vec") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Parts of a table with vectors of one length, each with its matrix."""
    if not len(table):
        return
    lengths = table[column].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        part = table.filter(pa.array(lengths == d)).combine_chunks()
        yield part, part[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def waves(rows: DataFrame, wave_bytes: int | None = None) -> Iterator[pa.Table]:
    """All of ``rows``, by and by, in tables of at most about ``wave_bytes`` bytes of vectors.

    Rows that lie near each other (by the signs of their leading components) come in the same wave.
    """
    size = F.size("vec") * 8 + 64
    total, count = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n = -(-total // (wave_bytes or WAVE_BYTES))
    if n <= 1:
        if count:
            yield rows.toArrow().combine_chunks()
        return
    signs = F.transform(F.slice("vec", 1, 24), lambda x: F.when(x > 0, "1").otherwise("0"))
    dealt = rows.withColumn("_signs", F.concat_ws("", signs)).repartitionByRange(int(n), "_signs", "row").drop("_signs")
    dealt = store(dealt.withColumn("_wave", F.spark_partition_id()))
    for w in sorted(r[0] for r in dealt.select("_wave").distinct().collect()):
        yield dealt.filter(F.col("_wave") == w).drop("_wave").toArrow().combine_chunks()


def inner(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products of the rows with a vector, added up in the order of components, so that equal rows give equal values."""
    total = np.zeros(len(matrix))
    for d in range(len(vector)):
        total += matrix[:, d] * vector[d]
    return total
