"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.session import prepare

#: The white space that separates words: blank, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows per Arrow batch: whole texts may be long, so a batch holds few of them.
BATCH_ROWS = 256


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(batches: Iterator, keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal values in the first ``keys`` columns, over batch borders.

    Needs sorted partitions; holds one run at a time.
    """
    now, rows = None, []
    for batch in batches:
        heads = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        cut = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a).to_pylist()
            if heads[a] == now:
                rows += part
            else:
                if rows:
                    yield now, rows
                now, rows = heads[a], part
    if rows:
        yield now, rows
