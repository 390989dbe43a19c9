"""Line dedup with levelled sorted runs of line hashes.

Documents arrive in batches, by id.  The line hashes of a batch are merged against the runs, tables
bucketed and sorted by hash, so that the join moves no run; hashes that no run holds become a
new run of level 0.  When a level has ``FANOUT`` runs they are compacted into one run of the next level,
so the number of runs to merge grows with the logarithm of the number of batches.  A line goes
where its hash is owned by a smaller document id.  DataFrame functions throughout.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.common import BLANKS, lower_ascii, ready
from driftgrid.session import fresh_path
from driftgrid.spread import lookup

BATCHES, FANOUT, LEAST_CHARS = 4, 2, 10
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, copy, pos, key) for each line whose key has at least ``least_chars`` code points.

    key: 128-bit hash of the stripped, lower-cased line; copy: hash of the whole text, which tells rows with one id apart.
    """
    trimmed = F.btrim(F.col("line"), F.lit(BLANKS))
    return (
        docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("copy"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
        .filter(F.char_length(trimmed) >= least_chars)
        .select("doc", "copy", "pos", F.unhex(F.md5(lower_ascii(trimmed))).alias("key"))
    )


class Runs:
    """The runs of (key, owner) by level, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", fresh_path(self.spark, "run")).format("parquet").saveAsTable(name)
        self.tables.append(name)
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("fresh").select("key", "owner")

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge a batch of (doc, key); returns (key, owner) of the keys that some document shares."""
        met = lines.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        met = met.withColumn("owner", F.lit(None).cast("long"))
        for name in (n for level in self.levels for n in level):
            run = self.read(name).withColumnRenamed("owner", "held")
            met = met.join(run, "key", "left").withColumn("owner", F.coalesce("owner", "held")).drop("held")
        # A run holds what the merge did not find; what it found is kept beside it for the drop decisions.
        name = self.write(
            met.select("key", F.coalesce(F.least("owner", "first"), "first").alias("owner"), F.col("owner").isNull().alias("fresh"), (F.col("owner").isNotNull() | (F.col("last") > F.col("first"))).alias("shared"))
        )
        self.push(name, 0)
        return self.spark.table(name).filter("shared").select("key", "owner")

    def push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            union = reduce(DataFrame.unionByName, (self.read(n) for n in self.levels[level]))
            self.levels[level] = []
            self.push(self.write(union.repartition(self.buckets, "key").withColumn("fresh", F.lit(True)).withColumn("shared", F.lit(False))), level + 1)


def dropped_lines(docs: DataFrame, batches: int = BATCHES, least_chars: int = LEAST_CHARS, **columns: str) -> DataFrame:
    """(doc, copy, dropped): the sorted line numbers that go, for documents that lose any."""
    spark = ready(docs.sparkSession)
    keys = line_keys(docs, least_chars=least_chars, **columns)
    cuts = docs.agg(F.percentile_approx(F.col(columns.get("doc_id", "doc_id")).cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = reduce(lambda a, b: a + b, ((F.col("doc") > c).cast("int") for c in cuts), F.lit(0))
    path = fresh_path(spark, "lines")
    keys.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    held = spark.read.schema("doc long, copy long, pos int, key binary, batch int").parquet(path)
    runs, gone = Runs(spark), []
    for i in range(len(cuts) + 1):
        mine = held.filter(F.col("batch") == i).drop("batch")
        shared = runs.add(mine.select("doc", "key"))
        gone.append(lookup(mine, shared, "key").filter(F.col("doc") > F.col("owner")).select("doc", "copy", "pos"))
    every = reduce(DataFrame.unionByName, gone)
    return every.groupBy("doc", "copy").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def flags(dropped: Column) -> Column:
    """Sorted positions -> array of booleans, true at those positions."""
    return F.flatten(
        F.transform(dropped, lambda p, i: F.concat(F.array_repeat(F.lit(False), F.greatest(p - 1 - F.when(i > 0, F.get(dropped, i - 1)).otherwise(F.lit(-1)), F.lit(0))), F.array(F.lit(True))))
    )


def dedup_lines(docs: DataFrame, batches: int = BATCHES, least_chars: int = LEAST_CHARS, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the kept lines in the text column; all other columns as they are.

    A line whose key stands in at least two documents stays in the one with the smallest id alone, as often
    as it is there.  A null or empty text is one empty line and becomes an empty text.  Rows with one id are
    one document; a null id is one document after all others.  ``counts`` names two more columns for the lines
    before and the lines dropped.
    """
    tag = "_"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    gone = dropped_lines(docs, batches, least_chars, doc_id=doc_id, text=text)
    # The flags are made before the join, so that each row's array exists once.
    gone = gone.select(F.col("doc").alias(f"{tag}doc"), F.col("copy").alias(f"{tag}copy"), F.size("dropped").alias(f"{tag}n"), flags(F.col("dropped")).alias(f"{tag}flags"))
    rows = docs.withColumns({f"{tag}doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), f"{tag}copy": F.xxhash64(text)})
    met = lookup(rows, gone, [f"{tag}doc", f"{tag}copy"], "left")
    lines = lines_of(F.col(text))
    kept = F.when(F.col(f"{tag}n").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(f"{tag}flags"), i), F.lit(False))), "\n")
    )
    more = {} if counts is None else {counts[0]: F.size(lines).cast("long"), counts[1]: F.coalesce(f"{tag}n", F.lit(0)).cast("long")}
    out = met.withColumns({f"{tag}text": kept, **more}).withColumn(text, F.col(f"{tag}text"))
    return out.select(*docs.columns, *more)
