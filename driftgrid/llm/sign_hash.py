"""Near-duplicate vectors by random-hyperplane sign hashing.

Equal vectors are taken together first.  The others get, in each of several tables, the signs of their products with random
hyperplanes; vectors that share all signs of a table are compared exactly, in blocks, by cosine in double
precision.  A pair is counted in the first table it shares.  The number of signs follows from the number
of vectors, and the number of tables from the recall asked for at the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.blocks import block_pairs, spread_minimum
from driftgrid.llm.common import groups, ready
from driftgrid.llm.components import components
from driftgrid.session import store

THRESHOLD = 0.98
#: Chance that a pair right at the threshold shares a table.
RECALL = 0.9999
BLOCK = 1024
SEED = 41


def layout(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs per table, tables): buckets hold about one unrelated vector, whatever the number of vectors."""
    signs = min(60, max(12, math.ceil(math.log2(max(count, 2)))))
    share = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - share))


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, vec) of distinct rows that may link: finite, not zero, with a label and an id."""
    v = F.col("vec")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).distinct()


def hashed(reps: DataFrame, signs: int, tables: int) -> DataFrame:
    """``reps`` (rep, first, label, copies, vec) with ``sigs``: one number of ``signs`` bits per table."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(signs, dtype=np.int64)
        for b in batches:
            out = []
            for v in b.column(4).to_pylist():
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng(SEED).normal(size=(len(v), signs * tables))
                x = np.array(v)
                bits = (x / np.abs(x).max()) @ planes[len(v)] > 0
                out.append(bits.reshape(tables, signs) @ powers)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], names=["rep", "first", "label", "copies", "vec", "sigs"])

    label = reps.schema["label"].dataType.simpleString()
    return reps.select("rep", "first", "label", "copies", "vec").mapInArrow(run, f"rep long, first long, label {label}, copies long, vec array<double>, sigs array<long>")


def unit(rows: list[dict]) -> np.ndarray:
    x = np.array([r["vec"] for r in rows], np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(threshold: float):
    """Blocks of a bucket -> (rep, links, u, v): linked vectors found here; u is tied to v, a member of its component."""

    def run(batches):
        for key, rows in groups(batches, 6):
            t = key[2]
            one = [r for r in rows if r["side"] == 0]
            two = one if key[4] == key[5] else [r for r in rows if r["side"] == 1]
            if not one or not two:
                continue
            near = unit(one) @ unit(two).T >= threshold
            if one is two:
                np.fill_diagonal(near, False)
            sig1, sig2 = (np.array([r["sigs"][: t + 1] for r in part], np.int64) for part in (one, two))
            for earlier in range(t):
                near &= sig1[:, earlier][:, None] != sig2[:, earlier][None, :]
            copies1, copies2 = (np.array([r["copies"] for r in part], np.int64) for part in (one, two))
            links1, links2 = near @ copies2, copies1 @ near
            ids1, ids2 = (np.array([r["rep"] for r in part], np.int64) for part in (one, two))
            first = np.array([r["first"] for r in [*one, *two]], np.int64)
            at, n = np.concatenate(spread_minimum(near)), len(one)
            ids, links = ids1, links1
            if one is not two:
                ids, links, n = np.concatenate([ids1, ids2]), np.concatenate([links1, links2]), len(first)
            some = np.flatnonzero(links > 0)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], links[some], first[:n][some], first[at[:n][some]])], names=["rep", "links", "u", "v"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine reaches ``threshold``.  Null
    vectors, zero ones and those with null or non-finite components link with nothing; nor does a null id.
    Repeated rows are one vector; rows with one id but different vectors are one node with the links of all.
    """
    spark = ready(vectors.sparkSession)
    rows = store(usable(vectors, vec_id, embedding, label))
    equal = rows.groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    equal = store(equal.withColumn("rep", F.monotonically_increasing_id()))
    signs, tables = layout(equal.count(), threshold, recall)
    marked = store(hashed(equal, signs, tables))
    keys = ["label", "size", "t", "sig"]
    at = marked.select("rep", "label", F.size("vec").alias("size"), F.posexplode("sigs").alias("t", "sig"))
    full = at.groupBy(*keys).agg(F.count("*").alias("members")).filter("members > 1")
    members = store(at.join(full, keys))
    pairs = block_pairs(members, F.ceil(F.col("members") / block), "rep")
    sent = pairs.join(marked.select("rep", "first", "copies", "vec", "sigs"), "rep")
    place = [*keys, "i", "j"]
    sorted_blocks = sent.select(*place, "side", "rep", "first", "copies", "vec", "sigs").repartition(*place).sortWithinPartitions(*place)
    found = store(sorted_blocks.mapInArrow(compare(threshold), "rep long, links long, u long, v long"))
    joined = components(
        found.select("u", "v").union(rows.join(equal, ["label", "vec"]).select("vec_id", "first"))
    )
    # Links of a vector: the other copies of it, and those its representative found.
    per_rep = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = rows.join(equal, ["label", "vec"]).join(per_rep, "rep", "left").groupBy("vec_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    out = ids.join(own, "vec_id", "left").join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
