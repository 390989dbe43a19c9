"""Nearest neighbours by inner product with a forest of hash prefixes.

Every row is in one block, dealt by a hash, and every block has a forest: in each tree the rows are sorted by a
string of ``BITS`` bits, the signs of their products with random hyperplanes.  A query descends in
every tree to its longest matching prefix, and all trees then ascend together, one bit at a time, until the
ranges of rows with the common prefix hold enough candidates; these are scored exactly on the vectors.
How many are enough is measured on a sample of blocks against brute force.  Lengths of vectors may differ, so rows get one more
component that makes all equally long (the largest length); then the angle to a query orders rows as the inner product does.

Queries come in waves of bounded size, and each wave reads the stored forest where it lies; only the best
candidates per query and block are shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.common import bound
from driftgrid.llm.vector_rows import by_length, inner, numbered, waves
from driftgrid.session import store

TREES, BITS = 64, 32
BLOCK_ROWS, BLOCK_BYTES = 8192, 16_000_000
#: Candidates of a block that a query scores at least; the share of true neighbours wanted in the sampled blocks.
LEAST, RECALL = 1024, 0.95
#: The sample that the number of candidates is fitted on: blocks, and queries of each.
SAMPLE_BLOCKS, SAMPLE_QUERIES = 4, 128
SEED = 59
RECORD = "block int, size int, ids binary, rows binary, vecs binary, keys binary, order binary"


class Forest(NamedTuple):
    """rows: the stored rows (row, id, vec); blocks: one record per block and vector length; longest: the largest length."""

    rows: DataFrame
    blocks: DataFrame
    longest: float


def lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return top[:, 0] * np.sqrt(((x / top) ** 2).sum(axis=1))


def planes(d: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(d + 1, trees * BITS)).astype(np.float32)


def strings(x: np.ndarray, last: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hash strings (rows x trees) of scaled rows and their added component."""
    bits = (x.astype(np.float32) @ p[:-1] + last[:, None].astype(np.float32) * p[-1]) > 0
    return np.packbits(bits.reshape(len(x), -1, BITS), axis=2).view(">u4")[:, :, 0].astype(np.uint32)


def build(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES, block_rows: int = BLOCK_ROWS) -> Forest:
    """The stored forest of all rows that are finite and not zero.  An empty table gives a forest without blocks."""
    rows = numbered(vectors, vec_id, embedding, zero=False)
    top = F.array_max(F.transform("vec", F.abs))
    length = bound(top, lambda t: t * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / t) * (x / t))))
    count, size, longest = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vec") * 8), F.lit(0)), F.max(length)).first()
    blocks = max(1, -(-count // block_rows), -(-size // BLOCK_BYTES))
    longest = (longest or 1.0) * (1 + 1e-12)

    def grow(ids, numbers, x, block, p):
        unit = x / longest
        keys = strings(unit, np.sqrt(np.maximum(0, 1 - lengths(unit) ** 2)), p).T
        order = np.argsort(keys, axis=1, kind="stable").astype(np.uint32)
        held = (ids, numbers, np.ascontiguousarray(x), np.take_along_axis(keys, order.astype(np.int64), 1), order)
        return [block, x.shape[1], *(a.tobytes() for a in held)]

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for part in runs(batches):
            for same, x in by_length(part):
                d = x.shape[1]
                if d not in known:
                    known[d] = planes(d, trees)
                record = grow(same["id"].to_numpy(), same["row"].to_numpy(), x, same["block"][0].as_py(), known[d])
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(record, kinds)], names=[f.split()[0] for f in RECORD.split(", ")])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    forest = dealt.repartition("block").sortWithinPartitions("block", "row").mapInArrow(run, RECORD)
    return Forest(rows, store(forest), longest)


def runs(batches):
    """The blocks of sorted rows, one table each."""
    held = []
    for b in batches:
        if not len(b):
            continue
        block = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:]):
            if held and held[0].column("block")[0].as_py() != block[i]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Block:
    """One record of the forest."""

    def __init__(self, record: dict):
        self.ids, self.rows = np.frombuffer(record["ids"], np.int64), np.frombuffer(record["rows"], np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(record["vecs"], np.float64).reshape(n, record["size"])
        self.keys = np.frombuffer(record["keys"], np.uint32).reshape(-1, n)
        self.order = np.frombuffer(record["order"], np.uint32).reshape(-1, n)

    def matches(self, keys: np.ndarray) -> np.ndarray:
        """Descent: the longest prefix that each query (row of ``keys``) shares with a row of any tree."""
        best = np.full(len(keys), BITS)
        for t, own in enumerate(self.keys):
            at = np.searchsorted(own, keys[:, t])
            apart = np.minimum(own[np.minimum(at, len(own) - 1)] ^ keys[:, t], own[np.maximum(at - 1, 0)] ^ keys[:, t])
            best = np.minimum(best, np.frexp(apart.astype(np.float64))[1])
        return BITS - best

    def ranges(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (queries x trees) of the rows that share ``level`` bits."""
        width = np.uint64(1 << (BITS - level))
        low = keys.astype(np.uint64) // width * width
        first, last = np.empty(keys.shape, np.int32), np.empty(keys.shape, np.int32)
        for t, own in enumerate(self.keys):
            first[:, t] = np.searchsorted(own, low[:, t].astype(np.uint32))
            last[:, t] = np.searchsorted(own, (low[:, t] + width - np.uint64(1)).astype(np.uint32), side="right")
        return first, last

    def climb(self, keys: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascent: all trees of a query go up together until their ranges hold ``wanted`` rows, or everything."""
        first, last = np.zeros(keys.shape, np.int32), np.full(keys.shape, len(self.ids), np.int32)
        at = self.matches(keys)
        waiting = np.arange(len(keys))
        for level in range(int(at.max(initial=0)), 0, -1):
            ready = waiting[at[waiting] >= level]
            if not len(ready):
                continue
            a, b = self.ranges(keys[ready], level)
            enough = (b - a).sum(axis=1) >= wanted
            first[ready[enough]], last[ready[enough]] = a[enough], b[enough]
            waiting = np.setdiff1d(waiting, ready[enough])
        return first, last


def wanted_candidates(forest: Forest, k: int, least: int = LEAST, recall: float = RECALL) -> int:
    """Candidates per query and block with which the sampled blocks give ``recall`` of their k nearest rows."""

    def run(batches):
        for b in batches:
            for record in b.to_pylist():
                block = Block(record)
                n = len(block.ids)
                ask = np.arange(min(n, SAMPLE_QUERIES))
                q = block.x[ask]
                scores = q @ block.x.T
                scores[ask, ask] = -np.inf
                near = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
                if not near.size:
                    continue
                keys = strings(q / lengths(q)[:, None], np.zeros(len(q)), planes(block.x.shape[1], len(block.keys)))
                own = np.empty_like(block.keys)
                np.put_along_axis(own, block.order.astype(np.int64), block.keys, 1)
                apart = np.min([np.frexp((own[t][near] ^ keys[:, t, None]).astype(np.float64))[1] for t in range(len(own))], axis=0)
                found = BITS - apart  # a neighbour is met at this level and above
                counts = []
                for level in range(BITS + 1):
                    a, z = block.ranges(keys, level)
                    counts.append((z - a).sum(axis=1))
                counts = np.array(counts)
                want = least
                while want < counts[0].max():
                    level = (counts >= want).sum(axis=0) - 1
                    if (found >= np.maximum(level, 0)[:, None]).mean() >= recall:
                        break
                    want = int(want * 1.1) + 1
                yield pa.RecordBatch.from_arrays([pa.array([want])], names=["want"])

    sample = forest.blocks.filter(F.col("block") < SAMPLE_BLOCKS)
    return sample.mapInArrow(run, "want long").agg(F.max("want")).first()[0] or least


def search(forest: Forest, queries: DataFrame, k: int = 20, wanted: int | None = None, wave_bytes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows found for each of ``queries`` (row, id, vec).

    ``score`` is the inner product in double precision, added up in the order of components; equal scores are ordered by id.
    The row of a query itself is left out, other rows with its id or its vector are not, so that repeated rows
    find each other.  Rows of another vector length are no candidates.
    """
    wanted = wanted or wanted_candidates(forest, k)
    spark, shape = forest.rows.sparkSession, "query long, query_id long, row long, vec_id long, score double"
    parts = []
    for wave in waves(queries, wave_bytes):
        asked = {x.shape[1]: (part["row"].to_numpy(), part["id"].to_numpy(), x) for part, x in by_length(wave)}
        shared = spark.sparkContext.broadcast(asked)

        def run(batches, shared=shared):
            keys = {}
            for d, (_, _, x) in shared.value.items():
                keys[d] = None
            for b in batches:
                for record in b.to_pylist():
                    d = record["size"]
                    if d not in shared.value:
                        continue
                    block, (numbers, ids, asked) = Block(record), shared.value[d]
                    if keys[d] is None:
                        keys[d] = strings(asked / lengths(asked)[:, None], np.zeros(len(asked)), planes(d, len(block.keys)))
                    yield from best(block, numbers, ids, asked, keys[d], k, wanted)

        parts.append(store(forest.blocks.mapInArrow(run, shape)))
        shared.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(block: Block, numbers: np.ndarray, ids: np.ndarray, asked: np.ndarray, keys: np.ndarray, k: int, wanted: int):
    """The k best candidates of a block for each query, as record batches."""
    first, last = block.climb(keys, wanted)
    size = lengths(block.x).max(initial=0)
    slack = 4 * block.x.shape[1] * np.finfo(np.float64).eps * size * lengths(asked)
    mark = np.zeros(len(block.ids), bool)
    out: list[list] = [[], [], [], [], []]
    for q in range(len(asked)):
        mark[:] = False
        mark[np.concatenate([o[a:b] for o, a, b in zip(block.order, first[q].tolist(), last[q].tolist())])] = True
        mark &= block.rows != numbers[q]
        at = np.flatnonzero(mark)
        about = block.x[at] @ asked[q]
        if len(at) > k:
            # Those near the k-th value by more than rounding can explain are out.
            at = at[about >= np.partition(about, len(at) - k)[len(at) - k] - slack[q]]
        score = inner(block.x[at], asked[q])
        top = np.lexsort((block.rows[at], block.ids[at], -score))[:k]
        n = len(top)
        for o, v in zip(out, (np.full(n, numbers[q]), np.full(n, ids[q]), block.rows[at[top]], block.ids[at[top]], score[top])):
            o.append(v)
        if len(out[0]) >= 1000 or q == len(asked) - 1:
            arrays = [pa.array(np.concatenate(o)) for o in out]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "query_id", "row", "vec_id", "score"])
            out = [[], [], [], [], []]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row whose id is divisible by ``every``.

    Null ids, null vectors, zero ones and those with null or non-finite components take no part; an empty table gives
    no rows; other columns are not looked at.
    """
    forest = build(vectors, vec_id, embedding, **options)
    return search(forest, forest.rows.filter(F.col("id") % every == 0), k)
