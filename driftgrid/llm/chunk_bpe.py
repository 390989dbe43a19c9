"""Byte-level BPE encoding over overlapping chunks, and decoding.

A long text is cut into overlapping chunks that are pre-tokenised in parallel.  Neighbours are stitched at the
first boundary that both see in their overlap: from a common boundary on, the matches are the same.  The pieces
between stitches are encoded in parallel and their ids put together in order.  A text without a common
boundary in some overlap is encoded as one piece.  Short texts are one chunk and need no stitch.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.common import groups, ready
from driftgrid.session import store

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: A boundary this close to the end of a chunk may move when the text goes on.
MARGIN = 8
#: Pre-tokens a task remembers, and the longest it remembers.
CACHED, CACHED_CHARS = 300_000, 64
#: Pre-tokens of up to so many bytes are merged by scanning their few pairs.
SCANNED = 96


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank is merged first, the leftmost among equals.

    A short pre-token is scanned for that pair anew each time.  In a longer one parts are kept by start position,
    and pairs in a heap, so a long run costs n log n.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SCANNED:
        return scanned(piece, ranks)
    after = list(range(1, n + 1))  # start -> start of the next part
    before = list(range(-1, n))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n + [False]
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i]
        if not alive[i] or middle >= n or after[middle] != end:
            continue  # one of the two parts has changed
        alive[middle] = False
        after[i] = end
        if end < n:
            before[end] = i
            stop = after[end]
            r = get(piece[i:stop])
            if r is not None:
                heapq.heappush(heap, (r, i, stop))
        if i > 0:
            start = before[i]
            r = get(piece[start:end])
            if r is not None:
                heapq.heappush(heap, (r, start, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def scanned(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``merged`` for a short pre-token: a list of cuts, and one of the ranks of the pairs between them."""
    get, none = ranks.get, float("inf")
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        del pairs[i], cuts[i + 1]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def splitter(pattern: str):
    """The pre-token pattern; white space as Unicode defines it."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class Encoder:
    """Pre-tokens -> ids as little-endian 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known = ranks, {}

    def __call__(self, pieces: list[str]) -> bytes:
        get, out = self.known.get, []
        for p in pieces:
            ids = get(p)
            if ids is None:
                found = merged(p.encode(), self.ranks)
                ids = struct.pack(f"<{len(found)}I", *found)
                if len(p) <= CACHED_CHARS:
                    if len(self.known) >= CACHED:
                        self.known.clear()
                    self.known[p] = ids
            out.append(ids)
        return b"".join(out)


class Decoder:
    """Ids as little-endian 32-bit numbers -> the bytes they stand for, put together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.part = {n: b for b, n in ranks.items()}.__getitem__

    def __call__(self, ids: bytes) -> bytes:
        return b"".join(map(self.part, np.frombuffer(ids, "<u4").tolist()))


def boundaries(find, text: str, low: int, high: int, end: int) -> list[int]:
    """Match ends of ``text`` in [low, high) that do not depend on what follows ``end``."""
    out = [0] if low == 0 else []
    for m in find.finditer(text):
        if m.end() >= min(high, end - MARGIN + 1):
            break
        if m.end() >= low:
            out.append(m.end())
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(doc_id, ids binary): the ids as little-endian unsigned 32-bit numbers, one row per input row.

    With ``decoded`` a third column holds the bytes that the ids decode to, made in the task that has the ids, so that no
    second Python process stands beside it.  A null or empty text has no ids; a null id stays null, repeated rows are
    encoded each.  ``ranks`` must hold all single bytes.  Only id and text are looked at.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary file, of fixed size
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = F.char_length("text") <= chunk

    def whole(batches):
        find, encoder, out = splitter(pattern), Encoder(shared.value), results(shared, decoded)
        for b in batches:
            yield out(b.column(0), [encoder(find.findall(t)) for t in b.column(1).to_pylist()])

    return rows.filter(short).mapInArrow(whole, schema_of(decoded)).unionByName(encode_long(rows.filter(~short), shared, pattern, chunk, overlap, decoded))


def schema_of(decoded: bool) -> str:
    return "doc_id long, ids binary" + (", decoded binary" if decoded else "")


def results(shared, decoded: bool):
    """A function of document ids and token ids to a batch of results."""
    decoder = Decoder(shared.value) if decoded else None

    def out(docs: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        columns = [docs, pa.array(ids, pa.binary())]
        if decoder:
            columns.append(pa.array([decoder(x) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return out


def encode_long(rows: DataFrame, shared, pattern: str, chunk: int, overlap: int, decoded: bool) -> DataFrame:
    """The chunked path of ``encode``."""
    count = F.ceil(F.char_length("text") / chunk).cast("int")
    chunks = store(
        rows.withColumn("row", F.monotonically_increasing_id()).withColumn("last", count - 1)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("row", "doc_id", "k", "last", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
    )

    def ends(batches):
        find = splitter(pattern)
        for b in batches:
            head, tail = [], []
            for t in b.column(2).to_pylist():
                seen = boundaries(find, t, 0, chunk + overlap, len(t))
                head.append([x for x in seen if x < overlap])
                tail.append([x - chunk for x in seen if x >= chunk])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["row", "k", "head", "tail"])

    seen = store(chunks.select("row", "k", "text").mapInArrow(ends, "row long, k int, head array<int>, tail array<int>"))
    left = seen.select("row", (F.col("k") + 1).alias("k"), "tail")
    # The stitch before chunk k, as a position in that chunk.
    stitches = left.join(seen.select("row", "k", "head"), ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("tail", "head")).alias("at"))
    stitches = store(stitches)
    lost = stitches.filter("at is null").select("row").distinct()
    starts = stitches.select("row", "k", F.col("at").alias("start"))
    stops = stitches.select("row", (F.col("k") - 1).alias("k"), (F.col("at") + chunk).alias("stop"))
    pieces = chunks.join(lost, "row", "left_anti").join(starts, ["row", "k"], "left").join(stops, ["row", "k"], "left")

    def part(batches):
        find, encoder = splitter(pattern), Encoder(shared.value)
        for b in batches:
            ids = []
            for t, start, stop in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                stop = len(t) if stop is None else stop
                found = []
                for m in find.finditer(t, start or 0):
                    if m.start() >= stop:
                        break
                    found.append(m[0])
                ids.append(encoder(found))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], names=["row", "doc_id", "k", "ids"])

    def joined(batches):
        out = results(shared, decoded)
        for (row, doc), parts in groups(batches, 2):
            yield out(pa.array([doc], pa.int64()), [b"".join(p["ids"] for p in parts)])

    def again(batches):
        find, encoder, out = splitter(pattern), Encoder(shared.value), results(shared, decoded)
        for (row, doc), parts in groups(batches, 2):
            yield out(pa.array([doc], pa.int64()), [encoder(find.findall("".join(p["text"][:chunk] for p in parts)))])

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("row").sortWithinPartitions("row", "k")

    done = pieces.select("row", "doc_id", "k", "text", "start", "stop").mapInArrow(part, "row long, doc_id long, k int, ids binary")
    rest = chunks.join(lost, "row", "left_semi").select("row", "doc_id", "k", "text")
    return in_order(done).mapInArrow(joined, schema_of(decoded)).unionByName(in_order(rest).mapInArrow(again, schema_of(decoded)))


def decoder(spark: SparkSession, ranks: dict[bytes, int]):
    """A function of a column of ids, as ``encode`` gives them, to the bytes they stand for; null for null."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def decode(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to_bytes = Decoder(shared.value)
        for ids in column:
            yield pd.Series([None if x is None else to_bytes(x) for x in ids], dtype=object)

    return decode
