"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum; each agrees between
two documents with probability equal to their similarity, so half the hash evaluations make a
signature of the same length.  The signature is cut into bands; documents that share a band are
candidates.  Documents with equal shingle sets are one class from the start.  Candidates are confirmed on their full
sets inside tasks, in blocks, and only between classes that are not connected yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid import spread
from driftgrid.llm.common import groups, ready
from driftgrid.llm.components import components
from driftgrid.session import store
from driftgrid.spread import lookup, store_measured

#: Words per shingle, percent of similarity, bands, values per band.
WORDS, PERCENT, BANDS, ROWS = 5, 80, 24, 5
#: Bands of the first round of comparisons, which connects most copies before all bands are looked at.
FIRST_BANDS = 3
#: A block holds about so many documents and shingles at most; each block of the first round holds about PIVOTS shared documents.
BLOCK, BLOCK_SHINGLES, PIVOTS = 1024, 500_000, 8
CACHED, PIECE = 300_000, 16_384
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Text bytes -> the sorted distinct 64-bit hashes of its word shingles; bytes.lower and bytes.split touch ASCII alone."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        self.odd = np.random.default_rng(3).integers(1, 1 << 62, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHED:
            self.known = {}
        known, get = self.known, self.known.get
        hashes = np.empty(len(words), np.uint64)
        for n, w in enumerate(words):
            h = get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes[n] = h
        k = min(self.words, len(words))
        n = len(words) - k + 1
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total += scrambled(hashes[i : i + n] + np.uint64(i)) * self.odd[i]
        return np.unique(scrambled(total))


class MinMax:
    """Shingle hashes -> one hash per band."""

    def __init__(self, bands: int, rows: int):
        draw = np.random.default_rng(11)
        n = -(-bands * rows // 2)
        self.bands, self.rows = bands, rows
        self.mul = (draw.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.add = draw.integers(1, 1 << 62, n, dtype=np.uint64)[:, None]
        self.weight = draw.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = high = None
        for a in range(0, len(shingles), PIECE):
            seen = shingles[a : a + PIECE] * self.mul + self.add
            low = seen.min(axis=1) if low is None else np.minimum(low, seen.min(axis=1))
            high = seen.max(axis=1) if high is None else np.maximum(high, seen.max(axis=1))
        return np.concatenate([low, high])

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        values = scrambled(self.signature(shingles)[: self.bands * self.rows].reshape(self.bands, self.rows))
        return scrambled((values * self.weight).sum(axis=1, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, copy, n_shingles, print, bands), stored; copy tells rows with one id apart, print is a 128-bit hash of the set."""

    def run(batches):
        shingler, minmax = Shingler(words), MinMax(bands, rows)
        for b in batches:
            size, prints, marks = [], [], []
            for t in b.column(2).to_pylist():
                s = shingler(t)
                size.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                marks.append(minmax(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
                names=["doc", "copy", "n_shingles", "print", "bands"],
            )

    return store(
        docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("copy"), F.col(text).cast("binary").alias("text")).mapInArrow(
            run, "doc long, copy long, n_shingles long, print binary, bands array<long>"
        )
    )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.minimum(a.searchsorted(b), len(a) - 1)
    both = int((a[place] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(words: int, percent: int):
    """Blocks of a bucket -> links (u, v) confirmed on full sets that connect what was not connected."""

    def run(batches):
        shingler = Shingler(words)
        for key, rows in groups(batches, 4):
            rows = list({(r["doc"], r["copy"]): r for r in rows}.values())
            rows.sort(key=lambda r: r["side"])
            sets = [shingler(r["body"]) for r in rows]
            size = np.array([len(s) for s in sets])
            label = np.unique([r["comp"] for r in rows], return_inverse=True)[1]
            one = sum(r["side"] == 0 for r in rows)
            within = key[2] == key[3]
            u, v = [], []
            for x in range(one):
                start = x + 1 if within else one
                other = (label[start:] != label[x]) & (100 * np.minimum(size[start:], size[x]) >= percent * np.maximum(size[start:], size[x]))
                for y in np.flatnonzero(other) + start:
                    if label[y] != label[x] and similar(sets[x], sets[y], percent):
                        label[label == label[y]] = label[x]
                        u.append(rows[x]["doc"])
                        v.append(rows[y]["doc"])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def crowded(classes: DataFrame) -> DataFrame:
    """(doc, copy, n_shingles, t, h), stored: the bands that a class shares with another one, for all rounds.

    Only the keys of all bands are shuffled; where the shared ones are few, the bands stay where they are.
    """
    at = classes.select("doc", "copy", "n_shingles", F.posexplode("bands").alias("t", "h")).withColumn("k", F.xxhash64("t", "h"))
    shared, size = store_measured(at.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"))
    return store(at.join(F.broadcast(shared) if size <= spread.BROADCAST_BYTES else shared, "k").drop("k"))


def buckets(shared: DataFrame, comps: DataFrame, first: int, last: int) -> DataFrame:
    """Members (t, h, doc, copy, comp, members, load, light, light_load, main) of the buckets of some bands that hold several components.

    Buckets with the same members are taken once.  ``main``: the component with most members.
    """
    at = shared.filter((F.col("t") >= first) & (F.col("t") < last)).join(comps.withColumnRenamed("id", "doc"), "doc", "left")
    at = at.select("doc", "copy", F.coalesce("component", "doc").alias("comp"), "n_shingles", "t", "h")
    print_ = F.sum(F.xxhash64("doc", "copy").cast("decimal(38,0)"))
    per = at.groupBy("t", "h", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"), print_.alias("print"))
    full = per.groupBy("t", "h").agg(
        F.count("*").alias("comps"), F.sum("n").alias("members"), F.sum("load").alias("load"), F.sum("print").alias("print"),
        F.max_by(F.struct("comp", "n", "load"), F.struct("n", "comp")).alias("top"),
    ).filter("comps > 1")
    once = full.groupBy("members", "print").agg(F.min(F.struct("t", "h", "load", "top")).alias("b"))
    kept = once.select(
        "b.t", "b.h", "members", "b.load", F.col("b.top.comp").alias("main"),
        (F.col("members") - F.col("b.top.n")).alias("light"), (F.col("b.load") - F.col("b.top.load")).alias("light_load"),
    )
    return store(at.join(store(kept), ["t", "h"]))


def parts_of(count: Column, load: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK, load / BLOCK_SHINGLES, F.lit(1))).cast("int")


def dealt(column: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(31), column), parts).cast("int")


def in_parts(members: DataFrame) -> DataFrame:
    """First round: each bucket in parts, every part with the same few pivots; adds (i, j, side) with i = j."""
    parts = parts_of(F.col("members"), F.col("load"))
    pivot = F.pmod(F.xxhash64(F.lit(37), "doc"), F.greatest(F.floor(F.col("members") / PIVOTS), F.lit(1))) == 0
    place = F.when(pivot & (parts > 1), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(dealt(F.col("doc"), parts)))
    return members.withColumn("i", F.explode(place)).withColumn("j", F.col("i")).withColumn("side", F.lit(0))


def in_pairs(members: DataFrame) -> DataFrame:
    """Last round: members outside the main component against all members, in pairs of blocks; adds (i, j, side).

    Blocks of the main component are not paired with each other.
    """
    light_parts = F.when(F.col("light") > 0, parts_of(F.col("light"), F.col("light_load"))).otherwise(0)
    main_parts = parts_of(F.col("members") - F.col("light"), F.col("load") - F.col("light_load"))
    marked = members.withColumn("_pl", light_parts).withColumn("_pm", main_parts).withColumn("_main", F.col("comp") == F.col("main"))
    own = F.when(F.col("_main"), F.col("_pl") + dealt(F.col("doc"), F.col("_pm"))).otherwise(dealt(F.col("doc"), F.col("_pl")))
    others = F.sequence(F.lit(0), F.when(F.col("_main"), F.col("_pl")).otherwise(F.col("_pl") + F.col("_pm")) - 1)
    pair = lambda o: F.struct(F.least(F.col("_own"), o).alias("i"), F.greatest(F.col("_own"), o).alias("j"))
    out = marked.withColumn("_own", own).withColumn("_pair", F.explode(F.transform(others, pair)))
    return out.withColumn("i", F.col("_pair.i")).withColumn("j", F.col("_pair.j")).withColumn("side", (F.col("_own") != F.col("i")).cast("int"))


def near_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Words are what ASCII white space separates, with A-Z lower-cased; fewer than ``words`` of them are one
    shingle.  Documents link if the sets share at least ``percent`` percent of their union; those without words
    (null, empty) link with nothing.  Rows with one id are one node with the links of all.  A null id links with nothing
    and is kept, with a null component.  Only id and text are looked at.
    """
    ready(docs.sparkSession)
    marked = signatures(docs, words, bands, rows, doc_id, text)
    usable = marked.filter("n_shingles > 0 and doc is not null")
    classes = store(
        usable.groupBy("print", "n_shingles").agg(F.min(F.struct("doc", "copy")).alias("first"), F.any_value("bands").alias("bands"))
        .select("print", F.col("first.doc").alias("doc"), F.col("first.copy").alias("copy"), "n_shingles", "bands")
    )
    links = store(
        usable.select("doc", "print").distinct().join(classes.select("print", F.col("doc").alias("v")), "print").select(F.col("doc").alias("u"), "v").filter("u > v")
    )
    # Texts of all candidates, once: documents that share any band with another class.
    shared = crowded(classes)
    wanted = shared.select("doc", "copy").distinct()
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("copy"), F.col(text).cast("binary").alias("body"))
    bodies = store(lookup(bodies, wanted, ["doc", "copy"]))
    for place, first, last in ((in_parts, 0, min(FIRST_BANDS, bands)), (in_pairs, 0, bands)):
        members = buckets(shared, components(links), first, last)
        sent = place(members).select("t", "h", "i", "j", "side", "doc", "copy", "comp").join(bodies, ["doc", "copy"])
        sent = sent.select("t", "h", "i", "j", "side", "doc", "copy", "comp", "body").repartition("t", "h", "i", "j").sortWithinPartitions("t", "h", "i", "j")
        links = store(links.union(sent.mapInArrow(confirm(words, percent), "u long, v long")))
    out = marked.select(F.col("doc").alias("doc_id"), "n_shingles").join(components(links).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its group of near copies."""
    tag = "_"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    found = near_documents(docs, doc_id=doc_id, **options)
    gone = found.filter("not kept").select(F.col("doc_id").alias(f"{tag}id")).distinct()
    gone = gone.withColumn(f"{tag}gone", F.lit(True))
    rows = docs.withColumn(f"{tag}id", F.col(doc_id).cast("long"))
    return lookup(rows, gone, [f"{tag}id"], "left").filter(F.col(f"{tag}gone").isNull()).select(*docs.columns)
