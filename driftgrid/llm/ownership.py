"""Secret scan by corpus-wide ownership frequency.

Every text is scanned once for candidates.  Their hashes, never their values, are aggregated
over the corpus by distinct repositories and distinct owners: a value that many owners hold, or that
fills the repositories of its few owners, is an example that was copied around; one that few owners hold in few places
and that looks random is reported as live.  Spans of the three named kinds always stay; wide candidates are added where they are live.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import ready
from driftgrid.session import store
from driftgrid.spread import lookup

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "wide")
#: Words in a value that mark it as made up.
PLACEHOLDERS = ("example", "changeme", "placeholder", "sample", "dummy", "your", "xxxx", "1234567")
#: A value with this many owners or more is a copied example.
WIDE_OWNERS = 3
#: So is one that stands in more repositories than this per owner.
WIDE_REPOS = 20
#: A live value has at least so many different characters.
LIVE_CHARS = 8

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SCAN = "row long, doc_id long, spans array<struct<kind:int,start:int,stop:int,hash:string,live:boolean>>, repo string, owner string"


def looks_live(value: str) -> bool:
    low = value.lower()
    return len(set(value)) >= LIVE_CHARS and any(c.isdigit() for c in value) and not any(p in low for p in PLACEHOLDERS)


def scanner():
    """text -> spans (kind, start, stop, hash, looks live), leftmost and without overlaps per kind."""
    assign = re.compile(ASSIGN, re.I | re.A)
    access = re.compile("AKIA[A-Z0-9]+")
    hexes = re.compile("[0-9a-f]{24,}")  # a run is taken whole, so shorter runs need no match
    wide = re.compile("[A-Za-z0-9+/_-]{20,}")

    def scan(text: str) -> list[dict]:
        found = [(0, m.start(), m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(1, m.start(), m.end(), m[0]) for m in access.finditer(text) if len(m[0]) >= 20]
        found += [(2, m.start(), m.end(), m[0]) for m in hexes.finditer(text)]
        named = sorted((a, b) for _, a, b, _ in found)
        at, reach = 0, 0
        for m in wide.finditer(text):
            while at < len(named) and named[at][0] < m.end():
                reach = max(reach, named[at][1])
                at += 1
            v = m[0]
            if reach <= m.start() and re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v):
                found.append((3, m.start(), m.end(), v))
        found.sort(key=lambda x: (x[1], x[0]))
        return [
            {"kind": k, "start": a, "stop": b, "hash": hashlib.sha256(v.encode()).hexdigest(), "live": looks_live(v)}
            for k, a, b, v in found
        ]

    return scan


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per row of ``docs`` with its candidate spans; null texts have none.

    The result is stored: the row numbers must not change between its readers.
    """
    ready(docs.sparkSession)

    def run(batches):
        scan = scanner()
        for b in batches:
            spans = [scan(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(spans, SPANS), b.column(3), b.column(4)],
                names=["row", "doc_id", "spans", "repo", "owner"],
            )

    return store(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(text).alias("text"),
            F.col(repo).cast("string").alias("repo"),
            F.col(owner).cast("string").alias("owner"),
        ).mapInArrow(run, SCAN)
    )


SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())]))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: distinct owners and distinct repositories, counted in two narrowing steps.

    Where the owner is unknown (null), each repository counts as an owner; unknown repositories of an owner are one repository.
    """
    each = found.select(F.explode("spans.hash").alias("hash"), "owner", F.coalesce("repo", F.lit("")).alias("repo"))
    held = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("uses")).groupBy("hash", "owner")
    return held.agg(F.count("*").alias("repos"), F.sum("uses").alias("uses")).groupBy("hash").agg(
        F.sum(F.when(F.col("owner").isNull(), F.col("repos")).otherwise(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses")
    )


def classify(found: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """The candidates, one row each, with owners, repos and the verdict ``live`` or ``example``."""
    each = found.select("row", "doc_id", F.explode("spans").alias("s")).select("row", "doc_id", "s.*")
    known = lookup(each, ownership(found), "hash")
    live = F.col("live") & (F.col("owners") < wide_owners) & (F.col("repos") <= wide_repos * F.col("owners"))
    return known.withColumn("verdict", F.when(live, "live").otherwise("example"))


def scan_secrets(docs: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS, **columns: str) -> DataFrame:
    """Spans per document: (doc_id, spans array<struct<kind,start,stop,hash,owners,repos,verdict>>).

    One row per input row: repeated rows are reported as often as they stand there (their copies count as
    one repository), a null or empty text has no spans, a null id stays null, an empty table gives none.  Texts are scanned
    whole, however long.  Other columns are not looked at.
    """
    found = candidates(docs, **columns)
    fields = ("start", "kind", "stop", "hash", "owners", "repos", "verdict")
    judged = (
        classify(found.filter(F.size("spans") > 0), wide_owners, wide_repos)
        .filter((F.col("kind") < 3) | (F.col("verdict") == "live"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("spans"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,hash:string,owners:bigint,repos:bigint,verdict:string>>")
    some = found.filter(F.size("spans") > 0).select("row", "doc_id").join(judged, "row", "left")
    rest = found.filter(F.size("spans") == 0).select("doc_id", none.alias("spans"))
    return some.select("doc_id", F.coalesce("spans", none).alias("spans")).unionByName(rest)


def span_text(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
    )
