"""Spans: metrics beside them, features, parent chains."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid import spread
from driftgrid.session import store
from driftgrid.spread import salted_join, store_measured

#: Ancestors that are kept in one list; chains beyond that are followed pair by pair.
LISTED = 256


def join_telemetry(spans: DataFrame, metrics: DataFrame, on: str = "ts") -> DataFrame:
    """Left join of spans to the metrics of the same time; clashing names get ``_x`` and ``_y``."""
    clash = [c for c in spans.columns if c in metrics.columns and c != on]
    left = spans.withColumnsRenamed({c: f"{c}_x" for c in clash})
    right = metrics.withColumnsRenamed({c: f"{c}_y" for c in clash})
    return salted_join(left, right, [on], "left")


def span_features(df: DataFrame, duration: str = "duration", value: str = "value") -> DataFrame:
    """Add the two detector features."""
    return df.withColumns({"span_duration": F.col(duration), "metric_value": F.col(value)})


def span_edges(spans: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(span_id, parent_span_id), one row per span; of several rows the first by ``order`` counts.

    Only parents that are spans themselves make an edge.
    """
    rank = F.struct(*(order or ["parent_span_id"]))
    one = spans.groupBy("span_id").agg(F.min_by("parent_span_id", rank).alias("parent_span_id"))
    one = store(one)
    known = one.select(F.col("span_id").alias("parent_span_id"))
    children = one.filter(F.col("parent_span_id").isNotNull())
    return salted_join(children, known, ["parent_span_id"], "left_semi", at_most=one.count()).select(
        "span_id", "parent_span_id"
    )


def span_chains(
    spans: DataFrame,
    max_depth: int | None = None,
    order: Sequence[str] = (),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Every span with all its ancestors: (span_id, ancestor_id, depth), depth 0 being the span itself.

    A span carries the list of its next ancestors and appends the list of the last of them, so the known reach
    doubles each round; a span whose list has met a root is not moved again.  Chains of more than ``LISTED``
    hops go on pair by pair, twenty rounds for a million hops.  A chain that comes back to a span it has visited
    ends there.  Each round is written to the shared folder; a popular ancestor is spread over several tasks.
    """
    edges = span_edges(spans, order).filter("span_id is not null")
    start = edges.select("span_id", F.array("parent_span_id").alias("path"), F.col("parent_span_id").alias("up"), F.lit(False).alias("looped"))
    lists = store(without_loops(start))
    ended, going, reach = [lists.filter("up is null")], lists.filter("up is not null"), 1
    while reach < LISTED and (max_depth is None or reach < max_depth):
        waiting, ups = going.agg(F.count("*"), F.approx_count_distinct("up")).first()
        if not waiting:
            break
        lists = store(without_loops(lengthened(going, reduce(DataFrame.unionByName, ended, going), reach, waiting, ups, rows_per_task)))
        ended, going, reach = [*ended, lists.filter("up is null")], lists.filter("up is not null"), 2 * reach
    short = reduce(DataFrame.unionByName, ended)
    known = list_pairs(short).unionByName(deep_pairs(going, short, reach, max_depth, rows_per_task))
    if max_depth is not None:
        known = known.filter(F.col("depth") <= max_depth)
    own = spans.select("span_id").distinct().select(
        "span_id", F.col("span_id").alias("ancestor_id"), F.lit(0).alias("depth")
    )
    return own.unionByName(known)


def without_loops(lists: DataFrame) -> DataFrame:
    """(span_id, path, up, looped): a list that comes back to a span it has visited ends there; ``looped`` marks it."""
    once = F.array_except("path", F.array("span_id"))  # the others in the order in which they come first
    again = F.col("up").isNotNull() & (F.size(once) < F.size("path"))
    return lists.select(
        "span_id",
        F.when(F.col("up").isNotNull() | F.col("looped"), once).otherwise(F.col("path")).alias("path"),
        F.when(~F.col("looped") & ~again, F.col("up")).alias("up"),
        (F.col("looped") | again).alias("looped"),
    )


def lengthened(going: DataFrame, lists: DataFrame, reach: int, waiting: int, ups: int, rows_per_task: int | None) -> DataFrame:
    """Append to each of the ``waiting`` lists that of its last ancestor; there are about ``ups`` such ancestors.

    If they are few, only their lists are kept, and broadcast if their measured size allows.
    """
    ahead, size = lists, None
    if 8 * ups <= spread.BROADCAST_BYTES:
        wanted, size = store_measured(going.select(F.col("up").alias("span_id")).distinct())
        wanted = F.broadcast(wanted) if size <= spread.BROADCAST_BYTES else wanted
        ahead, size = store_measured(lists.join(wanted, "span_id", "left_semi"))
    ahead = ahead.select(F.col("span_id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"), F.col("looped").alias("_looped"))
    if size is not None and size <= spread.BROADCAST_BYTES:
        both = going.join(F.broadcast(ahead), ["up"], "left")
    else:
        share = max((rows_per_task or spread.ROWS_PER_TASK) // reach, 1)
        both = salted_join(going, ahead, ["up"], "left", rows_per_task=share, at_most=waiting)
    return both.select(
        "span_id",
        F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path"),
        F.col("_up").alias("up"),
        F.coalesce("_looped", F.lit(False)).alias("looped"),
    )


def list_pairs(lists: DataFrame) -> DataFrame:
    """(span_id, ancestor_id, depth), one row per list entry."""
    return lists.select("span_id", F.posexplode("path").alias("_at", "ancestor_id")).select(
        "span_id", "ancestor_id", (F.col("_at") + 1).alias("depth")
    )


def deep_pairs(going: DataFrame, short: DataFrame, reach: int, max_depth: int | None, rows_per_task: int | None) -> DataFrame:
    """(span_id, ancestor_id, depth) of the spans whose chain goes on beyond ``reach``; ``short`` has the lists of all others."""
    known = list_pairs(going)
    jump = going.select("span_id", F.col("up").alias("mid"))
    spans_left = going.count()
    if not spans_left or (max_depth is not None and reach >= max_depth):
        return known
    known = store(known)
    rows = known.count()
    while max_depth is None or reach < max_depth:
        mids = jump.select(F.col("mid").alias("span_id")).distinct()
        ahead = known.unionByName(list_pairs(short.join(mids, "span_id", "left_semi")))
        ahead = ahead.select(F.col("span_id").alias("mid"), "ancestor_id", F.col("depth").alias("_more"))
        share = max((rows_per_task or spread.ROWS_PER_TASK) // reach, 1)
        further = salted_join(jump, ahead, ["mid"], rows_per_task=share, at_most=spans_left).select(
            "span_id", "ancestor_id", (F.col("_more") + reach).alias("depth")
        )
        merged = store(
            known.unionByName(further)
            .filter("span_id <> ancestor_id")
            .groupBy("span_id", "ancestor_id")
            .agg(F.min("depth").alias("depth"))
        )
        total = merged.count()
        known = merged
        if total == rows:
            break
        rows = total
        hops = jump.select(F.col("span_id").alias("mid"), F.col("mid").alias("_next"))
        jump = store(
            salted_join(jump, hops, ["mid"], at_most=spans_left).select("span_id", F.col("_next").alias("mid"))
        )
        reach *= 2
    return known


def span_roots(spans: DataFrame, order: Sequence[str] = (), rows_per_task: int | None = None) -> DataFrame:
    """(span_id, root_id, depth), one row per span: the last ancestor of each span and the hops to it.

    Every span points to its parent; each round it points to where its pointer pointed to, so hops double and a
    chain of a million spans takes twenty rounds, of as many rows as there are spans.  A span that has arrived at a root
    is not moved again; a root that many spans wait for is spread over several tasks.  Chains that run into a cycle have
    no root: root and depth are null.
    """
    edges = span_edges(spans, order)
    ids = spans.select("span_id").filter("span_id is not null").distinct()
    count_ = ids.count()
    start = ids.join(edges, "span_id", "left").select(
        "span_id", F.coalesce("parent_span_id", "span_id").alias("at"), F.col("parent_span_id").isNotNull().cast("long").alias("depth"),
        F.col("parent_span_id").isNull().alias("done"),
    )
    known, hops = store(start), 1
    while hops < 2 * count_:
        waiting = known.filter("not done")
        if not waiting.limit(1).count():
            break
        ahead = known.select(F.col("span_id").alias("at"), F.col("at").alias("_next"), F.col("depth").alias("_more"), F.col("done").alias("_done"))
        moved = salted_join(waiting.drop("done"), ahead, ["at"], rows_per_task=rows_per_task, at_most=count_).select(
            "span_id", F.col("_next").alias("at"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_done").alias("done")
        )
        known, hops = store(moved.union(known.filter("done"))), 2 * hops
    return known.select("span_id", F.when(F.col("done"), F.col("at")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def chain_rows(spans: DataFrame, chains: DataFrame) -> DataFrame:
    """The span rows the chains run through, without duplicates."""
    used = chains.select(F.col("ancestor_id").alias("span_id")).distinct()
    return salted_join(spans, used, ["span_id"], "left_semi").dropDuplicates()
