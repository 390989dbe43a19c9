"""Chains of spans by lists of ancestors."""

import random

import pytest
from pyspark.sql import functions as F

from driftgrid.operators import traces
from test_tables import chain_sets, plain_chains


def forest(n, seed, loops):
    """Random parents among earlier spans, most of them near; with ``loops`` some parents come later."""
    pick = random.Random(seed)
    rows = [(i, None if i == 0 or pick.random() < 0.02 else max(i - pick.randint(1, 3), 0)) for i in range(n)]
    for _ in range(loops):
        i = pick.randrange(n)
        rows[i] = (i, pick.randrange(n))
    return rows


@pytest.mark.parametrize("listed, loops", [(4, 0), (4, 6), (256, 6)])
def test_lists_and_pairs_of_ancestors_agree(spark, monkeypatch, listed, loops):
    monkeypatch.setattr(traces, "LISTED", listed)
    rows = forest(60, listed + loops, loops)
    assert chain_sets(spark, rows) == plain_chains(rows)


def test_ancestor_lists_beyond_the_broadcast_limit(spark, no_broadcast):
    rows = forest(40, 7, 3)
    assert chain_sets(spark, rows) == plain_chains(rows)


def test_chains_of_spans_without_an_id(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1)], "span_id bigint, parent_span_id bigint")
    got = sorted((tuple(r) for r in traces.span_chains(df).collect()), key=str)
    assert got == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (None, None, 0)]


def test_rounds_of_chains_write_a_row_per_span(spark, monkeypatch):
    """A chain of 200 spans has 19,900 pairs; the rounds write lists, not pairs."""
    written = []
    keep = traces.store

    def counted(df):
        stored = keep(df)
        written.append(stored.count())
        return stored

    monkeypatch.setattr(traces, "store", counted)
    df = spark.range(200).select(F.col("id").alias("span_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_span_id"))
    assert traces.span_chains(df).count() == 200 + 19_900
    assert sum(written) <= 200 * 12


def test_rows_of_chains_move_a_row_per_span(spark, monkeypatch):
    written = []
    keep = traces.store

    def counted(df):
        stored = keep(df)
        written.append(stored.count())
        return stored

    monkeypatch.setattr(traces, "store", counted)
    df = spark.range(200).select(F.col("id").alias("span_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_span_id"), F.lit("a").alias("service"))
    df = df.unionByName(df.filter("span_id < 5")).unionByName(df.filter("span_id = 7").withColumn("service", F.lit("b")))
    got = traces.chain_rows(df, traces.span_chains(df)).collect()
    assert sorted((r["span_id"], r["service"]) for r in got) == sorted([(i, "a") for i in range(200)] + [(7, "b")])
    assert sum(written) <= 200 * 12
