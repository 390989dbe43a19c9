"""Hard negatives, nearest neighbours and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.llm import anchor_negatives, logbilinear, prefix_forest, queries, rank_index_fim, vector_rows
from driftgrid.llm.common import remainder

SF_DIR = "/root/testdata/sf0.01"
SHAPE = "vec_id bigint, embedding array<double>, label int, row bigint, id bigint, vec string, _wave int, block int"
ODD = [(None, [1.0, 2.0], 1), (7, None, 1), (8, [1.0, None], 1), (9, [1.0, float("nan")], 1), (10, [float("inf"), 0.0], 1), (11, [1.0, 1.0], None), (12, [0.0, 0.0], 1), (13, [], 2)]


def vectors(spark, rows):
    """A table with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SHAPE)


def clustered(seed, n, d=12, centres=9, ids=None):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(centres, d))[draw.integers(0, centres, n)] + 0.3 * draw.normal(size=(n, d))
    return [(int(i), [float(v) for v in row], int(draw.integers(0, 4))) for i, row in zip(ids or range(n), x)]


def brute_negatives(rows, every):
    """Plain Python over all pairs, with integers of any length."""
    usable = [(i, [int(np.floor(256 * v)) for v in x], lab, n) for n, (i, x, lab) in enumerate(rows) if i is not None and lab is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for i, x, lab, n in usable:
        if i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), j, m, other) for j, y, other, m in usable if m != n and len(y) == len(x))
        for p, j, _, _ in [s for s in scores if s[3] == lab][:5]:
            inside = [(-s, k) for s, k, _, other in scores if other != lab and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, j, rank + 1, k, -p, s) for rank, (s, k) in enumerate(inside)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("wave_bytes", [None, 3000])
def test_negatives_against_brute_force(spark, monkeypatch, wave_bytes):
    monkeypatch.setattr(anchor_negatives, "GROUP", 8)
    monkeypatch.setattr(anchor_negatives, "ROWS", 64)
    rows = clustered(1, 400) + ODD
    rows += [rows[0], rows[5], (5, rows[6][1], 1), (1000, rows[5][1], 0), (1005, [3.0, 4.0], 1), (1006, [1.0, 4.0], 1), (1007, [1.0, 0.5], 2)]  # repeats, ties, another length
    got = rows_of(anchor_negatives.mine(vectors(spark, rows), F.col("id") % 5 == 0, wave_bytes=wave_bytes))
    assert got == brute_negatives(rows, 5) and len(got) > 1000


def test_negatives_of_huge_components(spark):
    rows = [(5 * i, [3e6 * (0.5 + 0.13 * i), -1e5 * i, 7.0], i % 2) for i in range(12)]
    got = rows_of(anchor_negatives.mine(vectors(spark, rows), F.col("id") % 10 == 0))
    assert got == brute_negatives(rows, 10) and max(r[4] for r in got) > 2**53
    beyond = [(5 * i, [1e15 * (i + 1), 1e300, -7.0], i % 2) for i in range(12)]  # scores are cut to a long: all equal, none in a window
    assert anchor_negatives.mine(vectors(spark, beyond), F.col("id") % 10 == 0).count() == 0
    assert anchor_negatives.products(np.array([[2.0**53, 1.0]]), np.array([2.0**53, 1.0]), False)[0] == 2**63 - 1
    odd = anchor_negatives.products(np.array([[2.0**31 + 1, 3.0]]), np.array([2.0**30 + 1, 5.0]), False)[0]
    assert odd == (2**31 + 1) * (2**30 + 1) + 15


def test_negatives_of_little(spark):
    assert anchor_negatives.mine(vectors(spark, []), F.col("id") % 5 == 0).count() == 0
    assert anchor_negatives.mine(vectors(spark, [(5, [1.0], 1)]), F.col("id") % 5 == 0).count() == 0


def test_tree_bounds_skip_candidates():
    """With near anchors most candidates are never scored, and the result stays that of scoring all."""
    import pyarrow as pa

    draw = np.random.default_rng(4)
    centre = draw.normal(size=16) * 50
    anchors = np.round(centre + draw.normal(size=(40, 16)) * 0.3)
    x = np.round(draw.normal(size=(3000, 16)) * 50)
    x[:60] = np.round(centre + draw.normal(size=(60, 16)) * 3)
    part = pa.table({"row": np.arange(40) + 10_000, "id": np.arange(40) + 10_000, "label": np.zeros(40, np.int64)})
    group = anchor_negatives.Group(part, anchors)
    assert sum(p < 0 for p in group.parent) == 1 and sorted(group.order) == list(range(40))
    kept = [anchor_negatives.Best(5) for _ in anchors]
    rows = pa.table({"row": np.arange(3000), "id": np.arange(3000), "label": np.zeros(3000, np.int64)})
    scored = anchor_negatives.sweep(group, kept, False, rows, x)
    scored = anchor_negatives.sweep(group, kept, False, rows, x[::-1].copy()) + scored
    for a, best in zip(anchors, kept):
        both = np.concatenate([x @ a, x[::-1] @ a])
        assert sorted(best.score.tolist()) == sorted(np.sort(both)[-5:].astype(int).tolist())
    assert scored < 0.6 * 2 * 3000 * 40


def recall_of(got, x, ids, k):
    """Share of the k nearest rows, by brute force, that were found."""
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = []
    for q, own in found.items():
        at = ids.index(q)
        scores = x @ x[at]
        near = [ids[j] for j in np.lexsort((ids, -scores)) if j != at][:k]
        hits.append(np.mean([j in own for j in near]))
        for j, s in own.items():
            assert s == pytest.approx(scores[ids.index(j)], rel=1e-12)
    return np.mean(hits)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_neighbours_recall_on_the_given_tables(spark, sf_dir):
    got = queries.op12_prefix_forest(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), [r["vec_id"] for r in rows]
    assert len(got) == 20 * sum(i % 20 == 0 for i in ids)
    assert recall_of(got, x, ids, 20) >= 0.9
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    for q, own in by_query.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r["vec_id"] for r in own}
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))


def test_neighbours_in_blocks_and_waves(spark):
    """Vectors of unequal length in many blocks, queries in many waves."""
    draw = np.random.default_rng(8)
    rows = [(i, [float(v * s) for v in x], lab) for (i, x, lab), s in zip(clustered(2, 3000), draw.uniform(0.2, 3, 3000))]
    forest = prefix_forest.build(vectors(spark, rows), block_rows=700)
    assert forest.blocks.count() == 5
    wanted = prefix_forest.wanted_candidates(forest, 10, least=50)
    assert 50 <= wanted < 700 * prefix_forest.TREES
    got = prefix_forest.search(forest, forest.rows.filter("id % 10 = 0"), 10, wanted, wave_bytes=8000).collect()
    assert recall_of(got, np.array([r[1] for r in rows]), [r[0] for r in rows], 10) >= 0.9 and len(got) == 3000


def test_neighbours_edges(spark):
    rows = ODD + [(20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (40, [2.0, 1.0], None), (41, [1.0, 2.0], 3), (60, [1.0, 2.0, 3.0], 1), (61, [3.0], 1)]
    got = rows_of(prefix_forest.nearest(vectors(spark, rows), k=3))
    assert got == sorted([
        *[(20, 1, 20, 5.0), (20, 2, 41, 5.0), (20, 3, 40, 4.0)] * 2,  # the copy, then ties by id; a label is not looked at
        (40, 1, 20, 4.0), (40, 2, 20, 4.0), (40, 3, 41, 4.0),
    ])
    assert prefix_forest.nearest(vectors(spark, [])).count() == 0
    assert prefix_forest.nearest(vectors(spark, [(20, [1.0], 1)])).count() == 0


def test_many_copies_come_by_id(spark):
    rows = [(i, [1.0, 0.5, -0.25], 1) for i in range(3000, 0, -1)]
    got = prefix_forest.nearest(vectors(spark, rows), every=1500, k=4).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, n + 1, n + 1) for q in (1500, 3000) for n in range(4)}


def test_descent_and_ascent_against_plain_prefixes():
    draw = np.random.default_rng(3)
    own = draw.integers(0, 2**32, (5, 200), dtype=np.uint32)
    own[:, :50] = own[:, :1]
    order = np.argsort(own, axis=1).astype(np.uint32)
    record = {"ids": np.arange(200).tobytes(), "rows": np.arange(200).tobytes(), "size": 1, "vecs": np.ones(200).tobytes(),
              "keys": np.take_along_axis(own, order.astype(np.int64), 1).tobytes(), "order": order.tobytes()}
    block = prefix_forest.Block(record)
    asked = np.concatenate([own[:, :3].T, draw.integers(0, 2**32, (20, 5), dtype=np.uint32)])
    text = lambda v: f"{int(v):032b}"
    shared = np.array([[[len(re.match(r"0*", text(a ^ b)).group()) for b in own[t]] for t, a in enumerate(q)] for q in asked])
    assert (block.matches(asked) == shared.max(axis=(1, 2))).all()
    first, last = block.climb(asked, 60)
    for q in range(len(asked)):
        level = max(n for n in range(33) if (shared[q] >= n).sum() >= 60)
        for t in range(5):
            assert sorted(block.order[t, first[q, t] : last[q, t]].tolist()) == np.flatnonzero(shared[q, t] >= level).tolist()


TEXTS = ["", " ", "a", "Zebra", "ab cd\n\nef", "naïve Größe 12 абв x", "x<P>y", "<S", "a" * 5000, "\U0001f600 smile \U0001f600", "word " * 3000 + "z" * 900 + " 12345" * 2000]


@pytest.mark.parametrize("bound", [0, 1, 127])
def test_rank_index_is_exact(bound):
    for text in TEXTS:
        want = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text, re.S)] + [len(text)]
        offsets = rank_index_fim.boundaries(text)
        assert offsets.tolist() == want
        index = rank_index_fim.RankIndex.fit(offsets, bound)
        assert [index[r] for r in range(len(want))] == want
        assert max(abs(index.predict(r) - v) for r, v in enumerate(want)) <= bound
        assert index.firsts[0] == 0 and (np.diff(index.firsts) > 0).all()
    long = rank_index_fim.boundaries(TEXTS[-1])
    assert len(rank_index_fim.RankIndex.fit(long, 127).firsts) < len(long) / 100


def test_fill_in_middle_against_brute_force(documents):
    rows = [(i, t, "en", "a") for n, t in enumerate(TEXTS) for i in range(30 * n, 30 * n + 30)] + [(None, "some text here", None, None), (5, None, None, None), (5, None, None, None)]
    made = rank_index_fim.fill_in_middle(documents(rows))
    got = sorted(map(tuple, made.withColumn("again", rank_index_fim.restored(F.col("output"), F.col("form"))).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        text = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
        h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
            want.append((doc_id, len(units), "plain", None, None, text, text))
        else:
            form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
            want.append((doc_id, len(units), form, len(p), len(m), out, text))
    assert got == sorted(want, key=repr) and {w[2] for w in want} == {"plain", "psm", "spm"}
    assert rank_index_fim.fill_in_middle(documents([])).count() == 0


def test_stored_index_gives_the_cuts(documents):
    rows = [(n, t, "en", "a") for n, t in enumerate(TEXTS)] + [(None, None, None, None)]
    for r in rank_index_fim.index(documents(rows), bound=5).collect():
        text = "" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        index = rank_index_fim.RankIndex(*(np.array(r[c]) for c in ("firsts", "bases", "rises", "runs")), np.frombuffer(r["residuals"], np.int8))
        assert [index[k] for k in range(r["n"] + 1)] == rank_index_fim.boundaries(text).tolist()


def test_waves_hold_every_row_once(spark):
    rows = vector_rows.numbered(vectors(spark, clustered(6, 500) + ODD), "vec_id", "embedding")
    parts = [w["row"].to_pylist() for w in vector_rows.waves(rows, 6000)]
    assert len(parts) > 5 and sorted(r for p in parts for r in p) == sorted(r["row"] for r in rows.select("row").collect())
    assert [len(w) for w in vector_rows.waves(rows)] == [rows.count()]


def test_language_model_is_better_than_counts_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = logbilinear.score(docs.filter(held_out), logbilinear.fit(docs.filter(~held_out)))
    neural, counts = scored.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert neural > counts
