"""Edge cases and brute-force comparisons of the text operators on small tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from driftgrid.llm import backoff_langid, block_mix, chunk_bpe, line_runs, logbilinear, minmax_hash, ownership, pu_toxicity, queries, risk_rules, sign_hash

EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (None, "the cat sat on the mat", "en", "a"),
    (4, "the cat sat on the mat", "en", "a"), (4, "the cat sat on the mat", "en", "a"), (5, "12 34", "en", "b"),
]


def words_text(seed, n, words=("der", "hund", "und", "die", "katze", "im", "haus", "am", "see")):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


def test_secrets(documents):
    wide = "Zq8/Lm3+Pw9xTt5Kc2Vb"
    rows = [*EDGES, (10, f'x password="hunter22" AKIA{"A1" * 8} {"ab" * 12} {wide}', "en", "a")]
    rows += [(20 + i, f"copied {wide[::-1]} here", "en", f"s{i}") for i in range(4)]
    got = {r["doc_id"]: r for r in ownership.digest(ownership.scan_secrets(documents(rows))).collect()}
    r = got[10]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    base = "assign:2:20,access:22:42,hex:43:67"
    assert r["spans"] == f"{base},wide:68:88" and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert all(got[20 + i]["spans"] == "" for i in range(4))  # four owners: a copied example
    assert got[1]["spans"] == got[2]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert ownership.scan_secrets(documents([])).count() == 0


def test_secrets_by_repositories(documents):
    """Repositories decide too: many of one owner, or many without an owner, hold an example; a few do not."""
    wide = ["Zq8/Lm3+Pw9xTt5Kc2Vb", "Yp7/Kn2+Ov8wSs4Jb1Ua", "Xo6/Jm1+Nu7vRr3Ia9Tz", "Wn5/Il9+Mt6uQq2Hz8Sy"]
    rows = [(100 + i, f"x {wide[0]} y", "en", "one") for i in range(200)]
    rows += [(400 + i, f"x {wide[1]} y", "en", None) for i in range(200)]
    rows += [(700 + i, f"x {wide[2]} y", "en", "two") for i in range(ownership.WIDE_REPOS)]
    rows += [(800 + i, f"x {wide[3]} y", "en", None) for i in range(2)] + [(900, "a1 " * 100_000 + wide[3][::-1], "en", "long")]
    got = {r["doc_id"]: r for r in ownership.digest(ownership.scan_secrets(documents(rows))).collect()}
    assert not any(got[i]["n_live"] for i, *_ in rows[:400])
    assert all(got[i]["n_live"] == 1 for i, *_ in rows[400:])
    assert got[900]["spans"] == "wide:300000:300020"


def test_language(documents):
    rows = [*EDGES, *((100 + i, words_text(i, 40), "de", "a") for i in range(5)), *((200 + i, "el gato y el perro en la casa verde", "es", "a") for i in range(5))]
    docs = documents(rows)
    model = backoff_langid.fit(docs.filter("doc_id >= 100 or doc_id is null"))
    got = {r["doc_id"]: r for r in backoff_langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 5)] == ["und"] * 4 and got[1]["score"] == 0.0
    assert got[100]["lang_pred"] == "de" and got[200]["lang_pred"] == "es" and got[4]["lang_pred"] == "en"
    score = backoff_langid.scorer(model)
    assert score("katzenhund")[0] == "de"  # unseen: by its n-grams
    kept = backoff_langid.accept(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1, 2, 3, 5)").count() == 0
    nothing = backoff_langid.fit(documents([]))
    assert {r["lang_pred"] for r in backoff_langid.identify(docs, nothing).collect()} == {"und"}


def test_language_against_brute_force(documents):
    rows = [(i, words_text(i, 30), "de", "a") for i in range(6)] + [(50 + i, words_text(i, 30, ("el", "gato", "hund", "casa")), "es", "a") for i in range(6)]
    model = backoff_langid.fit(documents(rows))
    score, text = backoff_langid.scorer(model), "hund gatohaus xyz casa"
    total = np.zeros(2)
    for w in re.findall(r"[^\W\d_]+", text):
        if w in model["tables"][0]:
            total += model["tables"][0][w]
            continue
        for step, n in enumerate(backoff_langid.ORDERS):
            known = [model["tables"][n][g] for g in backoff_langid.grams(w, n) if g in model["tables"][n]]
            if known:
                total += np.mean(known, axis=0) + backoff_langid.STEP * (step + 1)
                break
    best = int(total.argmax())
    lang, share = score(text)
    assert lang == model["langs"][best] and share == pytest.approx(1 / np.exp(total - total[best]).sum(), rel=1e-4)


def test_toxicity(spark, documents):
    rows = [*EDGES] + [(100 + i, words_text(i, 30) + (" schuft" if i % 3 == 0 else ""), "de", "a") for i in range(300)]
    marks = [(100 + i, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(None, 1), (101, None), (100, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    docs = documents(rows)
    model = pu_toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in pu_toxicity.score(docs, model).collect()}
    toxic, clean = [got[100 + i] for i in range(0, 300, 3)], [got[100 + i] for i in range(300) if i % 3]
    assert min(toxic) > max(clean) and 0 <= got[1] == got[2] < 0.5
    none = pu_toxicity.fit(docs, labels.filter("toxic = 0"))
    assert pu_toxicity.score(docs, none).filter("score >= 0.5").count() == 0
    assert pu_toxicity.score(documents([]), model).count() == 0


def test_pu_risk_goes_against_a_negative_part():
    up, by_p, by_u = pu_toxicity.risk_gradient(np.array([5.0, 6.0]), np.array([-5.0, -6.0]), 0.4)
    assert up > 0 and (by_u < 0).all() and (by_p > 0).all()
    _, by_p, by_u = pu_toxicity.risk_gradient(np.array([-1.0]), np.array([1.0]), 0.1)
    assert (by_u > 0).all()


def test_language_model(documents):
    rows = [*EDGES] + [(100 + i, words_text(i, 50), "de", "a") for i in range(40)]
    docs = documents(rows)
    model = logbilinear.fit(docs.filter("doc_id >= 100"), classes=5)
    first, second, normal = model.tables
    total = np.exp(first[:, None, :] + second[None, :, :] - normal[:, :, None]).sum(axis=2)
    np.testing.assert_allclose(total, 1.0, rtol=1e-4)
    counts = {}
    for i in range(40):
        for w in [*words_text(i, 50).split(), ""]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.types) == (n, v)
    got = {r["doc_id"]: r for r in logbilinear.score(docs, model).collect()}
    for doc_id, text in ((100, words_text(0, 50)), (1, ""), (4, "the cat sat on the mat")):
        tokens = [*text.split(), ""]
        want = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens)
        assert got[doc_id]["base_score"] == pytest.approx(want) and got[doc_id]["n_tokens"] == len(tokens)
        assert got[doc_id]["n_known"] == sum(w in counts for w in tokens) and got[doc_id]["score"] < 0
    nothing = logbilinear.fit(documents([]))
    assert nothing.tokens == 0 and logbilinear.score(docs, nothing).count() == len(rows)


def test_language_model_gives_every_word_a_probability(documents):
    """The whole vocabulary and one unseen word per cluster sum to 1 after any word."""
    pairs = [("roter", "apfel"), ("gelbe", "birne"), ("blaue", "welle"), ("alter", "nagel")]
    rows = [(i, " ".join(w for n in range(3) for w in pairs[(i + n) % 4]) + f" x{i}", "de", "a") for i in range(200)]
    for share in (logbilinear.HEAD_SHARE, 0.04):  # counts sent to the tasks, and met in the join
        model = logbilinear.fit(documents(rows), classes=6, head_share=share)
        words = {r["token"]: r["uses"] for r in model.counts.collect()}
        named = [w.decode() for w in words if w]
        found = {logbilinear.cluster(w) for w in words if w not in model.classes}
        unseen = {}
        for n in range(100_000):
            if f"{n:05}".encode() not in words:
                unseen.setdefault(logbilinear.cluster(f"{n:05}".encode()), f"{n:05}")
        assert len(unseen) == logbilinear.CLUSTERS and found
        for before in ("roter", "x7", "nagel"):
            # score(before w) - score(before) with the ends taken off by the tables
            tries = ["", *named, *unseen.values()]
            got = {r["doc_id"]: r["score"] for r in logbilinear.score(documents([(n, f"{before} {w}", "de", "a") for n, w in enumerate(tries)]), model).collect()}
            alone = got[0]
            first, second, normal = model.tables
            places = logbilinear.Places({w: n + logbilinear.CLUSTERS for n, w in enumerate(model.classes)})
            i, end = places[before.encode()], places[b""]
            assert end >= logbilinear.CLUSTERS

            def last(i, j):
                return first[i, end] + second[j, end] - normal[i, j]

            start = first.shape[0] - 1
            common = alone * np.log(10) - last(start, i)  # log P(before)
            total = np.exp(last(start, i)) + sum(np.exp(got[n] * np.log(10) - common - last(i, places[w.encode()])) for n, w in enumerate(tries) if w)
            assert total == pytest.approx(1, abs=2e-3)


def test_mix(documents):
    rows = [*EDGES] + [(100 + i, words_text(i, 10 + 7 * i), "de", "abc"[i % 3]) for i in range(60)]
    docs = documents(rows)
    got = block_mix.mix(docs, block=16).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    merged = got.merge(docs.toPandas()[["doc_id", "source"]].drop_duplicates(), on="doc_id")
    sums = merged.drop_duplicates(["doc_id", "size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums["taken"] - sums["target"]).abs() < 40).all()
    again = block_mix.mix(docs.repartition(5), block=16).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    assert block_mix.mix(documents([])).count() == 0
    mixed = block_mix.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    words = mixed.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()
    per = got.groupby("doc_id")["taken"].sum()
    assert {r.doc_id: r.n for r in words.itertuples() if r.doc_id == r.doc_id} == {k: v for k, v in per.items() if v > 0}


def test_mix_follows_shard_counts(documents):
    docs = documents([*EDGES] + [(100 + i, words_text(i, 10 + 7 * i), "de", "abc"[i % 3]) for i in range(60)])
    sources = block_mix.targets(block_mix.measured(docs), block=16)
    counts = block_mix.shard_counts(sources, shard=50)
    dealt = block_mix.packed(docs, block=16, shard=50).toPandas()
    total = sources.toPandas().set_index("rank")["slots"]
    assert sorted(dealt["slot"]) == list(range(total.sum())) and (dealt["slot"] // 50 == dealt["shard"]).all()
    drawn = {(r["shard"], r["rank"]): r["count"] for r in counts.collect()}
    assert dealt.groupby(["shard", "rank"]).size().to_dict() == drawn and len({s for s, _ in drawn}) == -(-total.sum() // 50)
    assert dealt.groupby("rank").size().to_dict() == total[total > 0].to_dict()
    # The take follows the counts: a shard takes each source where the one before left off.
    by_k = dealt.sort_values(["rank", "pass", "shard"])
    assert all((g["shard"].diff().dropna() >= 0).all() for _, g in by_k.groupby("rank"))
    taken = block_mix.mix(docs, block=16).toPandas()["taken"].sum()
    assert dealt["words"].sum() == taken


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", block_mix.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
    back = rows.select("id", "p", block_mix.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(5).cast("long"), inverse=True).alias("q")).collect()
    assert sorted(r["p"] for r in back) == list(range(n)) and all(r["q"] == r["id"] for r in back)


def test_lines(documents):
    long = "A line of more than ten"
    rows = [*EDGES, (10, f"{long}\nfirst own line\n{long}", "en", "a"), (11, f"x\n  {long.upper()}\t\nshort", "en", "a"), (None, f"{long}\nend of all lines", "en", "a")]
    rows += [(20 + i, f"{long}\nline number {i} of its own", "en", "a") for i in range(12)]
    docs = documents(rows)
    out = line_runs.dedup_lines(docs, counts=("n_lines", "n_dropped"))
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = {(r["doc_id"], r["n_lines"]): r for r in out.collect()}
    assert got[10, 3]["text"] == rows[len(EDGES)][1] and got[10, 3]["n_dropped"] == 0
    assert got[11, 3]["text"] == "x\nshort" and got[11, 3]["n_dropped"] == 1
    assert got[None, 2]["text"] == "end of all lines"
    assert all(got[20 + i, 2]["text"] == f"line number {i} of its own" for i in range(12))
    assert got[1, 1]["text"] == "" and got[2, 1]["n_dropped"] == 0
    assert line_runs.dedup_lines(documents([])).count() == 0


def test_vectors(spark):
    draw = np.random.default_rng(0)
    base = draw.normal(size=(30, 16))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[0] + draw.normal(size=16) * 0.02 * (i % 5)], 0) for i in range(40)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, [float(x) for x in base[0]], None), (205, [float(x) for x in base[0]][:8], 0), (None, [1.0] * 16, 0), (7, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = sign_hash.near_vectors(df, block=8).collect()
    assert len(got) == len(rows)
    good = {i: (np.array(v, np.float32).astype(float), y) for i, v, y in rows if i is not None and i not in range(200, 205) and len(v or []) in (8, 16)}
    near = lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] / np.linalg.norm(a[0]) / np.linalg.norm(b[0]) >= 0.98
    links = {i: {j for j in good if j != i and near(good[i], good[j])} for i in good}
    for r in got:
        i = r["vec_id"]
        assert r["n_links"] == len(links.get(i, ()))
        if i is not None:
            seen, todo = {i}, [i]
            while todo:
                todo += [j for j in links.get(todo.pop(), ()) if j not in seen and not seen.add(j)]
            assert r["component_id"] == min(seen) and r["kept"] == (i == min(seen))
    assert sign_hash.near_vectors(df.limit(0)).count() == 0


def test_near_documents(documents, monkeypatch):
    monkeypatch.setattr(minmax_hash, "BLOCK", 6)
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = {}
    for g in range(6):
        base = [word() for _ in range(60)]
        for c in range(12):
            words = list(base)
            for _ in range(c % 4):
                words[draw.randrange(60)] = word()
            texts[100 * g + c + 10] = " ".join(words)
    rows = [*EDGES, *((i, t, "en", "a") for i, t in texts.items()), (9, "a b", "en", "a"), (8, "A\tB", "en", "a")]
    docs = documents(rows)
    got = minmax_hash.near_documents(docs, words=4).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        if w and i is not None:
            sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or {tuple(w)}
    links = {i: {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    for r in got:
        i = r["doc_id"]
        if i is None:
            assert r["kept"] and r["component_id"] is None
            continue
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links.get(todo.pop(), ()) if j not in seen and not seen.add(j)]
        assert r["component_id"] == min(seen) and r["n_shingles"] == len(sets.get(i, ())) and r["kept"] == (i == min(seen))
    kept = minmax_hash.keep_one(docs, words=4)
    assert kept.columns == docs.columns and minmax_hash.near_documents(documents([])).count() == 0


def test_bpe(documents):
    ranks = chunk_bpe.read_ranks(queries.RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = "It's  a test  of\x1cẃords \U0001f600​\n\n  12345 !!?\r\n\tña <|endoftext|> don'T " + "ab" * 300
    rows = [*EDGES, (10, odd, "en", "a"), (11, odd * 3 + words_text(1, 400), "en", "a"), (12, "z" * 900 + " " * 500 + "end", "en", "a"), (13, words_text(3, 500) + "'re", "en", "a")]
    docs = documents(rows)
    texts = {(i, t) for i, t, *_ in rows}
    for chunk, overlap in ((32_768, 1_024), (200, 60)):
        ids = chunk_bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap, decoded=True)
        decode = chunk_bpe.decoder(docs.sparkSession, ranks)
        got = ids.select("doc_id", "ids", "decoded", decode("ids").alias("back")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["decoded"] == r["back"]
            back = bytes(r["back"]).decode()
            assert any(i == r["doc_id"] and (t or "") == back for i, t in texts)
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == lib.encode_ordinary(back)
    assert chunk_bpe.encode(documents([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_rules(spark, documents):
    good = [(1000 + i, words_text(i, 60) + "\nown line", "de", "a") for i in range(30)]
    rows = [*EDGES, *good, (10, " ".join(f"w{i}" for i in range(60)) + "\nsame\nsame", "en", "a"), (11, "a b c " * 30, "en", "a")]
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(30)] + [(None, 1), (10, None)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in risk_rules.judge(documents(rows), labels).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[10]["n_dup_lines"] == 1 and got[10]["kept"] and got[11]["n_repeat_words"] == 90 and got[11]["base_failed"]
    assert not any(got[1000]["failed_rules"])  # too few labels for any cutoff
    for i in (1000, 1001):
        w = good[i - 1000][1].split()
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        cover = {k + o for k, t in enumerate(three) if three.count(t) > 1 for o in range(3)}
        assert got[i]["n_repeat_words"] == len(cover)
    assert risk_rules.judge(documents([]), labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10, 0.1), (1, 50, 0.1), (5, 100, 0.1), (3, 900, 0.01), (11, 100, 0.1)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k bigint, n bigint")
    for k, n, rate in cases:
        got = df.filter(f"k = {k} and n = {n}").select(risk_rules.tail(F.col("k"), F.col("n"), rate).alias("p")).first()["p"]
        want = sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)) if k <= rate * n else 1.0
        assert got == pytest.approx(want)


def test_labels_let_rules_reject(spark, documents):
    clean = [(i, words_text(i, 80), "de", "a") for i in range(3000)]
    junk = [(9000 + i, words_text(i, 80) + " # # # # # # # # # # # # # # # # # # # # # #", "de", "a") for i in range(5)]
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id bigint, quality int")
    got = risk_rules.judge(documents(clean + junk), labels)
    # words_text repeats few words, so the base rule is left out here
    assert got.filter("doc_id >= 9000 and instr(failed_rules, 'symbols') = 0").count() == 0
    assert got.filter("doc_id < 9000 and failed_rules <> ''").count() == 0


def test_rules_keep_their_promise(spark):
    """Over 200 strata, each tested at the level of 5 %, few take a cutoff whose true false rejection is above the limit."""
    strata, n = 200, 600
    # P(repeats > c) = rate (1 - c): in even strata 0.02 at c = 0.2, above the limit below it.
    rate = F.when(F.col("id") % 2 == 0, 0.025).otherwise(0.001)
    value = F.when(F.rand(7) < rate, F.floor(F.rand(8) * 1000)).otherwise(0)
    rows = spark.range(strata * n).select(
        F.col("id").alias("doc_id"), (F.col("id") % strata).cast("string").alias("stratum"), F.lit(1000).alias("n_words"), value.alias("n_repeat_words"),
        F.lit(10).alias("n_lines"), F.lit(0).alias("n_dup_lines"), F.lit(5000).alias("word_chars"), F.lit(0).alias("n_symbols"),
    )
    found = corpus_pipeline.store(rows)
    cuts = risk_rules.thresholds(found, found.select("doc_id", F.lit(1).alias("quality")), doubt=0.05 * strata).toPandas()
    assert len(cuts) == strata and 0.7 * n < cuts["good"].min() and cuts["good"].max() < 0.8 * n
    odd = cuts["stratum"].astype(int) % 2 == 1
    assert (cuts[~odd]["cut_repeats"] < 0.2).sum() <= 0.1 * (~odd).sum() and cuts[odd]["cut_repeats"].notna().mean() > 0.9


def test_rules_act_from_two_hundred_labels(spark, documents):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    good = [(1000 + i, words(i), "de", "a") for i in range(260)]
    rows = [*EDGES, *good, (10, words(1) + "\nsame" * 40, "de", "a"), (11, words(2) + "\nsame" * 40, "fr", "a"), (12, words(3) + " #" * 100_000, "de", "a")]
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(260)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in risk_rules.judge(documents(rows), labels).collect()}
    assert "dup_lines" in got[10]["failed_rules"] and "symbols" in got[12]["failed_rules"] and not got[10]["kept"]
    assert got[11]["failed_rules"] == ""  # its stratum has no labels
    assert all(got[i]["kept"] for i, *_ in good)


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.store(stage(spark, docs, sf_dir))
        assert out.columns == columns and out.count() > 0
        if name == "lines":
            keys = {}
            for r in docs.orderBy("doc_id").collect():
                for line in {x.strip(" \n\t\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (r["text"] or "").split("\n")}:
                    keys.setdefault(line, r["doc_id"])
            for r in out.collect():
                assert all(keys[k] == r["doc_id"] for x in r["text"].split("\n") if len(k := x.strip(" \n\t\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) >= 10)
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r["decoded_sha256"] for r in last.collect()) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())
