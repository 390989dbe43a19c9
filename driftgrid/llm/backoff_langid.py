"""Language identification by words first, then shorter and shorter character n-grams.

Learning counts words per language over all learning texts; n-grams are counted from those word
counts.  Only entries with a share of at least ``share`` of their language are kept, so a table
has at most languages / share entries, however large the corpus.  A known word scores its log share
per language; an unseen word takes the mean log share of its longest n-grams that are known.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import ready
from driftgrid.session import store

#: Most entries of the word table and of the n-gram tables together: sets the least share.
ENTRIES = 400_000
ORDERS = (5, 4, 3, 2, 1)
#: Log weight of each step down to shorter n-grams.
STEP = math.log(0.4)
#: Distinct keys a task holds before it hands them on.
HELD = 300_000
WORDS = r"[^\W\d_]+"
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    framed = f"<{word}>"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def every_gram(word: str) -> list[str]:
    framed = f"<{word}>"
    return [framed[i : i + n] for n in ORDERS for i in range(len(framed) - n + 1)]


def counted(rows: Counter) -> pa.RecordBatch:
    keys = list(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([rows[k] for k in keys], pa.int64())],
        names=["lang", "n", "item", "uses"],
    )


COUNTS = "lang string, n int, item string, uses long"


def word_counts(batches):
    find, by_lang, held = re.compile(WORDS).findall, {}, 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = by_lang.setdefault(lang, Counter())
            held -= len(seen)
            seen.update(find(text.lower()))
            held += len(seen)
        if held > HELD:
            yield from (counted(Counter({(k, 0, w): n for w, n in c.items()})) for k, c in by_lang.items())
            by_lang, held = {}, 0
    yield from (counted(Counter({(k, 0, w): n for w, n in c.items()})) for k, c in by_lang.items())


def gram_counts(batches):
    by_lang: dict[str, dict[str, int]] = {}

    def out():
        return [counted(Counter({(k, len(g), g): n for g, n in c.items()})) for k, c in by_lang.items()]

    for b in batches:
        for lang, word, uses in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
            seen = by_lang.setdefault(lang, {})
            get = seen.get
            for g in every_gram(word):
                seen[g] = get(g, 0) + uses
        if sum(map(len, by_lang.values())) > HELD:
            yield from out()
            by_lang.clear()
    yield from out()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", entries: int = ENTRIES) -> dict:
    """The model: languages, least shares, and log shares of words and n-grams.

    Rows without text or language teach nothing.  Without any, the model knows no language.
    """
    spark = ready(docs.sparkSession)
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    words = store(known.mapInArrow(word_counts, COUNTS).groupBy("lang", "n", "item").agg(F.sum("uses").alias("uses")))
    every = words.unionByName(words.mapInArrow(gram_counts, COUNTS).groupBy("lang", "n", "item").agg(F.sum("uses").alias("uses")))
    every = store(every)
    totals = {(r.lang, r.n): r.uses for r in every.groupBy("lang", "n").agg(F.sum("uses").alias("uses")).collect()}
    langs = sorted({k for k, _ in totals})
    if not langs:
        return {"langs": [], "tables": {}, "floor": {}}
    share = {n: len(langs) / entries * (1 if n == 0 else len(ORDERS)) for n in (0, *ORDERS)}
    least = spark.createDataFrame([(k, n, share[n] * t) for (k, n), t in totals.items()], "lang string, n int, least double")
    kept = every.join(F.broadcast(least), ["lang", "n"]).filter(F.col("uses") >= F.col("least")).select("lang", "n", "item", "uses").toArrow()
    place = {k: i for i, k in enumerate(langs)}
    floor = {n: math.log(share[n] / 10) for n in share}
    tables: dict[int, dict[str, np.ndarray]] = {n: {} for n in share}
    for k, n, item, uses in zip(*(c.to_pylist() for c in kept.columns)):
        row = tables[n].get(item)
        if row is None:
            row = tables[n][item] = np.full(len(langs), floor[n], np.float32)
        row[place[k]] = math.log(uses / totals[k, n])
    return {"langs": langs, "tables": tables, "floor": floor}


def scorer(model: dict, cached: int = HELD):
    """text -> (language, score).

    The score is the language's share of the likelihood under equal priors; ties go to the
    first language by code point.
    """
    langs, tables = model["langs"], model["tables"]
    find = re.compile(WORDS).findall

    if langs:
        first = tables[0]
        vocabulary = {w: i for i, w in enumerate(first)}
        matrix = np.zeros((len(first) + cached + 1, len(langs)), np.float32)
        if first:
            matrix[: len(first)] = np.stack(list(first.values()))
        known = dict(vocabulary)
        # All n-grams in one matrix, each with the weight of its step; row 0 is for words without any known one.
        place = {n: {g: i + 1 for i, g in enumerate(tables[n])} for n in ORDERS}
        shift, shelf = 0, [np.zeros((1, len(langs)), np.float32)]
        for step, n in enumerate(ORDERS):
            place[n] = {g: i + shift for g, i in place[n].items()}
            shift += len(tables[n])
            if tables[n]:
                shelf.append(np.stack(list(tables[n].values())) + np.float32(STEP * (step + 1)))
        shelf = np.concatenate(shelf)

    def rows_of(word: str) -> list[int]:
        for n in ORDERS:
            get = place[n].get
            rows = [r for g in grams(word, n) if (r := get(g))]
            if rows:
                return rows
        return [0]

    def learn(words: list[str]) -> None:
        """Give unseen words their rows: the mean of their longest known n-grams."""
        rows = [rows_of(w) for w in words]
        size = np.array([len(r) for r in rows])
        flat = [x for r in rows for x in r]
        at = len(known)
        matrix[at : at + len(words)] = np.add.reduceat(shelf[flat], np.concatenate([[0], size[:-1].cumsum()]), axis=0) / size[:, None]
        known.update(zip(words, range(at, at + len(words))))

    def score(text: str | None) -> tuple[str, float]:
        nonlocal known
        words = find(text.lower()) if text else []
        if not words or not langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        total = np.zeros(len(langs))
        for start in range(0, len(words), 100_000):  # a very long text in pieces, so that the cache holds one
            part = words[start : start + 100_000]
            if len(known) + len(part) > len(matrix):
                known = dict(vocabulary)
            if missing := list({w for w in part if w not in known}):
                learn(missing)
            total += matrix[list(map(known.__getitem__, part))].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())

    return score


def language(spark, model: dict):
    """A function of the text column that gives struct<lang_pred, score>."""
    shared = spark.sparkContext.broadcast(model)  # at most ENTRIES words and ENTRIES n-grams

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer(shared.value)
        for part in texts:
            yield pd.DataFrame([score(t) for t in part], columns=["lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row.

    A null text, an empty one and one without a letter get ``und`` with score 0, as does
    everything under a model without languages.  Only the text is looked at; a null id stays null.
    """
    spark = ready(docs.sparkSession)
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), language(spark, model)(F.col(text)).alias("_found"))
    return found.select("doc_id", "_found.lang_pred", "_found.score")


def accept(docs: DataFrame, model: dict, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with at least the score ``least``."""
    spark = ready(docs.sparkSession)
    mark = "_found"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, language(spark, model)(F.col(text)))
    return marked.filter((F.col(f"{mark}.lang_pred") != UNKNOWN) & (F.col(f"{mark}.score") >= least)).drop(mark)
