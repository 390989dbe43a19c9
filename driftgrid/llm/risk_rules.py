"""Quality rules with risk-controlled thresholds.

Each rule compares a measure of the text with a cutoff from a fixed list.  The cutoffs of all rules lie on one
path, from the loosest of each rule to the strictest; a step adds one cutoff to those before it.  On labelled documents,
the number of good ones that the rules together reject at a step gives an exact binomial test: so few would
be unlikely, were the true false rejection rate above the limit.  A stratum walks the path and stops before the first step that fails
its test, so its steps need no correction among themselves; the level is divided over the strata that
have labels enough to pass any test.  The others use no learned rule.  So that a rule unfit for a stratum stops no other,
a quarter of the labels, which no test uses, first takes the steps off the path that by themselves reject more than a rule's even part of the limit.
DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import BLANKS, WORD, bound, ready
from driftgrid.session import store
from driftgrid.spread import lookup

SYMBOLS = "#*$%&|<>"
#: False rejections of good documents by all rules together: at most RISK per stratum, with confidence 1 - DOUBT over all strata.
#: A stratum needs log(DOUBT) / log(1 - RISK) tested good labels (149) at the least, more where several strata are tested.
RISK, DOUBT = 0.02, 0.05
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Rule -> (numerator, denominator, cutoffs from strict to loose); a document fails above the cutoff.
RULES = {
    "long_words": ("word_chars", "n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    "short_words": ("n_words", "word_chars", (0.26, 0.28, 0.3, 0.333, 0.35, 0.4)),
    "symbols": ("n_symbols", "n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    "repeats": ("n_repeat_words", "n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
}
#: The steps (rule, cutoff) from loose to strict, rule by rule in each round.
PATH = tuple(
    (rule, cuts[-1 - turn]) for turn in range(max(len(cuts) for _, _, cuts in RULES.values())) for rule, (_, _, cuts) in RULES.items() if turn < len(cuts)
)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    The window hashes are sorted with their positions; a hash beside its equal is repeated.  The
    sorted positions of those windows cover up to three words each, less where the next one begins.
    """
    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        each = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) >= 3, F.sort_array(each)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        # get() of a negative position is null
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"].cast("long")))

    def covered(p: Column) -> Column:
        gap = lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3).cast("long")), F.lit(3).cast("long"))
        return F.aggregate(F.transform(p, gap), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.coalesce(bound(words, lambda w: bound(windows(w), lambda s: bound(repeated(s), covered))), F.lit(0).cast("long"))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines), stored; null texts have none of each.

    Lines count if they hold a word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    bare = F.translate(t, BLANKS, "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.char_length(F.btrim(x, F.lit(BLANKS))) > 0)
    return store(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
            bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
            bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
            F.char_length(bare).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        ).select("doc_id", "stratum", "w.*", "l.*", "word_chars", "n_symbols")
    )


def ratio(rule: str) -> Column:
    top, below, _ = RULES[rule]
    return F.col(top) / F.when(F.col(below) > 0, F.col(below))


def tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of n draws at ``rate``, where k is at most rate * n; 1 above.

    The largest term is the one of k; the terms before it are summed as ratios to it.
    """
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_choose = F.aggregate(steps, F.lit(0.0), lambda a, j: a + F.log((n - k + j) / j))
    down = F.transform(steps, lambda j: k - j + 1)  # k, k-1, .. 1
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * i * (1 - rate) / ((n - i + 1) * rate)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(down, start, add, lambda a: a["sum"])
    value = F.exp(log_choose + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))) * total
    return F.when(k <= rate * n, value).otherwise(F.lit(1.0))


def thresholds(found: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, good, steps, cut_<rule> ...): tested good labels, how many steps of the path pass, and the strictest cutoff of each rule among them, else null.

    A label row with a null id or label is passed over, and an id with several labels is good if
    all say so.  Without labels the table has no rows.
    """
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    good = found.join(marks.filter("label = 1").select("doc_id"), "doc_id", "left_semi").withColumn("stratum", F.coalesce("stratum", F.lit("")))
    good = good.withColumn("pilot", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1) < "4")
    steps = range(len(PATH))
    alone = [F.count_if(F.col("pilot") & (ratio(r) > c)) <= risk / len(RULES) * F.count_if("pilot") for r, c in PATH]
    path = store(good.groupBy("stratum").agg(F.array(*alone).alias("path")))
    # The first step that rejects the document.
    first = F.least(*(F.when((ratio(r) > c) & F.get("path", F.lit(i)), F.lit(i)) for i, (r, c) in enumerate(PATH)))
    tested = lookup(good.filter(~F.col("pilot")), path, "stratum").select("stratum", "path", first.alias("first"))
    over = [F.count_if(F.col("first") <= i).alias(f"k{i}") for i in steps]
    counts = store(tested.groupBy("stratum", "path").agg(F.count("*").alias("good"), *over))
    enough = F.pow(F.lit(1 - risk), F.col("good")) <= doubt
    level = doubt / max(1, counts.filter(enough).count())
    # Rejections only grow along the path, so the steps that pass are its beginning.
    passes = [F.when(enough & (tail(F.col(f"k{i}"), F.col("good"), risk) <= level), 1).otherwise(0) for i in steps]
    walked = store(counts.select("stratum", "good", "path", sum(passes[1:], passes[0]).alias("steps")))
    cut = {r: F.least(*(F.when((F.col("steps") > i) & F.get("path", F.lit(i)), F.lit(c)) for i, (x, c) in enumerate(PATH) if x == r)) for r in RULES}
    return walked.select("stratum", "good", "steps", *(c.alias(f"cut_{r}") for r, c in cut.items()))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """One row per input row with its measures, ``base_failed``, ``failed_rules`` and ``kept``.

    A null or empty text has no words and fails the base rule.  Documents of a null stratum are a stratum of their
    own; strata without labels use no learned rule.  Repeated rows are judged alike; other columns are not looked at.
    """
    ready(docs.sparkSession)
    found = measures(docs, doc_id, text, stratum)
    cuts = thresholds(found, labels, risk, doubt, doc_id)
    met = lookup(found.withColumn("stratum", F.coalesce("stratum", F.lit(""))), cuts, "stratum", "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*(F.when(ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    return met.withColumn("base_failed", base).withColumn("failed_rules", F.array_join(failed, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))

