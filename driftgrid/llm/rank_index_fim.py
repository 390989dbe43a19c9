"""Fill-in-the-middle texts, cut with a learned index of token boundaries.

The boundaries of a text's tokens are numbered; the offset of a boundary is nearly a linear function of its
number.  Per text, line segments are fitted to all boundaries so that none is further off than a bound; a segment that
misses it is halved.  What the segments miss is stored, one byte per boundary.  A cut is predicted from its
segment and corrected by the stored byte, which gives the exact offset.

One pass over the texts in Arrow batches, without a shuffle; a batch holds few texts, and all work arrays follow the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import ready

#: The largest error that a segment may leave; its bytes are signed.
BOUND = 127
#: Percent of the texts that are cut, and of these of the form with the suffix first.
CUT, SUFFIX_FIRST = 90, 20
MARKS = ("<P>", "<S>", "<M>")
INDEX = "n long, firsts array<long>, bases array<long>, rises array<long>, runs array<long>, residuals binary"


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, of the starts of all tokens ``[A-Za-z]+|[^A-Za-z]``, and of the end."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((c | 32) - np.uint32(97)) < 26
    start = np.ones(len(c), bool)
    start[1:] = ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(start), len(c))


class RankIndex:
    """Offsets by rank: rank r of the segment from ``first`` on is at base + (r - first) * rise // run + residual."""

    def __init__(self, firsts: np.ndarray, bases: np.ndarray, rises: np.ndarray, runs: np.ndarray, residuals: np.ndarray):
        self.firsts, self.bases, self.rises, self.runs, self.residuals = firsts, bases, rises, runs, residuals

    @classmethod
    def fit(cls, offsets: np.ndarray, bound: int = BOUND) -> RankIndex:
        residuals = np.empty(len(offsets), np.int8)
        a, b, done = np.array([0]), np.array([len(offsets)]), []
        while len(a):
            size = b - a
            starts = np.cumsum(size) - size
            segment = np.repeat(np.arange(len(a)), size)
            step = np.arange(len(segment)) - starts[segment]
            at = a[segment] + step
            rise, run = offsets[b - 1] - offsets[a], np.maximum(size - 1, 1)
            miss = offsets[at] - offsets[a][segment] - step * rise[segment] // run[segment]
            low, high = np.minimum.reduceat(miss, starts), np.maximum.reduceat(miss, starts)
            middle = (low + high) // 2
            fits = (high - middle <= bound) & (middle - low <= bound)
            inside = fits[segment]
            residuals[at[inside]] = (miss - middle[segment])[inside]
            done.append(np.stack([a, offsets[a] + middle, rise, run])[:, fits])
            a, b = a[~fits], b[~fits]
            half = (a + b) // 2
            a, b = np.concatenate([a, half]), np.concatenate([half, b])
        segments = np.concatenate(done, axis=1)
        return cls(*segments[:, segments[0].argsort()], residuals)

    def predict(self, rank: int) -> int:
        s = int(self.firsts.searchsorted(rank, side="right")) - 1
        return int(self.bases[s] + (rank - self.firsts[s]) * self.rises[s] // self.runs[s])

    def __getitem__(self, rank: int) -> int:
        return self.predict(rank) + int(self.residuals[rank])


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = BOUND) -> DataFrame:
    """(doc_id, n, firsts, bases, rises, runs, residuals): the learned index of every text, for cuts made elsewhere."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                found = RankIndex.fit(boundaries(t or ""), bound)
                for o, v in zip(out, (len(found.residuals) - 1, found.firsts, found.bases, found.rises, found.runs, found.residuals.tobytes())):
                    o.append(v)
            kinds = (pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], names=["doc_id", *(f.split()[0] for f in INDEX.split(", "))])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {INDEX}")


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers that follow from the id alone; a null id counts as empty text."""
    h = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def transformed(doc_id: int | None, text: str, bound: int = BOUND) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    offsets = boundaries(text)
    n = len(offsets) - 1
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= CUT:
        return n, "plain", None, None, text
    places = RankIndex.fit(offsets, bound)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = places[a], places[b]
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = MARKS
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", i, j - i, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", i, j - i, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = BOUND) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per input row, repeated rows included.

    A null text is an empty one, and an empty one is plain; a text that holds a mark stays plain.  A null id stays null.
    Rows with equal ids draw the same numbers.  Texts of any length are cut whole.  An empty table gives an empty one;
    other columns are not looked at.
    """
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [transformed(i, t or "", bound) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            columns = list(zip(*found)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
