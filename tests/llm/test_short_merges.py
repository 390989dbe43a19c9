"""Short pre-tokens of the byte-level BPE are merged without a heap, to the same ids."""

import random

from driftgrid.llm import chunk_bpe


def vocabulary(pick):
    words = {bytes([b]) for b in range(256)}
    words |= {bytes(pick.choices(b"abc", k=pick.randint(2, 5))) for _ in range(60)}
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (len(w), pick.random())))}


def test_short_and_long_way_give_the_same_ids(monkeypatch):
    pick = random.Random(5)
    for _ in range(20):
        ranks = vocabulary(pick)
        pieces = [bytes(pick.choices(b"abcd", k=pick.randint(1, 40))) for _ in range(100)]
        short = [chunk_bpe.merged(p, ranks) for p in pieces]
        with monkeypatch.context() as m:
            m.setattr(chunk_bpe, "SCANNED", 0)
            assert short == [chunk_bpe.merged(p, ranks) for p in pieces]


def test_a_short_pre_token_needs_no_heap(monkeypatch):
    monkeypatch.setattr(chunk_bpe.heapq, "heappop", None)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}
    assert chunk_bpe.merged(b"ababab", ranks) == [257, 256]
