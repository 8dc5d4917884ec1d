"""Suffix arrays of segments: the order, the shared prefixes, the steps they take, and the merge of sorted runs."""

import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import suffix_dedup as dedup


def pieces_of(rng, width, alphabet, number):
    """Stretches of one text, some with a changed byte, and a few others."""
    base = bytes(rng.choice(alphabet) for _ in range(3 * width))
    out = []
    for _ in range(number):
        begin = rng.randint(0, width)
        body = bytearray(base[begin : rng.randint(begin + width, 3 * width)])
        if rng.random() < 0.5:
            body[rng.randrange(len(body))] = rng.choice(alphabet)
        out.append(bytes(body))
    return out


@pytest.mark.parametrize("packed", [0, dedup.PACKED])
def test_order_and_prefixes_equal_plain_sorting(monkeypatch, packed):
    monkeypatch.setattr(dedup, "PACKED", packed)
    rng = random.Random(5)
    for trial in range(60):
        width = rng.choice([9, 20, 40])
        monkeypatch.setattr(dedup, "WIDTH", width)
        bodies = pieces_of(rng, width, rng.choice([b"a", b"\0a", b"abc", bytes(range(256))]), rng.randint(1, 9))
        counts = np.array([len(b) - width + 1 for b in bodies])
        starts, own = dedup.owned(counts)
        lengths = counts + width - 1
        left = np.repeat(starts + lengths, lengths) - np.arange(int(lengths.sum()))
        words = dedup.words8(np.frombuffer(b"".join(bodies), np.uint8))
        suffix = {int(s) + k: b[k:] for s, b in zip(starts, bodies) for k in range(len(b))}
        order = dedup.suffix_array(words, left)
        assert order.tolist() == sorted(suffix, key=lambda p: (suffix[p], p))
        shared = dedup.common_prefixes(words, order, left, starts, counts, width)
        for before, p in zip(order.tolist(), order.tolist()[1:]):
            same = next((k for k, (x, y) in enumerate(zip(suffix[before], suffix[p])) if x != y), min(len(suffix[before]), len(suffix[p])))
            assert shared[p] == (min(same, width) if p in own else 0)
        strings = [b[k : k + width] for b, n in zip(bodies, counts) for k in range(n)]
        seen = Counter(strings)
        hit = dedup.marked(bodies, counts)
        assert hit.tolist() == [seen[s] > 1 for s in strings]
        segment, first, last = dedup.runs(hit, counts)
        again = np.zeros(len(hit), bool)
        begin = np.cumsum(counts) - counts
        for s, a, b in zip(segment, first, last):
            assert 0 <= a <= b < counts[s]
            again[begin[s] + a : begin[s] + b + 1] = True
        assert (again == hit).all()


def test_prefixes_take_steps_by_place_and_not_by_byte():
    rng = random.Random(6)
    bodies = [body[:368] for body in pieces_of(rng, 200, b"abcdefgh ", 300)]
    counts = np.array([len(b) - 199 for b in bodies])
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        dedup.marked(bodies, counts)
    finally:
        sys.setprofile(None)
    assert calls["c_call"] < 40 * counts.max()  # byte by byte, a place takes as many steps as the longest prefix


def test_many_sorted_runs_are_merged():
    rng = np.random.default_rng(7)
    pairs = [(int(x), int(x) % 5) for x in rng.integers(0, 400, 300)] + [(7, 1), (7, 2), (7, 3)]
    held = [sorted(set(pairs[k] for k in rng.integers(0, len(pairs), 12))) for _ in range(33)]
    bodies = [np.array([(x, y, d, 0, 1000 * i) for i, (x, y) in enumerate(one)]).T.astype(np.int64).tobytes() for d, one in enumerate(held)]

    class Runs:
        def groupBy(self, _):
            return self

        def applyInArrow(self, run, _):
            return run(pa.table({"body": pa.array(bodies, pa.binary())}))

    found = dedup.merged_spans(Runs()).to_pylist()
    seen = Counter(p for one in held for p in one)
    want = [(d, 0, 1000 * i, 1000 * i + dedup.WIDTH) for d, one in enumerate(held) for i, p in enumerate(one) if seen[p] > 1]
    assert [(r["d"], r["t"], r["lo"], r["hi"]) for r in found] == want


def test_blocks_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", 700)
    monkeypatch.setattr(dedup, "BLOCK_BYTES", 2000)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcä ") for _ in range(n)) for n in (0, 150, 250, 4000, 199, 3000, 180, 600)] + [None]

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            ids = pa.array(range(len(texts)), pa.int64())
            return list(run(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["d", "t", "text"]).slice(1)])))

    starts = Counter()
    anchors = {}
    for batch in dedup.segment_rows(Rows()):
        for r in batch.to_pylist():
            body = texts[r["d"]].encode()[r["a"] : r["a"] + r["n"] + dedup.WIDTH - 1]
            assert r["d"] == r["t"] and len(body) == r["n"] + dedup.WIDTH - 1
            assert anchors.setdefault(body, (r["anchor"], r["seg"])) == (r["anchor"], r["seg"])
            starts.update((r["d"], r["a"] + k) for k in range(r["n"]))
    want = {(i, k) for i, t in enumerate(texts) for k in range(len((t or "").encode()) - dedup.WIDTH + 1)}
    assert set(starts) == want and max(starts.values()) == 1
