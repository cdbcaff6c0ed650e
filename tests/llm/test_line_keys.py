"""Keys of lines are taken for many lines at once, not by a call for each of them."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import line_dedup


def steps(f):
    """Calls of Python and C functions while `f` runs, and its result."""
    seen = [0]

    def count(frame, event, arg):
        seen[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = f()
    finally:
        sys.setprofile(None)
    return seen[0], got


def test_no_call_for_each_key():
    text = "\n".join(f"line {i * 7919} of {i} quite different ones" for i in range(5_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["_text"])
    n, out = steps(lambda: list(line_dedup._keys(line_dedup.MIN_BYTES, 2)(iter([batch]))))
    assert sum(b.num_rows for b in out) >= 12 * 5_000  # twelve keys a line
    assert n < 12 * 5_000


@pytest.mark.parametrize("chunk", [1 << 19, 100, 30, 7])
def test_equal_segments_have_equal_keys(monkeypatch, chunk):
    """Two keys are equal where seed and segment are, whatever is taken together with them."""
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    rng = random.Random(5)
    for threshold in (0, 1, 2, 3):
        lines = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 60))) for _ in range(300)] + [b"\x00" * 40, b"\xff" * 41]
        at, seen = 0, {}
        for lo, hi, keys, owners, roles in line_dedup.line_keys(lines, threshold):
            assert lo == at and keys.dtype == np.int64
            at = hi
            want = [(i, *row) for i, line in enumerate(lines[lo:hi]) for row in line_dedup.plan(len(line), threshold).tolist()]
            assert owners.tolist() == [i for i, *_ in want] and roles.tolist() == [r for *_, r in want]
            for key, (i, seed, a, b, _) in zip(keys.tolist(), want):
                assert seen.setdefault((seed, lines[lo + i][a:b]), key) == key
        assert at == len(lines) and len(set(seen.values())) == len(seen)
