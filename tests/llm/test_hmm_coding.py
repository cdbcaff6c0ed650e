"""Words are cut, counted and coded a batch at a time, with no Python step for each of them."""

import platform
import random
import resource
import sys
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import hmm_lm


def batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["_text"])])


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


def counted(texts):
    n = Counter()
    for b in hmm_lm._counter(batches(texts)):
        for w, c in zip(b.column("token").to_pylist(), b.column("n").to_pylist()):
            n[w] += c
    return n


def test_words_and_codes_of_odd_texts(monkeypatch):
    monkeypatch.setattr(hmm_lm, "FLUSH", 3)
    rng = random.Random(51)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\rAzZÄé\x1c\x85　\x00") for _ in range(rng.randrange(12))) for _ in range(500)] + [None, "", " "]
    want = [[w.decode() for w in hmm_lm.tokens(t.encode() if t else None)] for t in texts]
    assert counted(texts) == Counter(w for ws in want for w in ws)
    top = [w for w, _ in counted(texts[:100]).most_common() if w][:20]
    vocabulary = hmm_lm.Vocabulary(pa.array(top), np.ones(len(top)), 1, 9, 9, own=5)
    (out,) = hmm_lm._encoder(SimpleNamespace(value=vocabulary))(batches(texts))
    for ws, row in zip(want, out.to_pylist()):
        at = np.frombuffer(row["seq"], "<u2").astype(int)
        at[at > 5] = np.frombuffer(row["fine"], "<u4")
        assert [([""] + top + row["rare"])[i] for i in at] == ws
        assert len(set(row["rare"])) == len(row["rare"]) and (row["n_tokens"], row["n_inside"]) == (len(ws), sum(w in top + [""] for w in ws))


def test_no_python_step_for_each_word():
    texts = [" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(10)]  # all past the dictionary
    vocabulary = hmm_lm.Vocabulary(pa.array(["a"]), np.ones(1), 1, 9, 9, own=1)
    n, (out,) = steps(lambda: list(hmm_lm._encoder(SimpleNamespace(value=vocabulary))(batches(texts))))
    assert sum(map(len, out.column("rare").to_pylist())) == 20_000
    assert n < 2_000


def test_few_words_are_held_at_a_time(monkeypatch):
    """A batch of 4 MB of text; what is held beside it follows the piece, not the batch."""
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(5_000)) for i in range(200)] + [None, ""]
    vocabulary = hmm_lm.Vocabulary(pa.array([f"w{i}" for i in range(900)]), np.ones(900), 1, 9, 9, own=5)
    whole = counted(texts)
    monkeypatch.setattr(hmm_lm, "PIECE", 1 << 30, raising=False)
    (want,) = hmm_lm._encoder(SimpleNamespace(value=vocabulary))(batches(texts))
    monkeypatch.setattr(hmm_lm, "PIECE", 1 << 16, raising=False)
    given, old = list(batches(texts)), pa.default_memory_pool()
    pool = pa.proxy_memory_pool(old)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        got, n = 0, Counter()
        for b in hmm_lm._encoder(SimpleNamespace(value=vocabulary))(iter(given)):
            kept = ["n_tokens", "n_inside", "seq"]  # the order of a text's rare words is free
            assert b.select(kept).equals(want.select(kept).slice(got, b.num_rows))
            got += b.num_rows
        assert got == len(texts)
        for b in hmm_lm._counter(iter(given)):
            n += dict(zip(b.column("token").to_pylist(), b.column("n").to_pylist()))
        assert n == whole
        assert tracemalloc.get_traced_memory()[1] < 8 << 20 and pool.max_memory() < 8 << 20
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(old)


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="other C libraries hold nothing back")
def test_a_task_gives_its_memory_back():
    """Freed arrays below one that stays are held by the C library until it is told."""
    stays = []

    def run(batches):
        arrays = [np.ones(12_000) for _ in range(1_500)]  # 144 MB
        stays.append([bytes(1_000) for _ in range(2_000)])
        yield resident()
        del arrays

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize() / 1e6

    (most,) = hmm_lm._released(run)(iter([]))
    assert resident() < most - 100
