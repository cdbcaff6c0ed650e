import random

import pytest

from loomgraph.llm import decontaminate

from .test_text_operators import documents, prose


def best_windows(text, item):
    """Similarity of the best window and its place, by counting every window anew."""
    words, own = text.encode().lower().split(), item.encode().lower().split()
    bag = decontaminate.Counter(decontaminate.shingles(own))
    size = min(len(own), len(words))
    sims = [decontaminate.weighted_jaccard(decontaminate.Counter(decontaminate.shingles(words[s : s + size])), bag) for s in range(len(words) - size + 1)]
    best = max(sims)
    return (best, sims.index(best)) if best >= decontaminate.SIMILARITY else None


@pytest.mark.parametrize("chunk", [7, 64, 4096])
def test_sliding_windows_against_all_windows(monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    rng = random.Random(51)
    items = [prose(rng, n) for n in (3, 5, 12, 60, 150)] + ["a a a a a a a a a a a a"]
    index = decontaminate.Index([(i, t.encode()) for i, t in enumerate(items)])
    met = 0
    for turn in range(30):
        own = items[turn % 6].split()
        for _ in range(turn % 4):
            own[rng.randrange(len(own))] = "changed"
        text = " ".join([prose(rng, rng.randrange(40)), *own, prose(rng, rng.randrange(200)), *own, *(["a"] * (turn % 20))])
        got = {k: (round(s, 12), at) for k, s, at, _ in index.hits(text.encode())}
        for k, item in enumerate(items):
            want = best_windows(text, item)
            assert got.get(k) == (want and (round(want[0], 12), want[1])), (turn, k)
            met += want is not None
    assert met > 20


def test_an_item_of_over_a_mebibyte(spark):
    rng = random.Random(52)
    words = [f"w{rng.randrange(50_000)}" for _ in range(180_000)]
    item = " ".join(words)
    assert len(item) > 1 << 20
    near = list(words)
    for i in range(0, len(near), 60):
        near[i] = "other"
    docs = documents(spark, [" ".join(["lead", "in", *near, "out"]), " ".join(words[:1000]), prose(rng, 50), " ".join(words[:-9])])
    bench = spark.createDataFrame([(1, item), (2, prose(rng, 40)), (1, item)], "item_id long, text string")
    out = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(0, 1), (0, 1), (3, 1), (3, 1)]
    assert all(r.start_word == 2 and r.n_words == len(words) and 0.8 < r.similarity < 0.9 for r in out if r.doc_id == 0)
