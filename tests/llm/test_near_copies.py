import random

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import near_copies

from .test_text_operators import EDGE, WORDS, classes, documents, prose


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def changed(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def test_pipeline_stage_against_brute_force(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(14):
        texts.append(prose(rng, 120))
        for _ in range(rng.randrange(8)):
            texts.append(changed(rng, texts[-1] if rng.random() < 0.4 else texts[-1 - rng.randrange(2)], rng.randrange(6)))
    texts += [*EDGE, "ONE", "one  two", *[f"{texts[0]} {texts[1]}"] * 2]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(texts[i], texts[j])]
    assert any(shingle_set(texts[i]) != shingle_set(texts[j]) for i, j in pairs)
    want = sorted(set(classes(len(texts), pairs)))
    docs = documents(spark, texts)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("edits", [0, 3])
def test_near_copies_of_a_large_group(spark, edits):
    """All in one bucket; with edits the group holds together through others than the least and the greatest member."""
    rng = random.Random(22)
    base = prose(rng, 200)
    texts = [base, *[changed(rng, base, edits) for _ in range(150)], prose(rng, 200)]
    assert sorted(r.doc_id for r in near_copies.keep_representatives(documents(spark, texts)).collect()) == [0, 151]


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d e f", 1), (4, "a b c d  e f", 1), (4, "a b c d  e f", 1), (None, "solo words", 1), (7, None, 1), (8, " ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert sorted((r.doc_id or 0) for r in near_copies.keep_representatives(docs).collect()) == [0, 4, 7]


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(23)
    for size in (9, 90, 900):
        both = [rng.integers(0, 2**64, size // 9 * 8, np.uint64) for _ in range(300)]
        sides = [[np.concatenate([b, rng.integers(0, 2**64, size // 9, np.uint64)]) for b in both] for _ in range(2)]
        a, b = map(near_copies.band_keys, sides)
        shared = (a == b).sum(1)
        assert (shared > 0).all() and abs(shared.mean() / near_copies.BANDS - 0.8**near_copies.ROWS) < 0.03
