"""The pipeline's near-dedup stage links by SimHash first; minimum hashes find what lies further apart."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import near_copies, simhash_dedup

from .test_near_copies import changed
from .test_text_operators import classes, documents, prose


def test_what_simhash_joins_is_not_asked_again(spark, monkeypatch):
    """Copies within two bits of a long text: no bucket of minimum hashes is left open."""
    rng = random.Random(31)
    base = prose(rng, 3000)
    texts = [base, *[base + " tail" + str(i) for i in range(12)], prose(rng, 3000)]
    prints = [simhash_dedup.fingerprint(t.encode()) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 2 for p in prints[:-1])
    rows, pivots = [], near_copies._to_pivots
    monkeypatch.setattr(near_copies, "_to_pivots", lambda open_: (rows.append(open_.count()), pivots(open_))[1])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, texts), "").collect()) == [0, 13]
    assert rows == [0]


def test_simhash_pairs_join_the_classes_of_the_operator(spark):
    rng = random.Random(32)
    texts = [prose(rng, 400) for _ in range(6)]
    texts += [changed(rng, rng.choice(texts), rng.randrange(3)) for _ in range(40)]
    prints = [simhash_dedup.fingerprint(t.encode()) for t in texts]
    own = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "fp long, sim long")
    got = [(r.v, r.u) for r in near_copies.simhash_pairs(own).collect()]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert near and classes(len(texts), got) == classes(len(texts), near)


def test_simhash_links_are_decided_exactly(spark):
    """Equal fingerprints of different texts: `x` repeated gives one shingle of three words, but other five-word shingles."""
    docs = documents(spark, ["x x x x", "x x x x x", "x x x x x x x"])
    assert simhash_dedup.keep_representatives(docs).count() == 1
    assert sorted(r.doc_id for r in near_copies.keep_representatives(docs).select(F.col("doc_id")).collect()) == [0, 1]
