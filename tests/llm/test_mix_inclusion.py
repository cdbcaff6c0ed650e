import random

import numpy as np

from loomgraph.llm import source_mix

DOCS = "doc_id long, text string, source string"


def test_inclusion_follows_size(spark):
    """Over many seeds a document is taken about as often as its inclusion probability says; larger ones more often."""
    rng = random.Random(5)
    sizes = [rng.choice([3, 10, 30, 100]) for _ in range(4000)]
    rows = [(i, " ".join(["w"] * n), "a" if i % 3 else "b") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1).cache()
    goal = {r.source: r for r in source_mix.targets(source_mix.sized(docs)).collect()}
    for r in goal.values():
        if r.rest > 0:
            own = [n for i, n in enumerate(sizes) if rows[i][2] == r.source]
            assert abs(sum(min(1, r.pull * n) * n for n in own) - r.rest) < 1e-6 * r.rest
    seeds, seen = 2, np.zeros(len(rows))
    for seed in range(seeds):
        for r in source_mix.mix(docs, seed=str(seed)).collect():
            extra = r.taken - goal[r.source].copies * r.size
            seen[r.doc_id] += extra > 0
    for source, r in goal.items():
        for n in (3, 10, 30, 100):
            mine = [i for i in range(len(rows)) if rows[i][2] == source and sizes[i] == n]
            p, got = min(1, r.pull * n) if r.rest > 0 else 0, seen[mine].mean() / seeds
            assert abs(got - p) < 0.03 + 4 * (p * (1 - p) / (len(mine) * seeds)) ** 0.5, (source, n, p, got)


def test_same_rows_as_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(6)
    rows = [(rng.randrange(300), " ".join(["w"] * rng.choice([0, 1, 5, 50, 500])), rng.choice(["a", "a", "a", "b", "c", "ß", None])) for _ in range(500)] + [(None, None, "a"), (1, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    db = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    want = sorted(db.execute(source_mix.mix_sql()).fetchall(), key=str)
    got = sorted((tuple(r) for r in source_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    assert got == want
