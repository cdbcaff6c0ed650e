import random

import corpus_pipeline
from loomgraph.llm import source_mix

from .test_text_operators import DOCS, prose

EXTRA = "score double, removed array<int>, n_lines long, taken long, target double, size long, u double, fp long, dk long, kept string"


def write(spark, at, docs, labels, items):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_nulls_repeats_ties_long_texts_and_clashing_columns(spark, tmp_path):
    rng = random.Random(61)
    item = prose(rng, 40)
    rows = [(i, prose(rng, rng.randrange(30, 120)).capitalize() + ".", "en", ["a", "b", None][i % 3], 1) for i in range(90)]
    rows += [(None, rows[0][1] + " and more", "en", None, None), (None, None, None, None, None), (91, None, "en", "a", 0), (92, "", "en", "a", 0), (93, " \n\t ", None, "a", 3)]
    rows += [rows[5], rows[5], (5, "Another text of the same id " + prose(rng, 50), "en", "b", 9), (94, rows[6][1], "en", "a", 1)]  # repeated rows, ids and texts
    rows += [(95, " ".join(prose(rng, 50) for _ in range(1500)), "en", "a", 1), (96, prose(rng, 30) + " " + item + " " + prose(rng, 30), "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.selectExpr("*", *[f"cast(null as {t}) as {n}" for n, t in (c.split(" ") for c in EXTRA.split(", "))])
    at = write(spark, tmp_path / "t", clash, [(i, 1, 0) for i in range(0, 90)] + [(None, 1, 0), (1, None, 0)], [(1, item), (2, None), (3, "")])
    out = corpus_pipeline.run(spark, at).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len({(r.doc_id, r.size) for r in out}) and 95 in ids and 96 not in ids and 94 not in ids
    assert set(range(90)) - set(ids) <= {5} and ids.count(5) in (1, 2)
    per = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        per.setdefault(r.source, []).append(r)
    for rs in per.values():
        assert sum(r.size for r in rs) == rs[0].source_size and abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, at).collect()), key=str)
    assert corpus_pipeline._documents(clash).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # the mix of what the first four stages kept, by its SQL
    import duckdb

    kept = spark.read.parquet(f"{at}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, at).write.parquet(f"{tmp_path}/stage{i}")
        kept = spark.read.parquet(f"{tmp_path}/stage{i}")
    documents = kept.toArrow()  # noqa: F841
    want = duckdb.connect().execute(source_mix.mix_sql()).fetchall()
    assert sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Only one text here.", "en", "a", 1)], DOCS)
    none = write(spark, tmp_path / "e", docs.limit(0), [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
    one = write(spark, tmp_path / "o", docs, [], [])
    assert [r.doc_id for r in corpus_pipeline.run(spark, one).collect()] == []  # without labels every score is 0.5: nothing reaches the threshold
