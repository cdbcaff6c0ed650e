"""Extra columns named like an operator's outputs or its working columns: outputs replace, all others stay."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, hmm_lm, license_scan, line_dedup, quality_knn, simhash_dedup, source_mix, token_counts, topk_search, url_filter

#: names that operators use for outputs or inside
NAMES = (
    "dk th ln first kept removed n_lines root id fp u v m t key k all mid h1 h2 line role score label vec quality held_out n_tokens n_known token n c "
    "leaf_chars leaf_tokens n_edits n_sentences sentence_ids matches license size w top level target taken copies rest share z cell cut part source_size "
    "fingerprint component_id is_representative item_id similarity start_word n_words rank pass query_id i j at nb o sim weight"
).split()
URL_NAMES = "items best rule_verdict anchor parts support _rest _tail _l _p item freq antecedent n".split()


def widened(df, names):
    """`df` with a column for each name that holds the name and the row's id."""
    have = set(df.columns)
    return df.select("*", *[F.concat(F.lit(n + "#"), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit(""))).alias(n) for n in names if n not in have])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = "stone river cloud maple ember quartz violet harbor".split()
    line = "This very line is repeated in a number of texts."
    rows = [(i, "\n".join([" ".join(rng.choice(words) for _ in range(30)), line, f"Closing words of text {i} in full length."]), "en", "ab"[i % 2], 1) for i in range(12)]
    rows += [(12, None, "en", None, None), (13, "", "en", "a", 0), (None, "one two", "en", "b", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def check(out, base, plain, added):
    """`out` has the columns of `base` but for the replaced ones, unchanged, and the same outputs as `plain`."""
    names = [x.lower() for x in out.columns]
    assert len(set(names)) == len(names)
    kept = [c for c in base.columns if c not in added]
    assert set(kept) <= set(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        for n in kept:
            if isinstance(r[n], str) and "#" in r[n]:
                assert r[n] == f"{n}#{'' if r[0] is None else r[0]}" or n in ("text", "url")
    pick = lambda rs: sorted(repr([r[c] for c in added]) for r in rs)
    assert pick(rows) == pick(plain.collect())


def test_operators_that_keep_columns(spark, docs):
    wide = widened(docs, NAMES)
    check(line_dedup.dedup_lines(wide), wide, line_dedup.dedup_lines(docs), ["text", "n_lines", "removed"])
    check(license_scan.scan(wide), wide, license_scan.scan(docs), ["n_sentences", "sentence_ids", "matches", "license"])
    built = ["n_tokens", "n_pretokens", "leaf_chars", "leaf_tokens"]
    check(token_counts.build_trees(wide), wide, token_counts.build_trees(docs), built)
    edited = ["text", "n_edits", "edited_tokens", "edited_chars", "reencoded_chars", "leaf_chars", "leaf_tokens"]
    check(token_counts.apply_edits(token_counts.build_trees(wide)), wide, token_counts.apply_edits(token_counts.build_trees(docs)), [*edited, "n_tokens", "n_pretokens"])
    labels = spark.createDataFrame([(i, i % 2, "x", "y") for i in range(12)], "doc_id long, quality int, label string, text string")
    model = quality_knn.fit(wide, labels)
    check(quality_knn.score(wide, model), wide, quality_knn.score(docs, quality_knn.fit(docs, labels)), ["score"])


def test_operators_that_drop_rows(spark, docs):
    wide = widened(docs, NAMES)
    items = spark.createDataFrame([(1, docs.where("doc_id = 3").first().text, "z", 9)], "item_id long, text string, i string, t int")
    clean = decontaminate.clean(wide, items)
    assert clean.columns == wide.columns and {r.doc_id for r in clean.collect()} == {None, *range(14)} - {3}
    kept = simhash_dedup.keep_representatives(wide)
    assert kept.columns == wide.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in simhash_dedup.keep_representatives(docs).collect())))


def test_operators_that_return_their_own_columns(spark, docs):
    wide = widened(docs, NAMES)
    for f in (source_mix.mix, simhash_dedup.near_duplicates, lambda d: hmm_lm.score(d, F.col("doc_id") % 5 == 1)):
        assert sorted(map(repr, f(wide).collect())) == sorted(map(repr, f(docs).collect()))
    vectors = spark.createDataFrame([(i, [i / 7, 1 - i / 5]) for i in range(9)], "vec_id long, embedding array<double>")
    found = [topk_search.top_k(q, q.where("vec_id % 4 = 0")).collect() for q in map(topk_search.quantized, (vectors, widened(vectors, NAMES)))]
    assert sorted(found[0]) == sorted(found[1]) and found[0]


def test_urls(spark):
    urls = [None, "", "no host", *[f"http://a{i % 3}.example.{t}/{p}/x{i}.html?q=1#f" for i, (t, p) in enumerate([("net", "de"), ("com", "de"), ("org", "fr"), ("com", "fr")] * 6)]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    wide = widened(pages, URL_NAMES).withColumns({n: F.lit("old") for n in ("Host", "PATH", "rule", "verdict", "confidence")})
    out = url_filter.judge(wide)
    added = ["host", "path", "rule", "verdict", "confidence"]
    assert "Host" not in out.columns and "PATH" not in out.columns
    check(out, pages.select("*", *[F.lit("").alias(n) for n in URL_NAMES]), url_filter.judge(pages), added)
