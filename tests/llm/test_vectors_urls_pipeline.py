import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from loomgraph.llm import topk_search, url_filter

from .test_text_operators import DOCS, WORDS, classes, fingerprint_by_hand, lines_by_brute_force, prose, windows_by_brute_force


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 24 if i % 7 else 9), 2)], i) for i in range(400)]
    rows += [(500, None, 1), (501, [0.1, None], 1), (502, [float("nan")], 1), (503, [float("inf")], 1), (None, [1.0] * 24, 1), (504, [], 1), (20, rows[20][1], 5), (40, rows[41][1], 5), (520, [], 1)]
    rows += [(600 + i, [0.5] * 24, 1) for i in range(30)]
    rows += [(701, [1e18, 0.0, -0.25], 1), (702, [0.0, 1e30], 1), (720, [0.0, 3e18, 1.5], 1), (740, [1e6] * 24, 1)]  # beyond what a long, or a double's sum, holds
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    vectors = topk_search.quantized(df)
    fine = [(i, [int(x) for x in np.floor(64 * np.array(v, np.float32).astype(np.float64))]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, qv) in enumerate(fine):
        if q % 20 == 0:
            got = sorted((-sum(a * b for a, b in zip(qv, v)), i) for n, (i, v) in enumerate(fine) if n != at)[:20]
            want += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(got, 1)]
    for per_pass in (16384, 5):
        out = topk_search.top_k(vectors.repartition(3), vectors.where("vec_id % 20 = 0"), queries_per_pass=per_pass).collect()
        assert sorted(map(tuple, out)) == sorted(want)
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk_search.top_k(vectors.where("vec_id < 5"), vectors.where("vec_id < 2")).count() == 8


def test_bounds_prune_without_loss():
    rng = np.random.default_rng(4)
    c = rng.integers(-60, 60, (5000, 64)) * (rng.random((5000, 1)) ** 4 * 3).astype(int)
    q = c[:20]
    none = np.zeros(0, np.int64)
    best = [(none, none)] * 20
    seeds = topk_search._seeds(q.astype(float), c[:300].astype(float), 21)
    for lo in range(0, 5000, 700):
        topk_search.search_block(np.arange(20), q, np.arange(lo, min(5000, lo + 700)), c[lo : lo + 700], 21, best, seeds=seeds)
    for i in range(20):
        want = sorted((-int(s), j) for j, s in enumerate(c @ q[i]))[:21]
        assert [(-int(s), int(j)) for s, j in zip(*best[i])] == want


URLS = ["http://A.Example.NET/en/1?x=1#y", "https://example.com/de/2", "https://www.example.com/fr/2", "http://x.org/fr/", "http://x.org/en/1.html", "no scheme", None, "", "http://net", "http://net/", "ftp://example.net?/en/", "http://badexample.net/x", "http://h/a://b/c", "//net/x"]


def test_url_parts_and_rules(spark):
    rows = [(i, u, 1) for i, u in enumerate(URLS)] + [(0, URLS[0], 2), (None, URLS[1], 3)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()
    assert len(out) == len(rows)
    order = [r for i in range(len(URLS)) for r in out if r.page_id == i][1:]
    got = [(r.host, r.path, r.rule) for r in order]
    want = []
    for u in URLS:
        m = re.search("://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [h + p for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((host, path, max(fits, key=len, default=None)))
    assert got == want
    verdicts = {h + p: v for v, h, p in url_filter.RULES}
    assert all(r.verdict == verdicts[r.rule] for r in out if r.rule)
    assert {r.verdict for r in out if not r.host} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['a', 'b', 'www.c'])}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(99)}{rng.choice(['', '.html', '?q=1'])}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    seen = url_filter.tokens(url_filter.apply_rules(url_filter.split_url(pages))).collect()
    baskets = [(frozenset(r["items"]), r.rule_verdict) for r in seen if r.rule]
    from itertools import combinations

    counts, with_label = Counter(), Counter()
    for items, label in baskets:
        for k in range(1, len(items) + 1):
            for part in combinations(sorted(items), k):
                counts[part] += 1
                with_label[part, label] += 1
    least = url_filter.MIN_SUPPORT * len(baskets)
    rules = [(n / counts[p], n / len(baskets), v, set(p)) for (p, v), n in with_label.items() if n >= least and n / counts[p] >= url_filter.MIN_CONFIDENCE]
    for r in url_filter.judge(pages).collect():
        if r.rule is None:
            items = set(next(x["items"] for x in seen if x.page_id == r.page_id))
            fired = max(((round(c, 9), round(s, 9), v) for c, s, v, p in rules if p <= items), default=None)
            assert r.verdict == (fired[2] if fired else "allow")


def test_every_part_of_a_url_is_mined(spark):
    """Tokens past the ninth, long ones that differ late, and templates of many parts that always come together."""
    many = "/".join(f"s{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26))
    long = "x" * 200
    urls = []
    for i in range(60):
        urls += [f"http://m.win{'y' if i % 2 else 'z'}.casino.shop.net/{many}/{i}?a=1&b={i}", f"http://m.good.example.net/en/{many}?a=1&good={i}"]
        urls += [f"http://a.net/{long}bad", f"http://a.example.net/en/{long}good"]
    urls += ["http://q.com/?u=1&good=7", f"http://casino.io/{many}", f"http://x.com/{long}bad", f"http://x.com/{long}good", "http://m.winy.q.io/", "http://b.com/" + "?" + "&".join(f"k{i}=v" for i in range(500))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.url: r.verdict for r in url_filter.judge(pages.unionAll(pages)).collect()}
    assert [out[u] for u in urls[-6:]] == ["allow", out[f"http://casino.io/{many}"], "block", "allow", "block", "allow"]
    assert out[urls[0]] == "block" and out[urls[1]] == "allow"


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    items = [prose(rng, 30) for _ in range(4)]
    texts = []
    for i in range(150):
        paragraphs = [prose(rng, rng.randrange(20, 90)).capitalize() + "." for _ in range(rng.randrange(1, 4))]
        if i % 11 == 0:
            paragraphs.append(items[i % 4])
        if i % 7 == 0:
            paragraphs.append("All of this was said before, and here it is said again.")
        if i % 9 == 0 and texts:
            paragraphs = [texts[rng.randrange(len(texts)) // 6 * 6 + 1 if len(texts) > 6 else 1]]
        if i % 6 == 0:
            paragraphs = [" | ".join(rng.choice(WORDS) for _ in range(60))]
        texts.append("\n".join(paragraphs))
    texts += [None, ""]
    rows = [(i, t, "en", rng.choice(["a", "b", "c"]), len(t) if t else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]
    now = {i: t for i, t, *_ in rows}
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        got = {r.doc_id: r.text for r in stage.collect()}
        if name.startswith("quality"):
            assert {i for i in got if i < 150} == {i for i in range(150) if i % 6}
            want = {i: t for i, t in now.items() if i in got}
        elif name.startswith("line"):
            gone = lines_by_brute_force(sorted(now.items()), 2, 20)
            want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in now.items()}
            want = {i: t for i, t in want.items() if not gone[i] or t.split()}
        elif name.startswith("SimHash"):
            ids = sorted(now)
            prints = [fingerprint_by_hand(now[i]) for i in ids]
            roots = classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2])
            want = {ids[r]: now[ids[r]] for r in set(roots)}
        else:
            want = {i: t for i, t in now.items() if not any(windows_by_brute_force(t, x) for x in items)}
        assert got == want, name
        now = want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(now) and all(r.size == len((now[r.doc_id] or "").split()) for r in out)
