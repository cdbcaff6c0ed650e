"""Operators on documents against brute-force versions and edge cases."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomgraph.llm import decontaminate, hmm_lm, license_scan, line_dedup, quality_knn, simhash_dedup, source_mix, token_counts
from loomgraph.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "stone river cloud maple ember quartz violet harbor lantern meadow copper falcon thistle marble saffron willow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % (len(sources) if sources else 3)], len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", "   \n\t ", "one", "one two", "é" * 50, "Ünïcode wörds 日本語 テキスト", "a " * 30_000, "x" * 100_000]


def classes(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


# components


def test_components_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((30, 10), (60, 50), (40, 200), (50, 49)):
        pairs = [(i, i + 1) for i in range(n - 1)] if m == 49 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
        want = classes(n, pairs)
        assert dict((r.id, r.root) for r in got) == {i: want[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
        assert len(got) == len({r.id for r in got})


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


# token counts


def test_edits_equal_full_encoding():
    rng = random.Random(2)
    counter = token_counts.Counter(token_counts.VOCABULARY)
    full = token_counts.encoding().encode_ordinary
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\n\n", "'s", "'re", "1", "23", "!!", "日本", "\t", "don't", " word", "."]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 5, 60, 900))))
        chars, tokens, _ = token_counts.leaves_of(counter, text)
        tree = token_counts.Tree(chars, tokens)
        assert tree.total == len(full(text))
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(4)) // 2 * 2))
            edits = [(a, b, "".join(rng.choice(alphabet) for _ in range(rng.randrange(4)))) for a, b in zip(cuts[::2], cuts[1::2])]
            new, tree, redone = token_counts.edit(counter, text, tree, edits)
            want = text
            for a, b, put in reversed(edits):
                want = want[:a] + put + want[b:]
            assert new == want and tree.total == len(full(new)) and sum(tree.leaves()[0]) == len(new) and redone <= len(new)
            text = new


def test_edits_touch_little():
    counter = token_counts.Counter(token_counts.VOCABULARY)
    text = prose(random.Random(3), 20_000)
    chars, tokens, _ = token_counts.leaves_of(counter, text)
    *_, redone = token_counts.edit(counter, text, token_counts.Tree(chars, tokens), [(50_000, 50_004, "else")])
    assert 0 < redone < 1000
    new, tree, _ = token_counts.edit(counter, text, token_counts.Tree(chars, tokens), [(5, 9, "x"), (7, 12, "y"), (8, 3, "z"), (10, 11, "")])  # overlapping, turned round, swallowed
    assert new == text[:5] + "xyz" + text[12:] and tree.total == len(token_counts.encoding().encode_ordinary(new))


def test_edits_keep_the_tree(monkeypatch):
    """Small edits update paths of the same tree, even if leaves come and go; a large insertion builds it anew."""
    counter = token_counts.Counter(token_counts.VOCABULARY)
    text = prose(random.Random(3), 5000)
    chars, tokens, _ = token_counts.leaves_of(counter, text)
    tree = token_counts.Tree(chars, tokens)
    touched = []
    plain = token_counts.Tree.update
    monkeypatch.setattr(token_counts.Tree, "update", lambda self, *a: (touched.append(a[0]), plain(self, *a)))
    new, same, _ = token_counts.edit(counter, text, tree, [(100, 1500, ""), (9000, 9001, "a few more words here")])
    assert same is tree and len(touched) < 20 and tree.total == len(token_counts.encoding().encode_ordinary(new))
    new, other, _ = token_counts.edit(counter, new, tree, [(50, 50, "many words " * 2000)])
    assert other is not tree and other.total == len(token_counts.encoding().encode_ordinary(new))


def test_token_count_frames(spark):
    texts = [*EDGE, "key " + "0123456789abcdef" * 3 + " at 10.0.0.1, a.b@c.org"]
    docs = documents(spark, texts).selectExpr("*", "1L as n_tokens", "'x' as leaf_chars")
    out = token_counts.apply_edits(token_counts.build_trees(docs)).orderBy("doc_id").collect()
    full = token_counts.encoding().encode_ordinary
    assert [r.n_tokens for r in out] == [len(full(t or "")) for t in texts]
    assert [r.edited_tokens for r in out] == [len(full(r.text)) for r in out]
    assert out[-1].text == "key <key> at <ip>, <mail>" and out[-1].n_edits == 3
    own = documents(spark, ["one two", None, "abc"]).selectExpr("*", "array(named_struct('start', 1, 'stop', 100, 'insert', 'zz')) as e")
    out = token_counts.apply_edits(token_counts.build_trees(own), edits_col="e").orderBy("doc_id").collect()
    assert [r.text for r in out] == ["ozz", "zz", "azz"] and "e" not in out[0]
    assert token_counts.apply_edits(token_counts.build_trees(documents(spark, []))).count() == 0


# licences


def test_license_rules(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n http://x\n"
    texts = ["Hello there. Licensed under CC BY-NC 4.0.\nBye", apache, "LICENSED UNDER THE MIT LICENSE! yes", "Licensed under the Apache License", None, "", "Released under the MIT License.\nLicensed under CC BY 4.0",
             license_scan.SENTENCES[12] + "\n\n" + license_scan.SENTENCES[13] + ".\nnoise\n" + license_scan.SENTENCES[14] + "."]
    docs = documents(spark, texts).selectExpr("*", "'q' as license")
    out = license_scan.scan(docs).orderBy("doc_id").collect()
    assert [r.license for r in out] == ["CC-BY-NC-4.0", "Apache-2.0", "MIT", None, None, None, "MIT", "MIT"]
    assert [list(r.sentence_ids) for r in out] == [[30], [3, 4], [11], [], [], [], [10, 31], [12, 13, 14]]
    assert list(out[6].matches) == ["MIT", "CC-BY-4.0"] and out[4].n_sentences == 0
    assert license_scan.scan(documents(spark, [])).count() == 0


def test_every_known_sentence_is_met(spark):
    docs = documents(spark, [s + "." for s in license_scan.SENTENCES.values()])
    got = license_scan.scan(docs).orderBy("doc_id").collect()
    assert [list(r.sentence_ids)[:1] for r in got] == [[n] for n in license_scan.SENTENCES]


# quality


def test_quality_held_out(spark):
    rng = random.Random(4)
    bad = [lambda: " | ".join(rng.choice(WORDS) for _ in range(60)), lambda: " ".join([rng.choice(WORDS)] * 80), lambda: prose(rng, 50).upper().replace(" ", "!! "), lambda: " ".join(w + "$$$" for w in prose(rng, 50).split())]
    texts = [rng.choice(bad)() if i % 3 == 0 else prose(rng, 30 + i % 90).capitalize() + "." for i in range(600)]
    docs = documents(spark, texts).selectExpr("*", "7 as score")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 600, 2)] + [(5, None, 0), (None, 1, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    model = quality_knn.fit(docs, labels)
    out = quality_knn.score(docs, model).orderBy("doc_id").collect()
    held = [r for r in out if r.doc_id % 2]
    assert sum((r.score >= 0.7) == (r.doc_id % 3 != 0) for r in held) / len(held) > 0.98
    again = quality_knn.score(docs.repartition(7), quality_knn.fit(docs.repartition(5), labels)).orderBy("doc_id").collect()
    assert max(abs(a.score - b.score) for a, b in zip(out, again)) < 1e-3
    edge = quality_knn.score(documents(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)


def test_quality_votes_are_exact():
    """Weights, projection and votes against a plain latent semantic analysis; labelled rows that tie for the last places share them."""
    rng = np.random.default_rng(0)
    topics = rng.dirichlet(np.ones(quality_knn.DIMS) * 0.02, 16) * (rng.random((16, quality_knn.DIMS)) < 0.1)
    x = np.sqrt(rng.dirichlet(np.ones(16) * 0.3, 120) @ topics).astype(np.float32)
    x[100:120] = x[0]  # twenty equal ones, with both labels
    y = np.array([0] * 40 + [1] * 80)
    rows = [(np.flatnonzero(r), r[r != 0].astype(np.float64)) for r in x]
    model = quality_knn.Model(rows, y, latent=16, neighbours=7)
    idf = np.log(121 / (1 + (x > 0).sum(0))) + 1
    weighted = x * idf
    weighted /= np.linalg.norm(weighted, axis=1, keepdims=True)
    basis = np.linalg.svd(weighted.astype(np.float64), full_matrices=False)[2][:16].T
    z = (x * idf) @ basis
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cos = np.round(z @ z.T, 5)
    got, turned = model.scores(rows, block=11), model.scores(rows[::-1], block=64)[::-1]
    assert np.abs(got - turned).max() < 1e-9
    share = y.mean()
    for i, row in enumerate(cos):
        last = np.sort(row)[-7]
        sure, tied = row > last, row == last
        seats = sure + tied * (7 - sure.sum()) / tied.sum()
        w = seats * np.exp(quality_knn.SHARPNESS * (row - row.max())) * row.clip(1e-6) * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        assert abs(got[i] - (w * y).sum() / w.sum()) < 0.01, i


def test_quality_repeated_rows_and_empty_table(spark):
    rng = random.Random(4)
    texts = [prose(rng, 40) if i % 2 else "!! ?? " * rng.randrange(3, 30) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)], "doc_id long, quality int")
    docs = documents(spark, texts)
    model = quality_knn.fit(docs, labels)
    out = quality_knn.score(docs.unionAll(docs), model).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(out) == 160 and all(len(s) == 1 for s in by.values())
    assert quality_knn.score(docs.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_knn.score(docs, quality_knn.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert {r.score for r in quality_knn.score(docs, quality_knn.fit(docs, ones)).collect()} == {1.0}


# decontamination


def windows_by_brute_force(text, item):
    words, target = (text or "").lower().encode().split(), item.lower().encode().split()
    bag, best = Counter(decontaminate.shingles(target)), None
    for s in range(len(words) - len(target) + 1):
        sim = decontaminate.weighted_jaccard(Counter(decontaminate.shingles(words[s : s + len(target)])), bag)
        if sim >= 0.8 and (best is None or sim > best[0]):
            best = (sim, s, len(target))
    return best


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(400)]
    run = lambda n: " ".join(rng.choice(many) for _ in range(n))
    items = [run(rng.choice((3, 5, 14, 30, 50))) for _ in range(40)] + ["zz " * 20]
    texts = []
    for i in range(120):
        words = run(rng.randrange(0, 200)).split()
        if i % 2:
            passage = items[i % 41].split()
            for _ in range(rng.randrange(3)):
                passage[rng.choice((0, -1, rng.randrange(len(passage))))] = rng.choice(many)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[: len(passage) - rng.randrange(2)]
        texts.append(" ".join(words).upper() if i % 5 == 0 else "\n".join(words))
    texts += [*EDGE, "zz " * 300]
    want = {(d, k): hit for d, t in enumerate(texts) for k, item in enumerate(items) if (hit := windows_by_brute_force(t, item))}
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " ")], "item_id long, text string").selectExpr("*", "1 as dk", "2 as similarity")
    docs = documents(spark, texts).selectExpr("*", "1 as dk", "'x' as item_id")
    for per_pass in (2048, 9):
        got = decontaminate.contaminated(docs, bench, items_per_pass=per_pass).collect()
        assert {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in got} == want and len(got) == len(want)
    assert len(want) > 30
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


# language model


def test_hmm_scores(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS[:8] if i % 2 else WORDS[8:]) for _ in range(rng.randrange(1, 60))) for i in range(300)] + EDGE
    docs = documents(spark, texts)
    held = docs["doc_id"] % 5 == 1
    out = {r.doc_id: r for r in hmm_lm.score(docs, held, states=3).collect()}
    assert len(out) == len(texts)
    counts = Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in hmm_lm.tokens(t.encode() if t else None))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words = hmm_lm.tokens(t.encode() if t else None)
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert abs(out[i].base_score - base) < 1e-6 * max(1, abs(base))
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens, out[i].held_out) == (len(words), sum(counts[w] > 0 for w in words), n, i % 5 == 1)
    gains = [out[i].score - out[i].base_score for i in range(300) if i % 5 == 1]
    assert np.mean(gains) > 0


def test_hmm_forward_and_counts_against_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    model = hmm_lm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T.copy())
    seqs = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 2, 5, 6, 6)]
    starts, moves, emits, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3)), []
    for seq in seqs:
        paths = {p: model.start[p[0]] * np.prod([model.emit[g, s] for g, s in zip(seq, p)]) * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) for p in product(range(3), repeat=len(seq))}
        whole = sum(paths.values())
        logs.append(np.log10(whole))
        for p, w in paths.items():
            starts[p[0]] += w / whole
            for a, b in zip(p, p[1:]):
                moves[a, b] += w / whole
            for g, s in zip(seq, p):
                emits[g, s] += w / whole
    assert np.allclose(model.log10_likelihood(seqs), logs)
    got = model.expected(seqs)
    assert np.allclose(got[0], starts, atol=1e-4) and np.allclose(got[1], moves, atol=1e-4) and np.allclose(got[2], emits, atol=1e-4) and abs(got[3] - sum(logs)) < 1e-3
    long = rng.integers(0, 6, 20_000).astype(np.uint16)
    one, scaled = model.start * model.emit[long[0]], 0.0
    for g in long[1:]:
        scaled, one = scaled + np.log10(one.sum()), one / one.sum()
        one = (one @ model.move) * model.emit[g]
    assert abs(model.log10_likelihood([long])[0] - (scaled + np.log10(one.sum()))) < 1e-9 * abs(scaled)


def test_hmm_without_training(spark):
    docs = documents(spark, ["a b", None])
    out = hmm_lm.score(docs, docs["doc_id"] >= 0).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in out)
    assert hmm_lm.score(docs.limit(0), docs["doc_id"] >= 0).count() == 0


# mixing


def test_mix_targets(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(900)] + EDGE
    sources = ["big"] * 20 + ["a", "b", "ß", None, "tiny"]
    docs = documents(spark, texts, sources).selectExpr("*", "1 as u", "2 as size", "3 as cell")
    out = source_mix.mix(docs).collect()
    assert len(out) == len(texts)
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
    per, goal = Counter(), {}
    for r in out:
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 3 * r.size
        per[r.source] += r.taken
        goal[r.source] = (r.target, r.source_size)
    assert abs(sum(t for t, _ in goal.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    names = sorted((s for s in goal if s is not None), key=lambda s: s.encode()) + [None]
    level = max((goal[s][0] / (1, 2, 3)[i % 3] for i, s in enumerate(names)))
    for i, s in enumerate(names):
        assert abs(goal[s][0] - min(3 * goal[s][1], level * (1, 2, 3)[i % 3])) < 1e-6 * goal[s][0] + 1e-9
        largest = max(r.size for r in out if r.source == s)
        assert abs(per[s] - goal[s][0]) <= largest
    again = {r.doc_id: r.taken for r in source_mix.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_mix_ties_and_empty(spark):
    rows = [(1, "a b c d", "x")] * 30 + [(2, "p q", "y")] * 10 + [(None, None, None)]
    out = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    per = Counter()
    for r in out:
        assert r.taken <= 3 * r.size
        per[r.source] += r.taken
    assert abs(per["x"] - [r.target for r in out if r.source == "x"][0]) <= 30 and per[None] == 0
    assert source_mix.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    rng = random.Random(8)
    for _ in range(4000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 12)))
        b = bytearray(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            rng.choice((lambda: b.insert(at, rng.choice(b"abc")), lambda: b.__delitem__(slice(at, at + 1)), lambda: b.__setitem__(slice(at, at + 1), bytes([rng.choice(b"abc")]))))()
        for t in (0, 1, 2, 3):
            assert line_dedup.within(a, bytes(b), t) == (distance(a, b) <= t), (a, b, t)


def lines_by_brute_force(docs, threshold, min_bytes):
    """docs: [(id, text)] in order of id -> removed line numbers."""
    places = [(i, n, line) for i, t in docs for n, line in line_dedup.normal_lines(t.encode() if t else None, 1)]
    texts = sorted({line for *_, line in places})
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if min(len(texts[i]), len(texts[j])) >= min_bytes and abs(len(texts[i]) - len(texts[j])) <= threshold and distance(texts[i], texts[j]) <= threshold]
    root = dict(zip(texts, classes(len(texts), pairs)))
    seen, removed = set(), {i: [] for i, _ in docs}
    for i, n, line in places:
        if root[line] in seen:
            removed[i].append(n)
        seen.add(root[line])
    return removed


@pytest.mark.parametrize("group", [1024, 3])
def test_lines_against_brute_force(spark, group, monkeypatch):
    rng = random.Random(9)
    base = [prose(rng, rng.choice((3, 5, 8))) for _ in range(25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["x", "", "é"])
            lines.append("".join(line) if rng.random() < 0.8 else "  " + "".join(line).upper() + " \r")
        texts.append("\n".join([*lines, "short"]))
    texts += EDGE + [None]
    near = line_dedup.near_links
    monkeypatch.setattr(line_dedup, "near_links", lambda rows, t, m: near(rows, t, m, group))
    docs = documents(spark, texts).selectExpr("*", "array(9) as removed", "1 as dk")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    want = lines_by_brute_force(list(enumerate(texts)), line_dedup.THRESHOLD, line_dedup.MIN_BYTES)
    assert {i: list(r.removed) for i, r in out.items()} == want
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
        assert out[i].text == kept and out[i].n_lines == (0 if t is None else t.count("\n") + 1)
    assert sum(map(len, want.values())) > 40


def test_large_groups_and_repeated_rows(spark):
    rng = random.Random(10)
    base = prose(rng, 20)
    lines = sorted({base[:at] + rng.choice("qxz") + base[at + 1 :] for at in range(0, len(base), 2)})
    found = line_dedup.links_in(list(range(len(lines))), [x.encode() for x in lines], [2] * len(lines), 2)
    assert len(set(classes(len(lines), found))) == 1
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (None, base, "en", "a", 1), (2, "zz\n" + base, "en", "a", 1)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id or 0), list(r.removed)) for r in out) == [(0, [0]), (1, []), (1, []), (2, [1])]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# near duplicates


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_all_pairs():
    masks = simhash_dedup.covering_masks(2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            diff = 1 << a | 1 << b
            assert any(not (m & (2**64 - 1)) & diff for m in masks)


@pytest.mark.parametrize("limit", [48, 2])
def test_near_duplicates_against_brute_force(spark, limit):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = prose(rng, 150).split()
        for _ in range(rng.randrange(1, 12)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += EDGE + [texts[0]] * 3
    prints = [fingerprint_by_hand(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    want = classes(len(texts), pairs)
    docs = documents(spark, texts).selectExpr("*", "1 as fp", "2 as component_id")
    out = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs, bucket_limit=limit).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in out.items()} == dict(enumerate(prints))
    assert {i: r.component_id for i, r in out.items()} == dict(enumerate(want))
    kept = simhash_dedup.keep_representatives(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_links_on_dense_fingerprints(spark):
    rng = random.Random(12)
    for radius in (0, 1, 2):
        prints = sorted({rng.getrandbits(64) ^ 0 if i % 10 == 0 else sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for i in range(250)})
        signed = [x - 2**64 if x >= 2**63 else x for x in prints]
        pairs = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= radius]
        place = {x: i for i, x in enumerate(signed)}
        for limit in (1000, 4):
            links = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, limit).collect()
            assert classes(len(prints), [(place[r.u], place[r.v]) for r in links]) == classes(len(prints), pairs)
            assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 2 for r in links)


def test_near_duplicates_null_ids_and_repeats(spark):
    rows = [(None, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (None, "solo words here now", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = sorted(((r.doc_id or 0), r.component_id or 0) for r in simhash_dedup.near_duplicates(docs).collect())
    assert out == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert sorted((r.doc_id or 0) for r in simhash_dedup.keep_representatives(docs).collect()) == [0, 4]
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
