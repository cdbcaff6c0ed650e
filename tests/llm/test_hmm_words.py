"""The whole query of the language model, recomputed plainly: classes, Baum-Welch, emissions by word, forward recursion."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from loomgraph.llm import hmm_lm

from .test_text_operators import EDGE, WORDS, documents


def plainly(texts, held, k, rounds, own, dictionary):
    words = [hmm_lm.tokens(t.encode() if t else None) for t in texts]
    learn = [w for w, h in zip(words, held) if not h]
    counts = Counter(w for ws in learn for w in ws)
    ranked = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))
    ending = lambda w: 1 + own + crc32(w[-2:]) % hmm_lm.ENDINGS
    cls = lambda w: 0 if not w else 1 + ranked[:own].index(w) if w in ranked[:own] else ending(w)
    n_classes = 1 + own + hmm_lm.ENDINGS
    mass, distinct = np.zeros(n_classes), np.zeros(n_classes)
    mass[1 + own :], distinct[1 + own :] = 0.5, 1
    for w, c in counts.items():
        mass[cls(w)] += c + 0.5
        distinct[cls(w)] += 1
    model = hmm_lm.Hmm.fresh(mass, k)

    def shares(model, seq):
        alphas, betas = [model.start * model.emit[seq[0]]], [np.ones(k)]
        for g in seq[1:]:
            a = (alphas[-1] @ model.move) * model.emit[g]
            alphas.append(a / a.sum())
        for g in seq[:0:-1]:
            b = model.move @ (model.emit[g] * betas[-1])
            betas.append(b / b.sum())
        betas.reverse()
        moves = np.zeros((k, k))
        for a, b, g in zip(alphas, betas[1:], seq[1:]):
            m = a[:, None] * model.move * (model.emit[g] * b)
            moves += m / m.sum()
        got = np.array(alphas) * np.array(betas)
        return got / got.sum(1, keepdims=True), moves

    for _ in range(rounds):
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((n_classes, k))
        for ws in learn:
            seq = [cls(w) for w in ws]
            got, m = shares(model, seq)
            starts, moves = starts + got[0], moves + m
            np.add.at(emits, seq, got)
        model = hmm_lm.Hmm.from_counts(starts, moves, emits, mass)
    by_word, by_class, starts, moves = {}, np.zeros((n_classes, k)), np.full(k, 0.1), np.full((k, k), 0.1)
    for ws in learn:
        got, m = shares(model, [cls(w) for w in ws])
        starts, moves = starts + got[0], moves + m
        for w, s in zip(ws, got):
            by_word[w] = by_word.get(w, 0) + s
            by_class[cls(w)] += s
    total = by_class.sum(1, keepdims=True)
    share = np.where(total > 0, by_class / np.where(total > 0, total, 1), 1 / k)
    norm = by_class.sum(0) + 0.5 * (share * distinct[:, None]).sum(0)
    out, start, move = [], starts / starts.sum(), moves / moves.sum(1, keepdims=True)
    for ws in words:
        e = [(by_word.get(w, 0) + 0.5 * share[cls(w)]) / norm for w in ws]
        a, logs = start * e[0], 0.0
        for x in e[1:]:
            logs, a = logs + np.log10(a.sum()), a / a.sum()
            a = (a @ move) * x
        out.append(logs + np.log10(a.sum()))
    return out


@pytest.mark.parametrize("own,dictionary", [(4, 8), (6, 1000)])
def test_scores_against_a_plain_recomputation(spark, own, dictionary):
    rng = random.Random(41)
    texts = [" ".join(rng.choice(WORDS[:8] if i % 2 else WORDS[8:]) + rng.choice(["", "", "s", str(i % 3)]) for _ in range(rng.randrange(1, 40))) for i in range(120)]
    texts += [e for e in EDGE if e is None or len(e) < 2000] + [texts[3], texts[3]]
    held = [i % 5 == 1 for i in range(len(texts))]
    docs = documents(spark, texts)
    out = {r.doc_id: r.score for r in hmm_lm.score(docs, docs["doc_id"] % 5 == 1, states=3, rounds=3, own=own, dictionary=dictionary).collect()}
    for i, want in enumerate(plainly(texts, held, 3, 3, own, dictionary)):
        assert abs(out[i] - want) < 2e-4 * max(1, abs(want)), (i, out[i], want)


def test_partitions_and_stretches_do_not_matter(spark, monkeypatch):
    rng = random.Random(42)
    docs = documents(spark, [" ".join(rng.choice(WORDS) + rng.choice(["", "a", "ing"]) for _ in range(rng.randrange(1, 900))) for _ in range(80)])
    held = docs["doc_id"] % 5 == 1
    one, two = ({r.doc_id: r.score for r in hmm_lm.score(docs.repartition(n), held, rounds=4, own=10, dictionary=30).collect()} for n in (2, 7))
    assert max(abs(one[i] - two[i]) for i in one) < 1e-6
    seqs = [rng.choices(range(6), k=n) for n in (1, 700, 2000, 2001, 5)]
    seqs = [np.array(s, np.uint16) for s in seqs]
    gen = np.random.default_rng(1)
    model = hmm_lm.Hmm(gen.dirichlet(np.ones(3)), gen.dirichlet(np.ones(3), 3), gen.dirichlet(np.ones(6), 3).T.copy())
    whole, logs = model.expected(seqs), model.log10_likelihood(seqs)
    shares = dict(model.state_shares(seqs))
    monkeypatch.setattr(hmm_lm, "BATCH", 100)
    cut = model.expected(seqs)
    assert all(np.allclose(a, b, rtol=1e-10) for a, b in zip(whole, cut)) and np.allclose(logs, model.log10_likelihood(seqs))
    assert all(np.allclose(a, b) for a, b in ((shares[i], x) for i, x in model.state_shares(seqs)))
    assert abs(whole[2].sum() - sum(map(len, seqs))) < 1e-6 and abs(whole[3] - logs.sum()) < 1e-6
