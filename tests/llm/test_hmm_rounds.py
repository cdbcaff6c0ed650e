import random

from loomgraph.llm import hmm_lm

from .test_text_operators import WORDS, documents


def test_every_round_sees_all_training_texts(spark, monkeypatch):
    rng = random.Random(31)
    docs = documents(spark, [" ".join(rng.choice(WORDS) for _ in range(4)) for _ in range(7000)])
    plain, seen = hmm_lm.baum_welch_round, []

    def counted(model, seqs, mass):
        seen.append(seqs.count())
        return plain(model, seqs, mass)

    monkeypatch.setattr(hmm_lm, "baum_welch_round", counted)
    assert hmm_lm.score(docs, docs["doc_id"] % 7 == 1, states=2).count() == 7000
    assert len(seen) == hmm_lm.ROUNDS and set(seen) == {6000}
