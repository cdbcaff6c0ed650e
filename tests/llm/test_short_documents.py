import random

from loomgraph.llm import decontaminate

from .test_text_operators import documents, prose


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(41)
    item = prose(rng, 100)
    words = item.split()
    texts = [" ".join(words[:95]), " ".join(words[5:]), " ".join(words[:81]), " ".join(words[:80]), " ".join(words[:4]), " ".join([*words[:40], "zz", *words[40:90]]), item]
    bench = spark.createDataFrame([(7, item), (8, prose(rng, 97))], "item_id long, text string")
    docs = documents(spark, texts)
    got = {r.doc_id: (r.item_id, r.start_word, r.n_words, round(r.similarity, 6)) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {0: (7, 0, 95, round(91 / 96, 6)), 1: (7, 0, 95, round(91 / 96, 6)), 2: (7, 0, 81, round(77 / 96, 6)), 5: (7, 0, 91, round(82 / 101, 6)), 6: (7, 0, 100, 1.0)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {3, 4}
