import textwrap

from loomgraph.llm import license_scan

from .test_text_operators import documents

S = license_scan.SENTENCES


def wrapped(text, mark="", width=72):
    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
    return "\n".join((mark + line).rstrip() for line in lines)


def test_wrapped_notices(spark):
    mit = f"MIT License\n\nCopyright (c) 2020 A. Body\n\n{S[12]}\n\n{S[13]}.\n\n{S[14]}."
    apache = f"{S[3]}. {S[4]}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{S[5]}. {S[6]}."
    bsd = f"{S[40]}\n\n1. {S[41]}.\n\n2. {S[42]}.\n\n3. {S[43]}."
    gpl = f"{S[21]}.\n\n{S[23]}. {S[24]}."
    marks = ["", "# ", " * ", "// "]
    texts = [wrapped(t, m, w) for t in (mit, apache, bsd, gpl) for m in marks for w in (40, 72)]
    texts += ["# Copyright 2020 A\n" + wrapped(apache, "# "), wrapped(mit).replace("\n", "\r\n"), f"{S[4][:20]}\n\n{S[4][20:]}", "Licensed under the\nMIT License\nfor you"]
    assert not any(set(S[n] for n in (5, 12, 21, 42)) & set(t.split("\n")) for t in texts)
    out = license_scan.scan(documents(spark, texts)).orderBy("doc_id").collect()
    runs = [("MIT", [12, 13, 14]), ("Apache-2.0", [3, 4, 5, 6]), ("BSD-3-Clause", [40, 41, 42, 43]), ("GPL-3.0-or-later", [21, 23, 24])]
    want = [r for r in runs for _ in range(8)] + [runs[1], runs[0], (None, []), ("MIT", [11])]
    assert [(r.license, list(r.sentence_ids)) for r in out] == want


def test_sentences_with_a_stop_inside(spark):
    mpl = f"{S[50]}. {S[53]}."
    texts = [mpl, wrapped(mpl, " * "), wrapped(mpl, "# ", 30), mpl.replace("v. 2.0", "v. 1.1"), mpl.replace("v. 2.0", "v. 3.0"), mpl.replace("v. 2.0", "v.\n2.0"), wrapped(f"{S[54]}.", "// ")]
    out = license_scan.scan(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.license, list(r.sentence_ids)) for r in out] == [("MPL-2.0", [50, 53])] * 3 + [("MPL-1.1", [55, 53]), (None, [53]), ("MPL-2.0", [50, 53]), ("MPL-1.1", [54])]


def test_long_repeated_and_marked_texts(spark):
    long = "word, and more. " * 200_000 + S[11] + "."
    rows = [(1, long), (1, long), (2, f"a\u0001{S[11]}."), (2, f"\u0002{S[11]}\u0001."), (None, S[11])]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.license for r in out] == ["MIT", "MIT", None, "MIT", "MIT"] and out[0].n_sentences == 200_001
