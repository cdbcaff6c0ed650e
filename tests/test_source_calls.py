"""The calls of a source tree need no other relation of its graph."""

import os

import pytest

from loomgraph.operators.link import Linker
from loomgraph.plans import generated

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_no_other_relation_is_derived(spark, monkeypatch):
    monkeypatch.setattr(generated, "_BUILT", {})
    derive, asked = Linker.relations, []
    monkeypatch.setattr(Linker, "relations", lambda self: asked.append(1) or derive(self))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(generated.source_calls(spark, SF))
    assert got and not asked
    whole = generated.linked(generated.project(spark, SF), "calls").where("src_kind in ('func', 'method')")  # the same calls in the whole graph
    assert asked == [1]
    assert got == rows(whole.groupBy("src_file", "src_name", "dst_name", "dst_file").agg({"src": "count"}))
