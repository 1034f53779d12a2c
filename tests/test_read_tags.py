"""Queries of some reference types read no other tags."""

import pytest

import __spark_entry__ as entry
from atlasweave.operators import references as R
from atlasweave.views import view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, types", [("ref_dimensions", {"img", "srcset"})])
def test_other_types_are_not_read(spark, monkeypatch, name, types):
    asked = []
    scan = R.scan_references
    monkeypatch.setattr(R, "scan_references", lambda pages, sources=None: asked.append(sources) or scan(pages, sources))
    got = entry.queries()[name](spark, SF)
    assert [set(a or []) for a in asked] == [types]
    every = scan(view(spark, SF, "v_html")).filter("declared_width is not null and not geo").filter(f"source_type in {tuple(types)}")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, every.select(got.columns).collect()), key=repr)
