"""Lookups answer for every asset, not for one of them."""

import __spark_entry__ as entry
from atlasweave.operators import assets as A
from atlasweave.views import view

SF = "/root/testdata/sf0.001"


def test_every_asset_is_found_by_its_id_with_all_its_references(spark):
    found = entry.queries()["asset_by_id"](spark, SF).groupBy("asset_id").sum("n").collect()
    refs = A.identified_refs(view(spark, SF, "v_refs"))
    assets = A.consolidate_assets(refs).select("asset_id", "scan_id", "canonical_url")
    known = assets.join(refs, ["scan_id", "canonical_url"]).groupBy("asset_id").count().collect()
    assert len(known) > 1
    assert dict(map(tuple, found)) == dict(map(tuple, known))
