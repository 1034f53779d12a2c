"""Image links beyond the twelve of a parcel's page."""

from atlasweave.operators.links import parcel_images


def test_every_link_comes_without_a_limit(spark):
    page, n = "https://s.test/p", 40
    images = spark.createDataFrame([(f"a{k}", k, f"https://s.test/i{k}.png", f"plan-{k}.png" if k % 2 else f"k7-{k}.png", None, None, page, 10 + k, 10) for k in range(n)],
        "asset_id string, seq int, url string, filename string, alt_text string, title string, source_page string, width int, height int")
    on_page = spark.createDataFrame([(page, f"a{k}") for k in range(n)] * 2, "source_page string, asset_id string")
    parcels = spark.createDataFrame([("x", "m", page, "plan 12", "Site", ["North"]), ("y", "m", page, None, "Other", [])], "parcel_id string, map_id string, source_page string, reference string, name string, folder_path array<string>")
    overlays = spark.createDataFrame([("m", page, "i39.png", 0)], "map_id string, source_page string, href string, ord int")
    every = parcel_images(parcels, images, on_page, overlays, most=None).collect()
    assert len(every) == 2 * n and len({(r.parcel_id, r.asset_id) for r in every}) == 2 * n  # each pair once
    kinds = lambda p: sorted((r.confidence for r in every if r.parcel_id == p))
    # the overlay's own image for both; for x also every image that says "plan"
    assert kinds("x") == ["probable"] * 19 + ["unverified"] * 20 + ["verified"]
    assert kinds("y") == ["unverified"] * 39 + ["verified"]
    few = parcel_images(parcels, images, on_page, overlays).collect()
    assert sorted(r.rank for r in few if r.parcel_id == "x") == list(range(1, 13))
    best = sorted((r for r in few if r.parcel_id == "x"), key=lambda r: r.rank)
    assert [r.asset_id for r in best[:3]] == ["a39", "a37", "a35"]
    assert parcel_images(parcels, images.limit(0), on_page, overlays, most=None).count() == 0
