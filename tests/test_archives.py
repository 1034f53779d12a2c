"""Archive names and budgets against plain loops, also for groups that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from atlasweave.operators.archives import archive_budget, download_manifest, unique_entry_names
from atlasweave.operators.sequences import in_order, neighbours, running_total


def named_by_hand(names):
    taken, out = set(), []
    for name in names:
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        entry, n = name, 1
        while entry in taken:
            n += 1
            entry = f"{stem} ({n}){ext}"
        taken.add(entry)
        out.append(entry)
    return out


def entries(spark, archives):
    rows = [(archive, 10 * k, name, k) for archive, names in archives.items() for k, name in enumerate(names)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "archive string, seq long, name string, entry_no int")


def test_names_with_literal_numbers(spark):
    rng, archives = random.Random(11), {}
    shapes = ["a.png", "a (2).png", "a (3).png", "a (2) (2).png", "a (2) (3).png", "a (02).png", "a (1).png", "b", "b (2)", ".x", ".x (2)", "c.d (2)", "c.d", "", " (2)", " (2).png"]
    for k in range(40):
        few = rng.sample(shapes, rng.randint(1, 6))
        archives[f"z{k}"] = [rng.choice(few) for _ in range(rng.randint(1, 40))]
    archives[None] = ["a.png", "a (2).png", "a.png", "a.png"]
    archives["late"] = ["a.png", "a.png", "a.png", "a (2).png", "a (3).png", "a (2).png"]
    got = {(r.archive, r.seq): r.entry for r in unique_entry_names(entries(spark, archives), ["archive"]).collect()}
    want = {(archive, 10 * k): name for archive, names in archives.items() for k, name in enumerate(named_by_hand(names))}
    assert got == want


def test_one_name_a_hundred_thousand_times(spark):
    n = 100_000
    frame = spark.range(n).selectExpr("'z' AS archive", "id AS seq", "CASE WHEN id = 50 THEN 'a (20).kml' WHEN id = 90000 THEN 'a (7).kml' ELSE 'a.kml' END AS name")
    got = {r.seq: r.entry for r in unique_entry_names(frame, ["archive"]).where("seq in (0, 18, 19, 20, 49, 50, 51, 90000, 99999)").collect()}
    # number 20 is used by turn 19 before its literal comes; the literals are numbered themselves
    assert got[0] == "a.kml" and got[18] == "a (19).kml" and got[19] == "a (20).kml" and got[49] == "a (50).kml"
    assert got[50] == "a (20) (2).kml" and got[51] == "a (51).kml" and got[90000] == "a (7) (2).kml" and got[99999] == f"a ({n - 2}).kml"


def test_names_of_nothing_and_null_names(spark):
    frame = entries(spark, {"z": ["a", None, None, "a"]})
    assert {(r.seq, r.entry) for r in unique_entry_names(frame, ["archive"]).collect()} == {(0, "a"), (10, None), (20, None), (30, "a (2)")}
    assert unique_entry_names(frame.limit(0), ["archive"]).collect() == []


def fitted_by_hand(sizes, most, largest):
    total, out = 0, []
    for size in sizes:
        if size is None:
            note = "skipped: request failed"
        elif size > largest:
            note = f"skipped: larger than the {largest // 1024 // 1024} MB per-file limit"
        elif total + size > most:
            note = "skipped: the archive reached its total size limit"
        else:
            note, total = "included", total + size
        out.append((note, total))
    return out


@pytest.mark.parametrize("most", [1, 1000])
def test_budget_is_the_greedy_fit(spark, most):
    rng, rows, want = random.Random(most), [], {}
    for archive in [None, *"abcdefgh"]:
        sizes = [rng.choice([None, 0, 1, 2, rng.randint(0, 60), rng.randint(0, 400), 10**9]) for _ in range(rng.randint(1, 120))]
        rows += [(archive, k, size, "x") for k, size in enumerate(sizes)]
        fitted = fitted_by_hand(sizes, most, 500)
        included = sum(note == "included" for note, _ in fitted)
        want |= {(archive, k): (*one, included, len(sizes), fitted[-1][1]) for k, one in enumerate(fitted)}
    frame = spark.createDataFrame(rows, "archive string, seq long, bytes long, url string")
    got = archive_budget(frame, ["archive"], max_bytes=most, max_file=500).collect()
    assert {(r.archive, r.seq): (r.note, r.running, r.files_included, r.files_selected, r.total_bytes) for r in got} == want and len(got) == len(rows)
    assert archive_budget(frame.limit(0), ["archive"]).collect() == []


def test_budget_of_many_files_and_a_refusal(spark):
    frame = spark.range(200_000).selectExpr("'z' AS archive", "id AS seq", "id % 97 AS bytes", "cast(id AS string) AS url")
    rows = archive_budget(frame, ["archive"], max_bytes=1_000_000, max_file=90).where("note = 'included'").selectExpr("count(*)", "sum(bytes)", "max(running)", "max(files_included)").collect()[0]
    sizes = fitted_by_hand([k % 97 for k in range(200_000)], 1_000_000, 90)
    assert rows[0] == rows[3] == sum(n == "included" for n, _ in sizes) and rows[1] == rows[2] == sizes[-1][1]
    small = frame.where("seq < 3").unionByName(frame.where("seq < 2").selectExpr("'y' AS archive", "seq", "bytes", "url"))
    refused = archive_budget(small, ["archive"], max_files=2).where("archive = 'z'").collect()
    assert [(r.seq, r.note, r.files_selected) for r in refused] == [(0, "refused: a single download is limited to 2 files", None)]


def test_manifest_names_what_fits(spark):
    rows = [("z", k, f"i{k}", "image", "a.png", "u", "p", None if k == 1 else 5) for k in range(4)]
    frame = spark.createDataFrame(rows, "archive string, seq long, asset_id string, asset_kind string, filename string, url string, source_page string, bytes long")
    assert sorted((r.entry or "", r.status, r.total_bytes) for r in download_manifest(frame, ["archive"]).collect()) == [
        ("", "skipped", 15), ("images/a (2).png", "included", 15), ("images/a (3).png", "included", 15), ("images/a.png", "included", 15)]


def test_totals_and_neighbours_cross_partitions(spark):
    frame = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE 'g' END AS g", "id", "cast(id AS string) AS t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ordered = in_order(frame.repartition(16), ["g"], "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ordered.select("_part").distinct().count() > 1
    totals = {r.id: r.total for r in running_total(ordered, ["g"], F.col("id"), "total").collect()}
    near = {r.id: (r.b, r.f) for r in neighbours(ordered, ["g"], "t", "b", "f").collect()}
    for member in (lambda k: k % 3 == 0, lambda k: k % 3 != 0):
        group, total = [k for k in range(3000) if member(k)], 0
        for before, k, behind in zip([None, *group], group, [*group[1:], None]):
            total += k
            assert totals[k] == total and near[k] == (None if before is None else str(before), None if behind is None else str(behind))
