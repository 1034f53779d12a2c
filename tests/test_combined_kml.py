"""Combined documents: the files of a large one are its text, cut anywhere."""

from pathlib import Path

from pyspark.sql import functions as F

from atlasweave.operators import kml as KML


def placed(spark, n=400):
    trail = "CASE WHEN id % 3 = 0 THEN array('India', 'Gujarat', concat('V', id % 7)) WHEN id % 3 = 1 THEN array('India', 'Gujarat') ELSE array('India', 'Kerala & Co', 'x') END"
    return spark.range(n).selectExpr("CASE WHEN id % 10 = 0 THEN 'small' ELSE 'large' END AS map_id", f"{trail} AS trail", "id AS ord", "concat('    <Placemark><name>', id, '</name></Placemark>') AS placemark").repartition(16)


def test_files_joined_are_the_document(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        name = F.concat("map_id", F.lit(" <maps>"))
        whole = {r.map_id: r.kml for r in KML.combined_documents(placed(spark), "map_id", name).collect()}
        KML.write_combined(placed(spark), "map_id", name, str(tmp_path / "kml"))
        for document, text in whole.items():
            files = sorted(Path(tmp_path / "kml" / f"map_id={document}").glob("part-*"))
            assert "".join(f.read_text() for f in files) == text
            if document == "large":
                assert len(files) > 1
        assert whole["large"].count("<Placemark>") == 360 and whole["large"].count("<Folder>") == whole["large"].count("</Folder>")
        assert whole["large"].count("<name>India</name>") == whole["large"].count("<name>Gujarat</name>") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_every_attribute_is_written(spark):
    frame = spark.sql(
        "SELECT 'f' AS name, 'd' AS description, 'Point' AS geometry_type, array(array(array(named_struct('lon', 1D, 'lat', 2D, 'alt', CAST(NULL AS DOUBLE))))) AS parts, "
        "transform(sequence(1, 55), k -> named_struct('key', concat('k', k), 'value', 'v')) AS entries, 'EPSG:4326' AS source_crs, false AS transformed, 'high' AS confidence"
    )
    rows = KML.placemarks(frame).collect()
    assert rows and all(f'<Data name="k{k}">' in rows[0].placemark for k in range(1, 56))
