"""Exports of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import csv_cell


class ExportTooLarge(ValueError):
    """A selection beyond what one export may hold."""


def export_rows(assets: DataFrame) -> DataFrame:
    """The 14 columns of the CSV export, as typed columns under their published names."""
    values = [
        "filename", "url", "source_page", "width", "height", F.coalesce("mime_type", "extension", F.lit("")),
        F.coalesce("alt_text", F.lit("")), "category", F.array_join("source_types", " + "), "status", "file_size",
        "page_count", "reference_count", F.coalesce("duplicate_of", F.lit("")),
    ]
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    return assets.select("seq", *[c.alias(name) for c, name in zip(columns, K.CSV_HEADER)])


def csv_lines(assets: DataFrame) -> DataFrame:
    """Each asset as one RFC 4180 line."""
    rows = export_rows(assets)
    cells = [F.coalesce(csv_cell(F.col(f"`{name}`").cast("string")), F.lit("")) for name in K.CSV_HEADER]
    return rows.select("seq", F.array_join(F.array(*cells), ",").alias("line"))


def write_csv(assets: DataFrame, path: str) -> None:
    """CSV files in discovery order, with quotes doubled and CRLF line ends."""
    rows = export_rows(assets).orderBy("seq").drop("seq")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").option(
        "emptyValue", ""
    ).csv(path)


def json_records(assets: DataFrame, references: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """Each asset as one JSON object, with its references nested in it, at most ``keep`` of them if that is given.

    A nested list is one value: with ``keep`` it is cut before it is collected, so that a logo of every page stays small;
    ``reference_count`` tells the exact number in any case.
    """
    if references is not None:
        fields = ["source_page", "source_type", "descriptor", "element_path"]
        if keep is not None:
            order = Window.partitionBy("asset_id").orderBy(*fields)
            references = references.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep)
        nested = references.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("references"))
        assets = assets.join(nested, "asset_id", "left")
    fields = [c for c in assets.columns]
    return assets.select("asset_id", F.to_json(F.struct(*fields)).alias("value"))


def export_manifest(assets: DataFrame, scan_url: str, exported_at: str) -> DataFrame:
    """The envelope of a JSON export: one row per scan."""
    return assets.groupBy("scan_id").agg(F.count(F.lit(1)).alias("image_count")).select(
        F.lit("atlasweave").alias("tool"), F.lit(exported_at).alias("exported_at"), "scan_id", F.lit(scan_url).alias("scanned_url"),
        "image_count", F.lit(K.EXPORT_NOTICE).alias("notice"),
    )


def write_json(assets: DataFrame, path: str, scan_url: str, exported_at: str, references: DataFrame | None = None) -> None:
    """Records as JSON lines under ``path/images`` and the envelope under ``path/manifest``."""
    json_records(assets, references).select("value").write.mode("overwrite").text(f"{path}/images")
    export_manifest(assets, scan_url, exported_at).write.mode("overwrite").json(f"{path}/manifest")


def text_lines(assets: DataFrame) -> DataFrame:
    return assets.orderBy("seq").select(F.col("url").alias("value"))


def write_text(assets: DataFrame, path: str) -> None:
    """One URL per line, in discovery order."""
    text_lines(assets).write.mode("overwrite").text(path)


def within_export_limit(rows: DataFrame, limit: int = K.MAX_EXPORT_RECORDS) -> DataFrame:
    """Refuse a selection above ``limit``; reads no more than one row beyond it."""
    found = rows.limit(limit + 1).count()
    if found > limit:
        raise ExportTooLarge(f"A single export is limited to {limit} records.")
    return rows


def export_caps(rows: DataFrame, group: list[str]) -> DataFrame:
    """Whether each group stays within the record, file and entry limits of one export."""
    sized = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("selected"))
    return sized.withColumns(
        {
            "records_ok": F.col("selected") <= K.MAX_EXPORT_RECORDS,
            "files_ok": F.col("selected") <= K.MAX_ARCHIVE_FILES,
            "entries_ok": F.col("selected") * 2 + 1 <= K.MAX_ARCHIVE_ENTRIES,
        }
    )
