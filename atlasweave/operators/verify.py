"""Assets joined with recorded responses: availability, type, size, hash, messages, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import images as I, labels as L
from ..functions.stages import stage

HTML_MESSAGE = "The server returned an HTML page instead of the data file."
NO_IMAGE_MESSAGE = "The response did not contain data the scanner recognises as an image."
FAILED_MESSAGE = "The request failed for an unknown reason."


def page_outcomes(responses: DataFrame) -> DataFrame:
    """``error``, ``skipped`` or ``ok`` for each fetched page, and whether to extract it."""
    mime = F.lower(F.coalesce("content_type", F.lit("")))
    html = mime.rlike("text/html|application/xhtml|text/plain|application/xml")
    outcome = (
        F.when(F.col("http_status").isNull() | (F.col("http_status") >= 400), "error")
        .when((mime != "") & ~html, "skipped")
        .otherwise("ok")
    )
    error = (
        F.when(F.col("http_status") >= 400, F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
        .when(F.col("http_status").isNull(), "Request failed")
        .when(F.col("outcome") == "skipped", F.concat(F.lit("Not an HTML page ("), F.split_part(mime, F.lit(";"), F.lit(1)), F.lit(")")))
    )
    return stage(responses, outcome=outcome).withColumn("error", error)


def verify_assets(assets: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join of assets and responses by URL, with the verified facts of each asset.

    ``assets`` has url, asset_kind and geo_format; ``responses`` has url, http_status,
    content_type, declared_length, final_url, redirected, truncated, error, width, height,
    body_length, content_hash and sniff (``struct<ok,note>``). An asset without a response
    stays ``unverified``.
    """
    seen = responses.withColumn("_seen", F.lit(True))
    df = assets.join(seen, "url", "left")
    df = stage(df, mime_type=L.base_mime(F.col("content_type")))
    mime, geo = F.col("mime_type"), F.col("asset_kind") == "geo"
    sized = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    is_image = F.when(mime.isNotNull(), mime.rlike("(?i)^image/")).otherwise(sized)
    html, sniffed = mime.startswith("text/html"), F.coalesce("sniff.ok", F.lit(True))
    good = F.when(F.col("redirected"), "redirected").otherwise("available")
    status = (
        F.when(F.col("_seen").isNull(), "unverified")
        .when(F.col("http_status").isNull() | (F.col("http_status") >= 400), "unavailable")
        .when(geo, F.when(F.coalesce(html, F.lit(False)) | ~sniffed, "unsupported").otherwise(good))
        .otherwise(F.when(is_image, good).otherwise("unsupported"))
    )
    df = stage(df, status=status)
    ok = F.col("status").isin("available", "redirected")
    moved = F.when(F.col("redirected"), F.concat(F.lit("Redirected to "), F.col("final_url")))
    unusual = F.when(
        ~mime.rlike(K.GEO_CONTENT_TYPE_REGEX),
        F.concat(F.lit('Served as "'), mime, F.lit('", which is unusual for '), F.upper("geo_format"), F.lit(".")),
    )
    notes = F.nullif(F.concat_ws(" ", F.col("sniff.note"), unusual, moved), F.lit(""))
    wrong = F.when(
        mime.isNotNull(),
        F.concat(F.lit('The server returned "'), mime, F.lit('", which is not an image type the scanner can read.')),
    ).otherwise(NO_IMAGE_MESSAGE)
    message = (
        F.when(F.col("status") == "unverified", F.lit(None).cast("string"))
        .when(F.col("http_status").isNull(), F.coalesce("error", F.lit(FAILED_MESSAGE)))
        .when(F.col("http_status") >= 400, L.http_message(F.col("http_status")))
        .when(geo & (F.col("status") == "unsupported"), F.when(html, HTML_MESSAGE).otherwise(F.col("sniff.note")))
        .when(geo, notes)
        .when(F.col("status") == "unsupported", wrong)
        .otherwise(moved)
    )
    shown = ok & ~geo & sized
    complete = ~F.coalesce("truncated", F.lit(False))
    size = F.when(ok, F.when(complete, F.col("body_length")).otherwise(F.col("declared_length"))).when(
        F.col("status") == "unsupported", F.col("declared_length")
    )
    w, h = F.when(shown, F.col("width")), F.when(shown, F.col("height"))
    return stage(
        df,
        status_message=message,
        final_url=F.when(F.col("final_url") != F.col("url"), F.col("final_url")),
        content_hash=F.when(ok & complete, F.col("content_hash")),
        file_size=size,
        width=w, height=h,
        aspect_ratio=I.aspect_ratio(w, h), orientation=I.orientation(w, h), size_bucket=I.size_bucket(w, h),
        below_minimum=F.coalesce(I.below_minimum(F.col("asset_kind"), w, h), F.lit(False)),
    ).drop("_seen", "sniff", "content_type", "error")


def scan_issues(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Issue rows from failed pages (``page_outcomes``) and unavailable assets (``verify_assets``)."""
    columns = ["scan_id", "kind", "url", "title", "detail", "http_status"]
    failed = pages.filter("outcome = 'error'")
    page_issues = failed.select(
        "scan_id", F.when(F.col("http_status").isNotNull(), "http").otherwise("network").alias("kind"), "url",
        F.lit("Unable to retrieve this page.").alias("title"),
        F.when(F.col("http_status").isNotNull(), L.page_http_detail(F.col("http_status"))).otherwise(F.col("error")).alias("detail"),
        "http_status",
    )
    asset_issues = assets.filter("status = 'unavailable' and status_message is not null").select(
        "scan_id", F.lit("image").alias("kind"), "url", F.lit("Image unavailable").alias("title"),
        F.col("status_message").alias("detail"), "http_status",
    )
    return page_issues.select(columns).unionByName(asset_issues.select(columns))


def downloadable(assets: DataFrame) -> DataFrame:
    """Assets not already known to be unretrievable."""
    return assets.filter(~F.col("status").isin("unavailable", "unsupported"))


def download_size_estimate(assets: DataFrame) -> DataFrame:
    """Known bytes over the retrievable selection, and how many assets have a known size."""
    return downloadable(assets).groupBy("scan_id").agg(
        F.sum("file_size").alias("known_bytes"), F.count("file_size").alias("known"), F.count(F.lit(1)).alias("retrievable")
    )


def non_map_images(assets: DataFrame) -> DataFrame:
    """Available images that are not maps, per scan."""
    keep = (F.col("asset_kind") == "image") & (F.col("category") != "map") & (F.col("status") == "available")
    return assets.groupBy("scan_id").agg(F.count_if(keep).alias("other_documents"))


def redetected(column: Column) -> Column:
    """Category after verification: a geographic file keeps the one its format gives."""
    return F.when(F.col("asset_kind") == "geo", F.lit("map")).otherwise(column)
