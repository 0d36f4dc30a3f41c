"""Photo evidence: a manifest from file bytes, and photo references on reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size cap and magic bytes.
MAX_PHOTO_BYTES = 8 * 1024 * 1024
JPEG_MAGIC = "FFD8FF"
PNG_MAGIC = "89504E470D0A1A0A"
UPLOADS_PREFIX = "uploads/"


def classify_photos(files: DataFrame) -> DataFrame:
    """Type by magic bytes, size check, typed rejection. Needs path and content."""
    starts = lambda magic: F.startswith(F.col("content"), F.unhex(F.lit(magic)))
    media = F.when(starts(JPEG_MAGIC), F.lit("image/jpeg")).when(
        starts(PNG_MAGIC), F.lit("image/png")
    )
    size = F.length("content")
    return files.select(
        "path",
        size.cast("bigint").alias("byte_size"),
        media.alias("media_type"),
        F.when(size > MAX_PHOTO_BYTES, F.lit("photo_too_large"))
        .when(media.isNull(), F.lit("unsupported_photo_type"))
        .alias("rejection"),
    )


def photo_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Manifest of a photo folder, one row per file, read in parallel.

    Files above the size cap are known by their length: the filter is pushed into the reader, so their
    content is never loaded, and their type stays unknown. Spark's reader passes over files of no bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    fits = F.col("length") <= MAX_PHOTO_BYTES
    large = files.filter(~fits).select(
        "path",
        F.col("length").alias("byte_size"),
        F.lit(None).cast("string").alias("media_type"),
        F.lit("photo_too_large").alias("rejection"),
    )
    return classify_photos(files.filter(fits)).unionByName(large)


def attach_photos(complaints: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports with the server path of their photo_id, reports naming an unknown photo).

    ``manifest`` holds photo_id and stored_name. Free-text paths pass through.
    """
    known = manifest.select("photo_id", "stored_name", F.lit(True).alias("_known"))
    joined = complaints.join(known, "photo_id", "left")
    unknown = F.col("photo_id").isNotNull() & F.col("_known").isNull()
    resolved = joined.filter(~unknown).withColumn(
        "photo_path",
        F.when(
            F.col("photo_id").isNotNull(), F.concat(F.lit(UPLOADS_PREFIX), F.col("stored_name"))
        ).otherwise(F.col("photo_path")),
    )
    drop = ("_known", "stored_name")
    return resolved.drop(*drop), joined.filter(unknown).drop(*drop)
