"""Files as documents: pages of scans by their bytes, and images decoded by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "pdf")


def is_accepted(name: Column) -> Column:
    """Whether a file's name ends in a suffix of SUFFIXES, in any case."""
    return F.lower(F.element_at(F.split(name, "\\."), -1)).isin(*SUFFIXES)


def binary_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, modificationTime, length, content, kind (pdf, image or null) of files with a known suffix.

    Spark's file sources pass over empty files, so those never become documents.
    """
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile")
    files = reader.option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.element_at(F.split("path", "\\."), -1))
    kind = F.when((suffix == "pdf") | (F.substring("content", 1, 4) == F.lit(b"%PDF")), "pdf").when(suffix.isin(*SUFFIXES), "image")
    return files.where(suffix.isin(*SUFFIXES)).withColumn("kind", kind)


def rejected(files: DataFrame) -> DataFrame:
    """Files that don't begin like a PDF or an image and can't become documents, with the reason."""
    head = lambda at, *bytes_: F.substring("content", at, len(bytes_[0])).isin(*[F.lit(b) for b in bytes_])
    known = head(1, b"%PDF", b"\x89PNG", b"II*\x00", b"MM\x00*") | head(1, b"\xff\xd8\xff") | head(1, b"BM") | (head(1, b"RIFF") & head(9, b"WEBP"))
    return files.where(~F.coalesce(known, F.lit(False))).select("path", F.lit("neither image nor PDF").alias("reason"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Images in the package's form (RGB order), decoded by Spark's own source; files that can't be decoded are left out."""
    from ..operators.images import _row, per_image, IMAGE

    raw = spark.read.format("image").option("dropInvalid", "true").load(path)
    image = F.struct(F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return raw.select(F.col("image.origin").alias("path"), per_image(image, lambda a: _row(a if a.ndim == 2 else a[..., [2, 1, 0]]), IMAGE).alias("image"))


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """With the columns that an older table lacks, as nulls of the given types."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def base64_content(files: DataFrame) -> DataFrame:
    return files.withColumn("content_base64", F.base64("content"))
