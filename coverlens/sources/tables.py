"""Scans: stored tables, bill files and the stream of inbound messages."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from coverlens import fixed_values as V
from coverlens.functions.files import file_extension, mime_type
from coverlens.schemas import EVENTS, TABLES


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the stored tables with its declared schema; product ids are named product_id."""
    df = spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}")
    return df.withColumnRenamed("id", "product_id") if name == "product_warranties" else df


def for_user(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def by_id(df: DataFrame, product_id: int, user_id: int | None = None) -> DataFrame:
    """Point lookup; give the owner to keep other users' rows out."""
    df = df.where(F.col("product_id") == product_id)
    return df if user_id is None else for_user(df, user_id)


def with_mime(df: DataFrame, path_col: str, kind: str = "storage") -> DataFrame:
    return df.withColumn("mime_type", mime_type(path_col, kind))


def classify_files(files: DataFrame) -> DataFrame:
    """Intake check of (path, length, is_photo): type, size cap and image flag.

    The cap applies to documents only; a file of unknown size passes. A
    document without a suffix is stored as pdf, a photo always as jpg.
    """
    own = file_extension("path")
    ext = F.when(F.col("is_photo"), F.lit("jpg")).otherwise(F.coalesce(F.nullif(own, F.lit("")), F.lit("pdf")))
    too_large = ~F.col("is_photo") & F.coalesce(F.col("length") > V.MAX_UPLOAD_BYTES, F.lit(False))
    return (files.withColumn("extension", ext)
            .withColumn("accepted", ~too_large)
            .withColumn("is_image", F.col("extension").isin(V.IMAGE_EXTENSIONS)))


def read_bill_files(spark: SparkSession, path: str, photos: str | None = None) -> DataFrame:
    """File listing with intake check; the bytes themselves are never read.

    ``photos`` is a pattern of the paths that came in as photos, to which the
    size cap does not apply.
    """
    is_photo = F.col("path").rlike(photos) if photos else F.lit(False)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length", is_photo.alias("is_photo")))
    return with_mime(classify_files(files), "path")


def read_messages_stream(spark: SparkSession, directory: str, schema=EVENTS, files: str = "*.parquet",
                         max_files: int | None = None) -> DataFrame:
    """Inbound updates as a stream over a folder of Parquet files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)
