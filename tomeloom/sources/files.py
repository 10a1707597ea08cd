"""Files of a folder: discovered, admitted, decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAX_FILE_BYTES, READABLE, file_type, mime_type, suffix


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files of readable kinds: path, size_bytes, modified_at, content, file_type, mime_type. Only the columns asked for are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.filter(suffix(F.col("path")).isin(*READABLE))
    return rows.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content", file_type(F.col("path")).alias("file_type"), mime_type(F.col("path")).alias("mime_type"))


def decoded(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not UTF-8."""
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))


def admitted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): too large or empty files are rejects with a message; nothing is raised."""
    text = decoded(F.col("content"))
    rows = files.withColumn("text", F.when(F.col("size_bytes") <= MAX_FILE_BYTES, text))
    error = F.when(F.col("size_bytes") > MAX_FILE_BYTES, "file too large").when(F.btrim(F.regexp_replace("text", r"\s+", " ")) == "", "no text")
    rows = rows.withColumn("error", error)
    good = rows.filter("error is null").select("path", "size_bytes", "modified_at", "file_type", "text", F.sha2("content", 256).alias("file_hash"))
    return good, rows.filter("error is not null").select("path", F.lit("failed").alias("status"), "error")


def title_of(html: Column, path: Column) -> Column:
    """A page's title, else the file's stem."""
    title = F.nullif(F.btrim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))
    return F.coalesce(title, F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
